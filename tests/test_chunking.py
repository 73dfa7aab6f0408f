"""The chunker against recursive SQL over the same texts, and what passages have to hold."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docweave.operators import chunking as ch
from docweave.plans import chunk_sql


def texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    makers = [
        lambda: "", lambda: "# " + line(3), lambda: "1.2 " + line(2), lambda: "IV. " + line(2), lambda: "Section 3: " + word(), line(4).upper, lambda: "---", lambda: "```", lambda: "~~~~", lambda: "```` x",
        lambda: "| a | b |", lambda: "- " + line(3), lambda: "2) " + line(2), lambda: line(rnd.randrange(1, 30)) + ".", lambda: line(rnd.randrange(1, 80)), lambda: line(12), lambda: word() * 120, lambda: "=====", lambda: "  ",
    ]
    out = ["", "\n\n", "one", "```\nopen", "# A\n# B\n# C", "x " * 900, "\n".join(line(20) for _ in range(40)), "a\n" * 400, "  \n x" * 300]
    return out + ["\n".join(rnd.choice(makers)() for _ in range(rnd.randrange(1, 60))) for _ in range(250)]


@pytest.fixture(scope="module")
def given():
    return texts()


@pytest.fixture(scope="module")
def duck(given):
    con = duckdb.connect()
    frame = pd.DataFrame(list(enumerate(given)), columns=["doc_id", "text"])
    con.register("frame", frame)
    con.execute("create table docs as select * from frame")
    return con


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_regions_packing_and_merging(spark, given, duck):
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    size, least = 64, 12
    steps = f"with recursive {chunk_sql.lines('docs')}, {chunk_sql.passages(size, least)}"
    parts = ch.regions(ch.lines(docs))
    assert rows_of(parts, "doc_id", "region", "type", "content", "offset") == sorted(duck.execute(f"{steps} select doc_id, region, type, content, off from regions").fetchall())
    packed = ch.packed(parts, size)
    assert rows_of(packed, "doc_id", "place", "offset", "content") == sorted(duck.execute(f"{steps} select doc_id, place, off, content from packed").fetchall())
    merged = ch.merged(packed, size, least)
    assert rows_of(merged, "doc_id", "chunk_index", "offset", "content") == sorted(duck.execute(f"{steps} select doc_id, chunk_index, off, content from chunks_").fetchall())


def test_words_come_once_and_in_order(spark, given):
    """Without overlaps, packing and merging lose no word and repeat none, breaks aside."""
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    parts = ch.regions(ch.lines(docs)).where("type <> 'break'")
    done = ch.merged(ch.packed(parts, 10_000), 10_000, 3)
    got: dict[int, list[str]] = {}
    for _, _, i, content in sorted((r.doc_id, r.chunk_index, r.doc_id, r.content) for r in done.collect()):
        got.setdefault(i, []).extend(content.split())
    want: dict[int, list[str]] = {}
    for i, _, content in sorted((r.doc_id, r.region, r.content) for r in parts.collect()):
        want.setdefault(i, []).extend(content.split())
    assert got == {i: w for i, w in want.items() if w}


def test_pieces_overlap_and_fit(spark):
    rnd = random.Random(2)
    given = [" ".join("w" * rnd.randrange(1, 12) for _ in range(n)) for n in (1, 50, 400, 1500)] + ["\n".join("line " * rnd.randrange(1, 12) for _ in range(120)), "x" * 1000, "\n\n\n" + "y " * 300, "a" * 200 + "\n\n" + "b" * 200]
    rows = spark.createDataFrame(list(enumerate(given)), "key long, content string").select("key", ch.pieces(F.col("content"), 50, 10).alias("p")).collect()
    con = duckdb.connect()
    frame = pd.DataFrame(list(enumerate(given)), columns=["key", "content"])
    con.register("frame", frame)
    want = sorted(con.execute(f"with recursive {chunk_sql.pieces('part', 'frame', 50, 10)} select key, piece, start, content from part").fetchall())
    assert sorted((r.key, k, p.start, p.content) for r in rows for k, p in enumerate(r.p)) == want
    assert all(len(p.content.strip()) <= 200 for r in rows for p in r.p)


def test_sections_pages_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "intro words here\n\n# First\n" + "text " * 30 + "\nUnder\n=====\n" + "more " * 30), (2, None), (3, "")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, 0), (1, 2, 20), (9, 5, 0)], "doc_id long, page long, offset long")
    rows = sorted(ch.chunks(docs, size=40, least=4, pages=pages).collect(), key=lambda r: r.chunk_index)
    assert {r.doc_id for r in rows} == {1} and rows[0].section is None and rows[1].section == "# First" and rows[-1].section in ("# First", "Under")
    assert all(r.page == (1 if r.start < 20 else 2) and r.total == len(rows) for r in rows) and rows[-1].page == 2
    assert {r.page for r in ch.chunks(docs).collect()} == {None}
    assert ch.chunks(docs.where("false")).collect() == []


def test_many_fences_take_linear_time(spark):
    text = "```\ncode\n```\nwords of prose\n" * 20_000
    rows = ch.regions(ch.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {r.type: r["count"] for r in rows.groupBy("type").count().collect()} == {"code": 20_000, "paragraph": 20_000}


def test_long_paragraphs_keep_their_zero_characters(spark):
    text = "a\x00b " * 200
    found = [p.content for r in spark.createDataFrame([(text,)], "content string").select(ch.pieces(F.col("content"), 50, 10).alias("p")).collect() for p in r.p]
    assert len(found) > 1 and all(set(p.split(" ")) - {""} == {"a\x00b"} for p in found)


def test_lines_that_end_with_a_return_are_judged_as_in_sql(spark):
    given = ["| a |\r\n| b |\r\nTitle.\r\n# T\r\nwords\r", "ß\nÄÖÜ X\nUnder\n==\n\n1. One item\n*** \n___"]
    con = duckdb.connect()
    frame = pd.DataFrame(list(enumerate(given)), columns=["doc_id", "text"])
    con.register("frame", frame)
    steps = f"with recursive {chunk_sql.lines('frame')}"
    rows = ch.lines(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"))
    assert rows_of(ch.regions(rows), "doc_id", "region", "type", "content", "offset") == sorted(con.execute(f"{steps} select doc_id, region, type, content, off from regions").fetchall())
    want = sorted(con.execute(f"{steps} select doc_id, off, title from titles").fetchall())
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    assert rows_of(ch.headings(rows), "doc_id", "offset", "title") == want == rows_of(ch.titles(ch.outlined(docs)), "doc_id", "offset", "title")


def test_chunks_carry_texts_over_few_shuffles(spark):
    """Steps by document follow one shuffle of it: no table is written on the way, and no step joins texts again."""
    plan = ch.chunks(spark.createDataFrame([(1, "a\n" * 40)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "parquet" not in plan and plan.count("Exchange ") <= 6
