"""Operators on small tables made for them."""

import datetime as dt

from pyspark.sql import functions as F

from docweave.config import EVIDENCE
from docweave.operators import chunking, evidence, graph
from docweave.streaming import windows


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "T", 1.0) for a, b in pairs], "src string, dst string, type string, confidence double")


def test_path_through_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert [tuple(r) for r in graph.shortest_path(e, "a", "d").collect()] == [(["a", "c", "d"], 2)]
    assert graph.shortest_path(e, "a", "z").count() == 0
    assert graph.shortest_path(e, "a", "a").first().length == 0


def test_depths_are_the_least(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    got = graph.within_depth(e, spark.createDataFrame([("a",)], "node string"), 5)
    assert {r.node: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_chunks_hold_every_line_once(spark):
    """Regions are parted by a blank line; every line with words stands in one passage, in order."""
    text = "# One\n" + "\n".join(f"line {i} of some words" for i in range(300)) + "\n\nSECTION TWO\nend"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.chunks(docs).orderBy("doc_id", "chunk_index").collect()
    assert {r.doc_id for r in got} == {1} and [r.chunk_index for r in got] == list(range(len(got)))
    assert [line for r in got for line in r.content.split("\n") if line] == [line for line in text.split("\n") if line]
    assert all(text[r.start :].startswith(r.content.split("\n")[0]) for r in got)
    assert got[0].section == "# One" and got[-1].section == "SECTION TWO"


def test_evidence(spark):
    answers = spark.createDataFrame([("x", 1, "The red pump failed during startup yesterday. It might leak badly again. Bananas grow quickly everywhere.")], "answer string, k long, answer_text string")
    sources = spark.createDataFrame([(1, "log", "red pump failed during startup yesterday"), (2, "other", "bananas grow quickly everywhere")], "k long, source string, source_text string")
    got = evidence.classified(answers, sources, "k", EVIDENCE)
    assert [r.verdict for r in got.orderBy("n").collect()] == ["FACT", "HYPOTHESIS", "UNKNOWN"]
    assert "Bananas" not in evidence.guarded(got).first().text


def test_passages_inside_words(spark):
    passages = spark.createDataFrame([(1, "ow that one two three four five six seven eig"), (2, "short one"), (3, "no such words are here at all or anywhere else"), (4, "Kno"), (5, "kno"), (6, ""), (7, "w t")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Know that one two three four five six seven eight"), (2, "a short one")], "doc_id long, text string")
    assert {r.item_id: r.n_documents for r in evidence.contained(passages, docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 2, 7: 1}


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(hours=i), "view" if i % 2 else "click", 1.0) for i in range(72)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windows.read(spark, str(tmp_path / "in"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    windows.drain(windows.counted(stream, "1 day", "100 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    twice = windows.first_of_key(stream, "event_id", "100 days")
    windows.drain(twice, str(tmp_path / "once"), str(tmp_path / "ck2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "once")).count() == 72
    batch = windows.counted(events, "1 day")
    assert batch.agg(F.sum("n")).first()[0] == 72
