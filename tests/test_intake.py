"""Files against records, texts from files, and answers of models."""

import pytest

from docweave.operators import answers, integrity
from docweave.sources import files


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_bytes(b"12345")
    (tmp_path / "a" / "b" / "y.txt").write_bytes(b"1")
    (tmp_path / "a" / "empty.txt").write_bytes(b"")
    (tmp_path / "a" / "_hidden").write_bytes(b"1")
    rows = files.listed(spark, str(tmp_path / "a"))
    assert {(r.path, r.bytes) for r in rows.collect()} == {("x.txt", 5), ("b/y.txt", 1)}
    read = rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "content" not in read


def test_every_state(spark, tmp_path):
    for name, size in (("ok", 3), ("big", 9), ("old", 1), ("new", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    expected = [("ok", 3, True), ("big", 4, True), ("old", 1, False), ("lost", 5, True), ("off", 5, False), (None, 1, True), ("ok", None, False)]
    got = files.compared(spark.createDataFrame(expected, "path string, bytes long, wanted boolean"), files.listed(spark, str(tmp_path))).collect()
    assert {r.path: r.state for r in got} == {"ok": "valid", "big": "different", "old": "orphan", "lost": "missing", "off": "gone", "new": "extra", None: "unverifiable"}


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("  Grüße\n\n".encode())
    (tmp_path / "l.txt").write_bytes("Grüße".encode("latin-1"))
    (tmp_path / "e.txt").write_bytes(b" \n")
    (tmp_path / "x.bin").write_bytes(b"no text")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.char_count) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"u.txt": ("Grüße", 5), "l.txt": ("Grüße", 5)}


GOOD = '{"title":"t","summary":"s","content":"c"'


@pytest.mark.parametrize(
    ("raw", "state", "items"),
    [
        (None, "empty", []),
        (" \n ", "empty", []),
        ("```json\n```", "empty", []),
        ("[]", "parsed", []),
        ("{}", "not a list", []),
        ("null", "not a list", []),
        ("[1, 2", "not json", []),
        (f"```json\n[{GOOD}}}]\n```", "parsed", ["kept"]),
        (f"[{GOOD}}}]", "parsed", ["kept"]),
        (f'[{GOOD},"importance":1}}, {GOOD},"importance":1.01}}, {GOOD},"confidence":"x"}}, {GOOD},"confidence":null}}]', "parsed", ["kept", "bad", "bad", "bad"]),
        (f'[{GOOD},"should_remember":true}}, {GOOD},"should_remember":false}}, {GOOD},"should_remember":0}}, {GOOD},"should_remember":null}}]', "parsed", ["kept", "skipped", "skipped", "skipped"]),
        (f'[{GOOD},"entities":[]}}, {GOOD},"entities":[{{"a":1}}]}}, {GOOD},"entities":[1]}}, {GOOD},"entities":"x"}}, {GOOD},"relationships":[null]}}]', "parsed", ["kept", "kept", "bad", "bad", "bad"]),
        ('[{"title":"t","summary":"s"}, {"title":1,"summary":"s","content":"c"}, "x", 5, null, []]', "parsed", ["bad"] * 6),
        (f'[{GOOD},"category":"fact"}}, {GOOD},"category":5}}]', "parsed", ["kept", "bad"]),
    ],
)
def test_answers(spark, raw, state, items):
    df = spark.createDataFrame([(1, raw)], "k long, raw string")
    assert [r.state for r in answers.memory_items(df, "k").orderBy("place").collect()] == items
    r = answers.counted(df, "k").first()
    assert (r.state, r.kept, r.skipped, r.bad) == (state, items.count("kept"), items.count("skipped"), items.count("bad"))


def test_values_of_items(spark):
    df = spark.createDataFrame([(1, f'[{GOOD},"importance":"0.25"}}]')], "k long, raw string")
    r = answers.memory_items(df, "k").first()
    assert (r.title, r.importance, r.confidence, r.category) == ("t", 0.25, 0.5, "general")
    assert answers.counted(df.limit(0), "k").collect() == []


def test_documents_of_one_name_are_not_listed(spark):
    """A name that many documents bear says only that they are several, so no node carries them all."""
    docs = spark.createDataFrame([(i, "many.txt", False) for i in range(50)] + [(90, "one.txt", False), (91, "gone.txt", True)], "document long, filename string, deleted boolean")
    chunks = spark.createDataFrame([(5, 5), (90, 90)], "chunk long, document long")
    nodes = spark.createDataFrame(
        [("a", 5, "many.txt", 5, None), ("b", None, "one.txt", 90, None), ("c", 91, "gone.txt", None, None), ("d", None, None, None, "u"), ("e", 90, "one.txt", 90, None), ("f", None, "many.txt", None, None), ("g", None, "one.txt", 5, None)],
        "id string, document long, source string, chunk long, user string",
    )
    got = integrity.classified_nodes(nodes, docs, chunks)
    want = {"a": (None, "valid"), "b": (90, "inconsistent"), "c": (None, "stale"), "d": (None, "valid"), "e": (90, "valid"), "f": (None, "stale"), "g": (None, "stale")}
    assert {r.id: (r.meant, r.state) for r in got.collect()} == want
    assert "collect_" not in got._jdf.queryExecution().optimizedPlan().toString()
