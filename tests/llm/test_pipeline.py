"""Each stage against a plain version of its decision."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as cp
from tests.llm.test_mixing import plain_targets
from tests.llm.test_nearcopies import plain_components, plain_sets
from tests.llm.test_rules import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns(stages):
    for before, after in stages[:4]:
        assert after.columns == before.columns


def test_quality_rules(stages, spark):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[0])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    failed = {i for i, t in before.items() if plain(t)[0] < 10 or 100 * plain(t)[4] > 20 * plain(t)[0]}
    assert not failed & set(after)
    good = [i for i, q in labels.items() if q == 1 and i not in failed]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.1 * len(bad)


def test_near_dedup(stages):
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages[1])
    component = plain_components(plain_sets(before.items()))
    assert set(after) == {i for i, c in component.items() if i == c}


def test_secret_scan(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2])
    assert set(before) == set(after)
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all("[secret]" in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)


def test_source_mix(stages):
    before, after = (d.withColumn("size", F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))).collect() for d in stages[3])
    sizes, got = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    for r in after:
        got[r.source] = got.get(r.source, 0) + r.size
    want, most = plain_targets(sizes), max(r.size for r in before)
    assert all(abs(got.get(s, 0) - want[s]) <= most for s in want)


def test_tokens(stages):
    before, after = stages[4]
    want = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())
    assert sorted(r.decoded_sha256 for r in after.collect()) == want


def test_run_gives_the_last_stage(stages, spark):
    key = lambda d: sorted((r.doc_id, r.ids_sha256) for r in d.collect())
    assert key(cp.run(spark, SF)) == key(stages[4][1])


#: Names that operators use for their own columns.
CLASHES = ("score", "kept", "spans", "n_words", "word_chars", "n_symbols", "base_failed", "size", "taken", "row", "part", "rep", "component_id", "target", "h", "__copies")


def odd_rows(spark):
    words = " ".join(f"word{i} tells{i} of{i} plain{i} text{i}" for i in range(30))
    rows = [
        (1, words, "a"), (2, words, "a"), (2, words, "a"), (3, None, "a"), (4, "", None), (5, "tiny", "b"), (None, words + " and more besides", None),
        (None, words + " and more besides", None), (6, "b " + " ".join(f"x{i} y{i} z" for i in range(40_000)), "b"), (7, "token=abcdefghijklmnop4711 " + " ".join(f"q{i} r{i}" for i in range(40)), None),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    docs = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], schema)
    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES])


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = odd_rows(spark)
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/start")
    docs, seen = spark.read.parquet(f"{tmp_path}/start"), []
    for name, stage in cp.STAGES[:4]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        rows = docs.collect()
        for r in rows:
            for c in CLASHES:
                assert r[c] == f"{c}:{'?' if r.doc_id is None else r.doc_id}"
        seen.append(sorted((r.doc_id or 0) for r in rows))
    # null, empty and short texts go; of repeated rows one stays; null doc_ids stay
    assert seen[0] == [0, 0, 1, 2, 2, 6, 7] and seen[1] == [0, 0, 1, 6, 7] and seen[2] == seen[1] and set(seen[3]) <= set(seen[2])
    masked = next(r for r in spark.read.parquet(f"{tmp_path}/secret_scan").collect() if r.doc_id == 7)
    assert masked.text.startswith("[secret] q0") and masked.n_chars == len(masked.text)
    out = cp.STAGES[4][1](spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in out) == seen[3] and all(r.n_tokens == len(r.ids) for r in out)


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(5, "one two three four", "s"), (5, "one two three four", "t"), (6, "something else entirely", "s"), (None, "x y", "s"), (None, "x y", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0) for r in cp.near_dedup(spark, docs, SF).collect()) == [0, 0, 5, 6]


def test_the_row_that_stays_is_whole(spark):
    """Null texts keep their columns; of rows with one text, that of the least other columns stays, wherever it stands."""
    rows = [(1, None, "en", "web", 3), (1, None, "en", "web", 3), (2, "one two three", "en", "b", 1), (2, "one two three", "de", "a", 2), (2, None, "xx", "0", 0), (3, "other words here", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = {(1, None, "en", "web", 3), (2, "one two three", "de", "a", 2), (3, "other words here", None, None, None)}
    for given in (rows, rows[::-1]):
        assert {tuple(r) for r in cp.near_dedup(spark, spark.createDataFrame(given, schema), SF).collect()} == want


def test_empty_table(spark):
    docs = odd_rows(spark).where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).collect() == []
