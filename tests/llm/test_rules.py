"""Base statistics against a plain count, and the forest's verdict on labelled rows it hasn't seen."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(5)
    out = [None, "", " \n\n ", "a", "a b c d e " * 3, "one\ntwo\none\n\n one\none", "é\xa0ß x y", "\n", "x\r\nx\r\n", "a a a a a a a", "w " * 30_000]
    return out + ["".join(rnd.choice(["a", "b", "ö", " ", " ", "\n", "|", "#", "\t", "!"]) for _ in range(rnd.randrange(200))) for _ in range(300)]


def test_base_statistics_match_a_plain_count():
    given = texts()
    base, _ = rules.statistics(pa.array(given, pa.string()))
    got = list(zip(*(base[c].tolist() for c in rules.BASE), strict=True))
    assert got == [plain(t) for t in given]


def test_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    rows = rules.judge(docs.select("doc_id", "text"), seen).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept", "base_failed").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.02 * len(good)


def test_corner_cases(spark):
    given = texts()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("KEPT", T.StringType()), T.StructField("source", T.StringType())])
    df = spark.createDataFrame([(None if i == 3 else i, t, None, None) for i, t in enumerate(given)] + [(4, given[4], None, None)], schema)
    none = spark.createDataFrame([(1, None), (None, 1), (10**9, 1)], "doc_id long, quality int")
    rows = rules.judge(df, none).collect()
    assert len(rows) == len(given) + 1 and sum(r.doc_id == 4 for r in rows) == 2
    for r in rows:
        if r.doc_id is not None:
            n_words, _, _, _, again = plain(given[r.doc_id])
            assert r.base_failed == (n_words < 10 or 100 * again > 20 * n_words) and r.kept == (not r.base_failed)
    assert rules.judge(df.where(F.lit(False)), none).collect() == []


def test_threshold_in_the_gap():
    assert rules.threshold(np.array([0.1, 0.2, 0.8]), np.array([True, True, False])) == 0.5
    assert rules.threshold(np.array([0.1, 0.2]), np.array([True, True])) == 1.0


def plain_path(tree, row):
    """A walk from the root, a node at a time."""
    node, depth = 0, 0
    while tree["feature"][node] >= 0:
        node = 2 * node + (2 if row[tree["feature"][node]] >= tree["split"][node] else 1)
        depth += 1
    return node, depth


def mean_depth(n):
    """Mean depth of a row in a random search tree, by the recurrence over all first splits."""
    depth = [0.0, 0.0]
    for k in range(2, n + 1):  # an unsuccessful search among k - 1 keys: 2 (H(k) - 1)
        depth.append(2 * (sum(1 / i for i in range(1, k + 1)) - 1))
    return depth[n]


def test_average_path_is_that_of_random_trees():
    assert rules.average_path(0) == rules.average_path(1) == 0 and rules.average_path(2) == 1
    for n in (3, 10, 256, 4000):
        assert abs(rules.average_path(n) - mean_depth(n)) < 1.6 / n


def test_leaves_hold_the_rows_that_walk_to_them():
    rng = np.random.default_rng(5)
    rows = rng.random((200, 4))
    tree = rules.grow(rows, rows.min(0), rows.max(0), np.random.default_rng(1))
    walks = [plain_path(tree, r) for r in rows]
    held = Counter(node for node, _ in walks)
    for node, depth in walks:
        assert depth == rules.DEPTH and tree["path"][node] == depth + rules.average_path(held[node])


def test_scores_by_plain_walks():
    rng = np.random.default_rng(6)
    rows = np.vstack([rng.random((300, 6)) * 0.3, rng.random((12, 6)) * 3 + 2])
    good = np.arange(len(rows)) < 300
    forest = rules.Forest(rows, good)
    new = np.vstack([rows[::10], rng.random((20, 6)) * 5])
    got = forest.score(new)
    for row, score in zip(new, got, strict=True):
        paths = []
        for k in range(rules.TREES):
            tree = {"feature": forest.feature[k], "split": forest.split[k]}
            paths.append(forest.path[k][plain_path(tree, row)[0]])
        assert abs(score - 2 ** (-np.mean(paths) / rules.average_path(rules.TREE_ROWS))) < 1e-9
    assert forest.score(rows[~good]).min() > np.median(forest.score(rows[good]))


def test_the_query_by_plain_walks(spark):
    """Every verdict of the whole table: base rules by a plain count, the forest a walk at a time."""
    from docweave.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest, limit = rules.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_isolation_rules(spark, sf).collect():
        n_words, _, _, _, again = plain(texts[r.doc_id])
        x = rules.statistics(pa.array([texts[r.doc_id]], pa.string()))[1][0]
        paths = [forest.path[k][plain_path({"feature": forest.feature[k], "split": forest.split[k]}, x)[0]] for k in range(rules.TREES)]
        score = 2 ** (-np.mean(paths) / forest.scale)
        assert abs(r.score - score) < 1e-9 and r.base_failed == (n_words < 10 or 100 * again > 20 * n_words)
        assert r.kept == (not r.base_failed and r.score <= limit)


def test_threshold_of_a_table_is_that_of_its_arrays(spark):
    rnd = random.Random(3)
    for bad in (0.0, 0.3, 1.0):
        rows = [(round(rnd.random() * 0.7 + (0.2 if b else 0.0), 3), not b) for b in (rnd.random() < bad for _ in range(400))]
        want = rules.threshold(np.array([s for s, _ in rows]), np.array([g for _, g in rows]))
        assert rules.threshold_of(spark.createDataFrame(rows, "score double, good boolean")) == want


def test_all_labelled_rows_teach(spark, monkeypatch):
    """The forest holds every good labelled row, more than any sample of it."""
    n = 9000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some plain words"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen = []
    filled = rules.Forest.filled
    monkeypatch.setattr(rules.Forest, "filled", lambda self, held, total: seen.append((sum(held.values()), total)) or filled(self, held, total))
    rules.fit(docs, labels)
    assert seen == [(rules.TREES * n, n)]
