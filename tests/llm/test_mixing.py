"""Targets, positions and schedule against a plain walk through the stream of words."""

import hashlib
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("target", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = rest / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and weight[s] * share > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * share for s in names}
        capped |= more


def corpus():
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 300])), rnd.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(300)]
    rows += [(None, "x y", "b"), (5000, None, "a"), (5001, "one", "tiny"), (5002, "", "empty"), (5003, "w\x0b\x1fz " * 9000, "z"), (5004, "q\xa0q", None)]
    return [(i, t, s, "clash", "clash") for i, t, s in rows]


def test_mix_is_that_of_the_stream(spark):
    rows = corpus()
    mixed, schedule = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = mixed.collect()
    assert len(got) == len(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    sizes: dict = {}
    for i, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = plain_targets(sizes)
    taken = {}
    for s in sizes:
        docs = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), size[i], i) for i, _, t, *_ in rows if t == s)
        left = round(want[s])
        for _ in range(3):
            for _, n, i in docs:
                taken[i] = taken.get(i, 0) + min(n, left)
                left -= min(n, left)
        assert left == 0
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[r.source])
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken == taken[r.doc_id] <= 3 * r.size
    turns = schedule.collect()
    assert sum(t.n_words for t in turns) == sum(taken.values())
    # every stretch of slots holds the large sources in about their shares
    last = max(t.slot for t in turns)
    for s in ("a", "z"):
        early = sum(t.n_words for t in turns if t.source == s and t.slot < last / 2)
        assert abs(early - want[s] / 2) < 8 * mixing.SLOT
    again = {(r.doc_id, r.taken) for r in mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA))[0].collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_empty_tables(spark):
    mixed, schedule = mixing.mix(spark.createDataFrame([], SCHEMA))
    assert mixed.collect() == [] and schedule.collect() == []
    mixed, schedule = mixing.mix(spark.createDataFrame([(1, None, None, None, None)], SCHEMA))
    assert [(r.size, r.target, r.taken) for r in mixed.collect()] == [(0, 0.0, 0)] and schedule.collect() == []


def test_points(spark):
    got = [r.p for r in spark.range(8).select(mixing.van_der_corput(F.col("id")).alias("p")).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]
