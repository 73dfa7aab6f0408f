"""Sketches against exact similarities, components against a brute-force union of all linked pairs."""

import random

import numpy as np
from pyspark.sql import types as T

from docweave.llm import nearcopies, setsketch, skew
from docweave.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("rep", T.StringType())])


def plain_sets(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    return sets


def plain_components(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def noisy(rnd, words, share):
    return " ".join(rnd.choice("abcdefgh") * 5 + str(rnd.randrange(999)) if rnd.random() < share else w for w in words)


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 6)))
    texts = [None, "", " \n ", "one", "ONE", "one two", "a b", "A  B\n", "İstanbul b", "i̇stanbul b"]
    base = [word() for _ in range(80)]
    texts += [noisy(rnd, base, rnd.choice([0, 0.01, 0.03, 0.05, 0.06, 0.08, 0.1])) for _ in range(150)]
    texts += [" ".join(base)] * 20
    for _ in range(40):
        short = [word() for _ in range(rnd.randrange(2, 14))]
        texts += [" ".join(short), noisy(rnd, short, 0.1), " ".join(short[:-1])]
    chain = [str(i) for i in range(260)]
    texts += [" ".join(chain[i : i + 120]) for i in range(0, 140, 6)]
    passage = [word() for _ in range(60)]
    for _ in range(120):  # half of each text is the same passage; some have a twin that is linked
        own = [word() + str(rnd.randrange(9999)) for _ in range(50)]
        texts.append(" ".join(passage + own))
        if rnd.random() < 0.3:
            texts.append(" ".join(passage + noisy(rnd, own, 0.08).split()))
    texts.append(" ".join(word() for _ in range(40_000)))
    rnd.shuffle(texts)
    return list(enumerate(texts, 100))


def test_components_are_exact(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows + rows[:3]] + [(None, rows[0][1], None, None)], SCHEMA)
    got = nearcopies.near_copies(df).collect()
    assert len(got) == len(rows) + 4
    sets = plain_sets(rows)
    want = plain_components(sets)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_components_with_dealt_hubs(spark, monkeypatch):
    """The paths of large tables: every key of more than a few rows is dealt, and all buckets are large."""
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr("docweave.llm.components.LEAST", 4)
    monkeypatch.setattr(nearcopies, "SMALL", 3)
    rows = corpus()
    want = plain_components(plain_sets(rows))
    got = nearcopies.near_copies(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_empty_table(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_linked_sets_share_a_rare_shingle():
    rnd = random.Random(6)
    for _ in range(3000):
        n = rnd.randrange(1, 40)
        a = set(rnd.sample(range(60), n))
        b = set(a)
        for _ in range(rnd.randrange(0, 10)):
            b ^= {rnd.randrange(60)}
        if b and 100 * len(a & b) >= 80 * len(a | b):
            rank = list(range(60))
            rnd.shuffle(rank)
            first = [set(sorted(s, key=rank.__getitem__)[: nearcopies.prefix(len(s))]) for s in (a, b)]
            assert first[0] & first[1]


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 256)
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) as key", "id as row")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n")
    one = spark.range(20_000).selectExpr("id as key", "id * 2 as twice").union(spark.createDataFrame([(99_999, 0)], "key long, twice long"))
    got = skew.star_join(rows, one, "key", "row", counts)
    assert got.count() == 20_000 and got.where("twice <> key * 2").count() == 0
    heavy = skew.heavy_keys(counts, "key").collect()
    assert [r.key for r in heavy] == [7] and heavy[0]["__salts"] > 4


def test_component_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7)] + [(500, i) for i in range(501, 600)] + [(None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 150: 100} | {i: 500 for i in range(501, 600)}


def test_estimates_and_merging():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.5, 0.8, 0.95):
        h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        both = int(share * 2000)
        a, b = h[:2000], np.concatenate([h[:both], h[2000 : 4000 - both]])
        b = b[: max(both, 1000)]
        marks = [setsketch.registers(x, np.array([0])) for x in (a, b)]
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(setsketch.similarity(*marks, np.array([len(a)]), np.array([len(b)]))[0] - exact) < 0.15
        assert (setsketch.merge(*marks) == setsketch.registers(np.union1d(a, b), np.array([0]))).all()


def test_a_family_sends_on_what_may_be_linked_only(spark):
    """Sets of one template that share half of it: no two of them are linked, and none goes on to be multiplied."""
    half = [f"t{i}" for i in range(200)]
    sets = {i: np.unique(np.array([hash(w) & ((1 << 63) - 1) for w in half + [f"u{i}-{j}" for j in range(200)]], np.uint64)) for i in range(60)}
    sets[60] = sets[0].copy()
    sets[60][:4] += np.uint64(1)
    sets[60] = np.unique(sets[60])
    members = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "rep long, shingles binary").cache()
    kin = spark.createDataFrame([(1, i, i, i > 0) for i in sets], "family long, rep long, part long, over boolean")
    assert {r.rep for r in nearcopies.meeting(kin, members).collect()} == {0, 60}


def test_empty_texts_and_copies_need_no_join(spark):
    rows = [(i, None if i % 3 else "same words in each of these") for i in range(60)] + [(None, "same words in each of these")]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {i: (0 if i is not None and i % 3 == 0 else i, i == 0 or i is None or i % 3 > 0) for i, _ in rows}
