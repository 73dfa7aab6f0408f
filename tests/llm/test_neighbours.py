"""Held-out accuracy, votes against a plain computation, and corner cases."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import neighbours as nb
from docweave.llm import queries
from docweave.llm.rules import statistics


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_neighbour_votes(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 90)).astype(np.float32)
    label = rng.random(300) < 0.6
    voters = nb.Voters(x, label)
    new = rng.standard_normal((40, 90)).astype(np.float32)
    a, b = new @ voters.project, x @ voters.project
    got = voters.score(new)
    for i in range(len(new)):
        close = [float(a[i] @ r / np.linalg.norm(a[i]) / np.linalg.norm(r)) for r in b]
        best = sorted(range(300), key=lambda j: -close[j])[: nb.K]
        power = [max(close[j], 0) ** nb.POWER for j in best]
        assert abs(got[i] - sum(p * label[j] for p, j in zip(power, best, strict=True)) / sum(power)) < 1e-3


def test_trigrams_stay_within_texts():
    for count in nb.counted(pa.array(["abcd", None, "ab", "xyz"])):
        assert count.sum(1).tolist() == [2, 0, 0, 1]


def test_recurrences():
    again = nb.recurrences(pa.array(["a b c d", "x y z x y z x y z", None, "a b c d"]))
    assert again[0].tolist() == [0] * nb.AGAIN and (again[0] == again[3]).all() and again[2].sum() == 0
    assert np.allclose(again[1][:2], [4 / 7, 3 / 7])  # zxy and yzx come twice, xyz three times


def plain_terms(text, idf):
    """The trigrams' part of one text's terms, by a dictionary."""
    out = []
    small = lambda c: 1 if 97 <= c <= 122 or c >= 128 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else c
    for codes, bits, weight, size in ((list(text.encode()), 11, idf[: nb.TERMS], nb.LETTERS), ([small(c) for c in text.encode()], 9, idf[nb.TERMS :], nb.KINDS)):
        count = Counter()
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            h = (((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) * 0x27D4EB2F) % 2**32
            count[h >> (32 - bits)] += 1
        part = np.zeros(1 << bits)
        for k, v in count.items():
            part[k] = (v / sum(count.values())) ** 0.5 * weight[k]
        out.append(size * part / max(np.linalg.norm(part), 1e-9))
    return np.concatenate(out)


def test_the_query_against_brute_force(spark):
    """Terms by dictionaries, a full decomposition, all cosines, and votes with shared last places."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs}
    df = np.zeros(nb.TERMS + nb.SHAPES)
    for text in docs.values():
        df += plain_terms(text or "", np.ones(len(df))) > 0
    idf = np.log((len(docs) + 1) / (df + 1)) + 1
    rest = lambda t: np.concatenate([nb.RETURNS * np.sqrt(nb.recurrences(pa.array([t]))[0]), nb.STYLE * statistics(pa.array([t]))[1][0]])
    x = {i: np.concatenate([plain_terms(t or "", idf), rest(t or "")]) for i, t in docs.items()}
    train = sorted(labels)
    basis = np.linalg.svd(np.stack([x[i] for i in train]), full_matrices=False)[2][: nb.SPACE].T
    latent = {i: v @ basis / max(np.linalg.norm(v @ basis), 1e-9) for i, v in x.items()}
    worst = 0.0
    for r in queries.op2_neighbour_votes(spark, sf).collect():
        close = [round(float(latent[r.doc_id] @ latent[i]), 6) for i in train]
        last = sorted(close)[-nb.K]
        above = sum(c > last for c in close)
        share = [1.0 if c > last else (nb.K - above) / close.count(last) if c == last else 0.0 for c in close]
        power = [s * max(c, 0) ** nb.POWER for s, c in zip(share, close, strict=True)]
        want = sum(p * labels[i] for p, i in zip(power, train, strict=True)) / sum(power)
        worst = max(worst, abs(r.score - want))
        assert r.predicted == (r.score >= 0.3)
    assert worst < 0.03  # the sample's terms are kept in half precision


def test_ties_share_the_last_places():
    x = np.vstack([np.eye(4, dtype=np.float32)[[0] * 20 + [1] * 20]])
    voters = nb.Voters(x, np.array([1] * 10 + [0] * 10 + [1] * 20))
    assert abs(voters.score(np.eye(4, dtype=np.float32)[:1])[0] - 0.5) < 1e-6


def test_many_short_texts_take_little_memory():
    texts = pa.array(["word"] * 10_000)
    idf = np.ones(nb.TERMS + nb.SHAPES, np.float32)
    tracemalloc.start()
    for low, high in nb.blocks(texts, nb.BLOCK, nb.ROWS):
        nb.terms(texts.slice(low, high - low), idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_corner_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("SCORE", T.StringType()), T.StructField("label", T.StringType())])
    rows = [(1, "good words here and there", None, None), (2, "!!!! ### $$$ !!!!", None, None), (3, None, None, None), (4, "", None, None), (None, "good words", None, None), (1, "good words here and there", None, None), (5, "long text " * 100_000, None, None)]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (None, 0), (3, None), (1, 1)], "doc_id long, quality int")
    got = nb.vote(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert next(r.score for r in got if r.doc_id == 1) > next(r.score for r in got if r.doc_id == 2)
    assert {r.score for r in nb.vote(df, labels.where(F.lit(False))).collect()} == {0.5}
    assert nb.vote(df.where(F.lit(False)), labels).collect() == []
