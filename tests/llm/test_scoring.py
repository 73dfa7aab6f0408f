"""Base scores against a plain count, the model against numerical gradients and sums of probabilities, held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import gru, queries, scoring


def vocabulary(n=60):
    rng = np.random.default_rng(1)
    return gru.Vocabulary(rng.integers(1, 2**63, n, dtype=np.uint64), np.sort(rng.integers(1, 500, n))[::-1])


def test_probabilities_sum_to_one():
    words = vocabulary()
    model = gru.Model(words)
    h = np.random.default_rng(2).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(words.n + 1)
    assert abs((10 ** model.log10(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4
    assert sorted(set(words.cls.tolist()))[-1] == gru.CLASSES - 1 and (np.diff(words.cls) >= 0).all()


def test_gradients():
    words = vocabulary(20)
    model = gru.Model(words)
    rng = np.random.default_rng(3)
    inp, target = rng.integers(0, words.rows, (gru.WINDOW, 3)), rng.integers(0, words.n + 1, (gru.WINDOW, 3))
    begins = rng.random((gru.WINDOW, 3)) < 0.2

    def loss():
        h, out = np.zeros((3, gru.HIDDEN), np.float32), 0.0
        for t in range(gru.WINDOW):
            h = model.gates(model.inp[inp[t]], h * ~begins[t][:, None])[3]
            out -= model.log10(h, target[t]).sum() * math.log(10)
        return out / 3

    got = {}
    model._move = lambda name, grad, rows=None: got.__setitem__(name, (grad, rows))
    model._window(inp, target, begins, np.zeros((3, gru.HIDDEN), np.float32))
    for name in ("rec", "mid", "cls", "out", "inp"):
        grad, rows = got[name]
        place = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        at = place if rows is None else (rows[place[0]], place[1])
        value = getattr(model, name)
        value[at] += 0.01
        up = loss()
        value[at] -= 0.02
        down = loss()
        value[at] += 0.01
        assert abs((up - down) / 0.02 - grad[place]) < 0.05 * abs(grad[place]) + 0.01, name


def test_every_token_teaches_once(monkeypatch):
    words = vocabulary()
    rng = np.random.default_rng(4)
    for n in (1, gru.WINDOW - 1, 3 * gru.WINDOW + 2, gru.LANES * (gru.WINDOW + 1) - 1):
        model = gru.Model(words)
        seen, window, before = Counter(), model._window, model.packed()
        inp, target, begins = rng.integers(0, words.rows, n), rng.integers(0, words.n + 1, n), rng.random(n) < 0.1

        def noted(*given, seen=seen, window=window):
            seen.update(zip(*(a.ravel().tolist() for a in given[:3]), strict=True))
            return window(*given)

        monkeypatch.setattr(model, "_window", noted)
        model.train(inp, target, begins)
        assert seen == Counter(zip(inp.tolist(), target.tolist(), begins.tolist(), strict=True))
        assert model.packed() != before


def test_state_is_carried_through_whole_texts():
    words = vocabulary()
    model = gru.Model(words)
    rng = np.random.default_rng(5)
    length = [1, 700, 3, 40, 0 + 2, 90]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    n = sum(length)
    inp, target = rng.integers(0, words.rows, n), rng.integers(0, words.n + 1, n)
    got = model.score(inp, target, first)
    for a, size in zip(first, length, strict=True):
        h = np.zeros((1, gru.HIDDEN), np.float32)
        for t in range(a, a + size):
            h = model.gates(model.inp[inp[t]][None], h)[3]
            assert abs(model.log10(h, target[t : t + 1])[0] - got[t]) < 1e-3


def test_tokens():
    h, first = scoring.tokens(pa.array(["A b\tB", None, "", "é É a"]))
    assert first.tolist() == [0, 4, 5, 6] and len(h) == 10
    assert h[1] == h[2] and h[0] == h[8] and h[6] != h[7] and [i for i in range(10) if h[i] == scoring.END] == [3, 4, 5, 9]


def test_scores_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_gru_scores(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs.items() if not held(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    for r in rows:
        words = tokens(docs[r.doc_id])
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(w in count for w in words), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_rare_words_meet_their_counts(spark, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a a b", "a b c", "d", "d e f f", "g h a"])], "doc_id long, text string").repartition(3)
    for r in scoring.score(docs, learn=F.col("doc_id") < 4).collect():
        if r.doc_id == 4:  # a 3 times, f and others less, end 4; g and h unknown; 15 tokens, 7 kinds
            assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 2, 15)
            assert abs(r.base_score - (math.log10(4) + math.log10(5) - 4 * math.log10(15 + 7 + 1))) < 1e-9


def test_corner_cases(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("SCORE", T.StringType()), T.StructField("h", T.StringType())])
    df = spark.createDataFrame([(1, None, "x", None), (2, "", None, None), (None, "a b", None, None), (3, "w " * 50_000, None, None), (3, "w " * 50_000, None, None)], schema)
    rows = scoring.score(df, learn=F.lit(True)).collect()
    assert len(rows) == 5 and sorted(r.n_tokens for r in rows) == [1, 1, 3, 50_001, 50_001]
    rows = scoring.score(df, learn=F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert scoring.score(df.where(F.lit(False)), learn=F.lit(True)).collect() == []
