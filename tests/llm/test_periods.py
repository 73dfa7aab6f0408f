"""Runs against a search by the definition."""

import hashlib
import random
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import periods
from docweave.llm.queries import QUERIES

ALL = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed", "collapsed_sha256")


def by_definition(words):
    """Every maximal stretch with its smallest period, from all starts and periods."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(6, 4 * q):
                found.setdefault((i, end + q), q)
            i = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def found_in(texts):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return periods.periodic_runs(np.array([ord(c) for t in texts for c in t], np.int64), first)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=9), st.integers(0, 9), st.text("abc", max_size=5)).map(lambda x: x[0] * x[1] + x[2]), max_size=6))
def test_runs_of_letters(texts):
    assert found_in(texts) == [by_definition(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=150), max_size=4))
def test_runs_of_two_letters(texts):
    assert found_in(texts) == [by_definition(t) for t in texts]


def test_nested_and_overlapping_runs():
    rnd = random.Random(3)
    for _ in range(60):
        inner = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))) * rnd.randrange(1, 8)
        text = (inner + "".join(rnd.choice("abc") for _ in range(rnd.randrange(4)))) * rnd.randrange(1, 7) + inner[: rnd.randrange(len(inner))]
        assert found_in([text, text[1:], text]) == [by_definition(text), by_definition(text[1:]), by_definition(text)]


def test_long_runs_are_fast():
    began = time.perf_counter()
    assert found_in(["a" * 400_000]) == [[(0, 400_000, 1)]]
    assert found_in(["aaaab" * 80_000]) == [[(0, 400_000, 5)]]
    rnd = random.Random(5)
    unit = "".join(chr(rnd.randrange(200, 60_000)) for _ in range(30_000))
    assert found_in([unit * 5 + unit[:77]]) == [[(0, 150_077, 30_000)]]
    assert time.perf_counter() - began < 60


def test_operator_with_odd_rows(spark):
    given = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "x " * 9 + "y"), (5, "x " * 9 + "y"), (6, "die  die\ndie die die die ü ß ü ß ü ß ü ß"), (None, "k l " * 6), (7, "a b a b " * 40_000 + "end"), (8, "a b " * 8)]
    rows = periods.find_runs(spark.createDataFrame([(i, t, "clash") for i, t in given], "doc_id long, text string, Runs string"), outputs=ALL).collect()
    assert sorted((r.text or "", r.doc_id or 0) for r in rows) == sorted((t or "", i or 0) for i, t in given)
    for r in rows:
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in r.text or "").split(" ") if w]
        runs = [(0, 160_000, 2)] if r.doc_id == 7 else by_definition(words)
        left = collapsed(words, runs) if r.doc_id != 7 else ["a", "b", "end"]
        assert [tuple(x) for x in r.runs] == runs and r.n_runs == len(runs) and r.collapsed == " ".join(left)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(left).encode()).hexdigest()
        if runs:
            s, n, q = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4


def test_strongest_of_equal_exponents():
    assert periods.strongest([(3, 8, 2), (5, 16, 4), (40, 6, 1), (60, 12, 2)]) == (40, 6, 1)
    assert periods.strongest([]) is None


def test_repeated_tail(spark):
    texts = ["", " ", "a", "a b  c\nd e f g h", " ".join(map(str, range(57)))]
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(400)] + [(None, "a b"), (3, None)], "doc_id long, text string")
    for r in rows.withColumn("made", periods.repeated_tail(F.col("doc_id"), F.col("text"))).collect():
        h, w = zlib.crc32(str(r.doc_id).encode()), (r.text or "").split()
        want = r.text
        if r.doc_id is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        assert r.made == want


def test_query_by_definition(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(["to", "be", "or", "not", "x"]) for _ in range(rnd.randrange(90)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        h, w = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = by_definition(w)
        assert got[i].n_runs == len(runs)
        assert got[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert got[i].collapsed_sha256 == hashlib.sha256(" ".join(collapsed(w, runs)).encode()).hexdigest()


def test_empty_table(spark):
    assert periods.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
