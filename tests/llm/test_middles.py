"""Cuts against plain slices, lists of boundaries against the boundaries."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import middles

ALL = ("n", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "restored_sha256")


def plain_cut(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(rows, given):
    assert len(rows) == len(given)
    for r in rows:
        text = given[r.key][1] or ""
        n, form, prefix, middle, output = plain_cut(given[r.key][0], text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
        assert r.restored == text and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(0, 3))
def test_units(text, repeat):
    text = text * repeat + "ab" * repeat
    starts = middles.unit_starts(np.frombuffer(text.encode(), np.uint8)).tolist()
    want, at = [], 0
    for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        want.append(at)
        at += len(unit.encode())
    assert starts == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=3000, unique=True), st.integers(1, 10**6))
def test_select(values, more):
    values = np.sort(np.array(values, np.int64))
    packed = middles.packed_list(values, int(values[-1]) + more if len(values) else 0)
    assert [middles.select(packed, k) for k in range(len(values))] == values.tolist()


def test_list_is_small():
    values = np.arange(0, 3_000_000, 3)
    packed = middles.packed_list(values, 3_000_000)
    assert sum(len(packed[c]) for c in ("low", "high", "ones")) * 8 < 4 * len(values)
    assert [middles.select(packed, k) for k in (0, 1, 511, 512, 123_456, 999_999)] == [0, 3, 1533, 1536, 370_368, 2_999_997]


def test_cuts(spark):
    rnd = random.Random(2)
    pool = [None, "", "a", "<", "x<P>y", "ends <S", "é<M", "one two\nthree 4,5", "ÄÖ日本 x" * 9, "<<<SPM>>>", "word " * 50_000]
    pool += ["".join(rnd.choice("ab <PSM>é\n") for _ in range(rnd.randrange(40))) for _ in range(60)]
    given = [(rnd.choice([None, *range(10**6, 10**6 + 500)]), rnd.choice(pool)) for _ in range(900)]
    df = spark.createDataFrame([(i, k, t, "clash") for i, (k, t) in enumerate(given)], "key long, doc_id long, text string, OUTPUT string")
    check(middles.fill_in_middle(df, outputs=ALL).collect(), given)


def test_hot_text_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(middles, "LEAST_BYTES", 1 << 12)
    given = [(i, "hot words stand here" if i % 3 else f"text {i}") for i in range(2000)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(given)], "key long, doc_id long, text string")
    assert [r["__deals"] > 1 for r in middles._large(df.selectExpr("unhex(sha2(text, 256)) as __digest", "text as __text")).collect()] == [True]
    check(middles.fill_in_middle(df, outputs=ALL).collect(), given)


def test_odd_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", {"k": "v"}, "x", "y")], "doc_id long, text string, m map<string,string>, `a.b` string, __text string")
    got = middles.fill_in_middle(df)
    assert got.columns == ["doc_id", "m", "a.b", "__text", "form", "output"] and got.first()["__text"] == "y"
    assert middles.fill_in_middle(df.limit(0)).collect() == []


def test_a_list_is_made_once_for_a_text(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(middles, "_boundaries", lambda text, f=middles._boundaries: made.append(len(text)) or f(text))
    work = middles._cut_texts(("output",))
    block = lambda texts: pa.record_batch({"__text": texts, "__digest": [t.encode() for t in texts], "__seeds": [[k, 3 * k] for k in range(len(texts))], "form": ["psm"] * len(texts)})
    assert len(work(block(["one two"] * 5 + ["x"] * 4))["output"]) == 9
    work(block(["x"] * 3 + ["y"]))
    assert made == [7, 1, 1]
