"""Runs of periodic words: stretches in which a group of words is said again and again.

A run is a stretch of words with smallest period q (words q apart are identical) and of max(6, 4 * q) words or more,
which no neighbouring word extends. For each period p the words at jp and (j + 1)p are compared: the harmonic grid,
n / p points for a period, n log n in all. As a run holds four periods, three such pairs in a row are alike in it; where
they are, words between the grid's points are tried, and what survives is extended to both sides by comparing arrays in
chunks. Points inside a run already found, of this period or of one that divides it, are skipped.

The texts of a block are searched together, the longest first, so that for period p only those of 4p words and more are
looked at. Words are compared as dictionary codes of their bytes, so equal codes are equal words.

Null and empty texts have no words, no runs and null for the strongest run; a text without a run keeps all its words.
Repeated rows give repeated results, an empty table an empty one. Columns of the result replace columns of the same name.
Of runs with equal exponents the first is the strongest, then the one of the shorter period.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns, raw, word_bounds

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared at first by an extension, and at most in one step.
FIRST_CHUNK, LAST_CHUNK = 64, 1 << 16

#: What an output column holds. start to exponent_milli are those of the run of most periods.
OUTPUTS = {
    "n_runs": T.LongType(),
    "start": T.LongType(),
    "length": T.LongType(),
    "period": T.LongType(),
    "exponent_milli": T.LongType(),
    "runs": T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])),
    "runs_sha256": T.StringType(),
    "collapsed": T.StringType(),
    "collapsed_sha256": T.StringType(),
}


def _left(seq: np.ndarray, at: int, p: int) -> int:
    """The least s so that seq[i] = seq[i + p] for s <= i < at."""
    chunk = FIRST_CHUNK
    while True:
        low = max(0, at - chunk)
        off = np.flatnonzero(seq[low:at] != seq[low + p : at + p])
        if len(off):
            return low + int(off[-1]) + 1
        if low == 0:
            return 0
        at, chunk = low, min(2 * chunk, LAST_CHUNK)


def _right(seq: np.ndarray, at: int, p: int) -> int:
    """The least x >= at so that seq[x] differs from seq[x + p]; the last code of seq is like no other."""
    chunk = FIRST_CHUNK
    while True:
        far = seq[at + p : at + p + chunk]
        off = np.flatnonzero(seq[at : at + len(far)] != far)
        if len(off):
            return at + int(off[0])
        at, chunk = at + len(far), min(2 * chunk, LAST_CHUNK)


def _survivors(seq: np.ndarray, p: int, end: int, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Grid points of seq[:end] from which three pairs in a row, and words between them, are alike, no pair inside a found run of a period that divides p."""
    grid = seq[:end:p]
    same = grid[1:] == grid[:-1]
    at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
    for d in sorted({p // 2, p // 3, 2 * p // 3, *range(1, min(p, 8))} - {0}):
        if not len(at):
            return at
        x = at + d
        at = at[(seq[x] == seq[x + p]) & (seq[x + p] == seq[x + 2 * p])]
    for q, (starts, ends) in found.items():
        for x in (0, p, 2 * p) if p % q == 0 else ():  # a run that has none of the found run's period shares fewer than p words with it
            k = np.searchsorted(starts, at + x, "right") - 1
            at = at[(k < 0) | (ends[k] <= at + x + p)]
    return at


def periodic_runs(codes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each row, by start and period; row r has the codes first[r] to first[r + 1]."""
    rows, size = len(first) - 1, np.diff(first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= LEAST_WORDS]
    if not len(order):
        return out
    size = size[order]
    begins = 1 + np.concatenate([[0], np.cumsum(size + 1)])  # a code like no other stands before each row and at the end
    seq = np.empty(int(begins[-1]), np.int64)
    seq[begins - 1] = -1 - np.arange(len(begins))
    for r, b, n in zip(order.tolist(), begins.tolist(), size.tolist()):
        seq[b : b + n] = codes[first[r] : first[r] + n]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for p in range(1, int(size[0]) // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * p)
        end = int(begins[np.searchsorted(-size, -least, "right")])
        starts, ends, done = [], [], -1
        for at in _survivors(seq, p, end, found).tolist():
            if at <= done - p:
                continue
            low = _left(seq, at, p)
            done = _right(seq, at, p) + p
            if done - low >= least:
                starts.append(low)
                ends.append(done)
        if starts:
            found[p] = np.array(starts), np.array(ends)
            for low, high, k in zip(starts, ends, np.searchsorted(begins, starts, "right") - 1):
                out[order[k]].append((low - int(begins[k]), high - low, p))
    for runs in out:
        runs.sort(key=lambda x: (x[0], x[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; the first of these, then that of the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a block of texts, one after the other, and where each row's begin."""
    data, at = raw(texts)
    start, end, row = word_bounds(data, at)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1]) > 0])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(row, np.arange(len(at)))


def find_runs(docs: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = ("runs",)) -> DataFrame:
    """`docs` with the asked-for OUTPUTS of each text: its runs, and the text with each run collapsed to its first period."""
    asked = set(outputs)
    added = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs])

    def work(texts: pa.Array) -> dict:
        words, first = _words(texts)
        found = periodic_runs(words.dictionary_encode().indices.to_numpy(), first)
        made: dict = {"n_runs": [len(runs) for runs in found], "runs": [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]}
        best = [strongest(runs) or (None, None, None) for runs in found]
        made |= {c: [b[k] for b in best] for k, c in enumerate(("start", "length", "period"))}
        made["exponent_milli"] = [None if q is None else 1000 * n // q for _, n, q in best]
        made["runs_sha256"] = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest() for runs in found]
        if asked & {"collapsed", "collapsed_sha256"}:
            inside = np.zeros(len(words) + 1, np.int64)
            for low, runs in zip(first.tolist(), found):
                for s, n, q in runs:
                    inside[low + s + q] += 1
                    inside[low + s + n] -= 1
            kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, first), pa.int32()), words.take(pa.array(kept)))
            joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).to_pylist()
            made["collapsed"] = [x.decode() for x in joined] if "collapsed" in asked else None
            made["collapsed_sha256"] = [hashlib.sha256(x).hexdigest() for x in joined]
        return made

    return add_columns(docs, text_col, lambda: work, added)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document with its last words put round in a circle, all others as they are.

    With h the CRC-32 of the decimal doc_id, g = floor(h / 10), and n words: if h % 10 = 0, each word i >= a = g % n becomes
    word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), and words are joined by one space. A null doc_id or text
    and a text without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.transform(F.array(words), turned)[0]).otherwise(text)
