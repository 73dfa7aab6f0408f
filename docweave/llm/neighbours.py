"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed byte trigrams and hashed trigrams of character classes (square roots of their shares, times
inverse document frequency over all documents), how often its word trigrams come again, and six statistics of
repetition and junk. A singular value decomposition of the terms of a bounded labelled sample gives the latent
space. The sample's vectors and the projection are broadcast, being of fixed size; every document's vector is
multiplied with all of them, block by block, and the K most similar rows vote with their labels, weighted by a
power of the cosine. Rows that tie for the last places share them.

Null and empty texts have only zero terms and get the labels' mean. Very long texts are scored whole, each as a block of its
own. Labels that are null or whose document is missing teach nothing; without usable labels every score is 0.5. A
label given more than once counts once, at its lowest. Columns of the result replace columns of the same name; all
others are kept. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns, blocks, hash_spans, mix, raw, word_bounds
from docweave.llm.rules import FEATURES, statistics

#: Most labelled rows that vote, latent dimensions, voters, power of the cosine.
SAMPLE, SPACE, K, POWER = 4096, 64, 25, 4
#: Terms of each kind: byte trigrams, trigrams of character classes, word trigrams by how often they come.
TERMS, SHAPES, AGAIN = 2048, 512, 7
#: Weights of byte trigrams, class trigrams, recurrences and statistics.
LETTERS, KINDS, RETURNS, STYLE = 1.0, 0.5, 0.5, 0.35
#: Bytes and rows of a block, rows multiplied at once.
BLOCK, ROWS, ONCE = 1 << 18, 512, 128

#: Character classes: small letters, capitals, digits; other ASCII bytes as they are.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def _trigrams(x: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Rows x 2 ** bits counts of hashed trigrams within each row."""
    n, size = len(at) - 1, 1 << bits
    if len(x) < 3:
        return np.zeros((n, size), np.float32)
    h = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - bits)
    row = np.repeat(np.arange(n), np.diff(at))
    whole = row[:-2] == row[2:]
    cell = (row[:-2] * size + h)[whole]
    return np.bincount(cell, minlength=n * size).astype(np.float32).reshape(n, size)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows x TERMS and rows x SHAPES counts of byte and class trigrams."""
    data, at = raw(texts)
    return _trigrams(data.astype(np.uint32), at, TERMS.bit_length() - 1), _trigrams(_CLASS[data], at, SHAPES.bit_length() - 1)


def recurrences(texts: pa.Array) -> np.ndarray:
    """Rows x AGAIN: shares of the word trigrams that the text holds twice, three times, ... AGAIN + 1 times or more."""
    data, at = raw(texts)
    n = len(at) - 1
    start, end, row = word_bounds(data, at)
    out = np.zeros((n, AGAIN + 1), np.float32)
    if len(row) > 2:
        h = hash_spans(data, start, end)
        first = np.flatnonzero(row[:-2] == row[2:])
        own = row[first].astype(np.uint64)
        key = mix(h[first] * np.uint64(3) + h[first + 1] * np.uint64(5) + h[first + 2] + own * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        np.add.at(out, (row[first], np.minimum(times[back], AGAIN + 1) - 1), 1)
    return (out / np.maximum(out.sum(1, keepdims=True), 1))[:, 1:]


def terms(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted terms: both kinds of trigrams, each of unit length, recurrences and statistics beside them."""
    parts = []
    for count, weight, size in zip(counted(texts), (idf[:TERMS], idf[TERMS:]), (LETTERS, KINDS), strict=True):
        part = np.sqrt(count / np.maximum(count.sum(1, keepdims=True), 1)) * weight
        parts.append(size * part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9))
    return np.hstack([*parts, RETURNS * np.sqrt(recurrences(texts)), STYLE * statistics(texts)[1].astype(np.float32)])


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(TERMS + SHAPES, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for low, high in blocks(texts, BLOCK, ROWS):
                df += np.concatenate([(c > 0).sum(0) for c in counted(texts.slice(low, high - low))])
                n += high - low
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], names=["term", "n"])

    got = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + SHAPES + 1, np.int64)
    for r in got:
        df[r.term + 1] = r.n
    return int(df[0]), df[1:]


class Voters:
    """Latent space and labelled vectors."""

    def __init__(self, x: np.ndarray, label: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        basis = x.T @ (x @ rng.standard_normal((x.shape[1], min(SPACE + 16, x.shape[0]))).astype(np.float32))
        for _ in range(2):  # subspace iteration
            basis = x.T @ (x @ np.linalg.qr(basis)[0])
        basis = np.linalg.qr(basis)[0]
        _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
        self.project = (basis @ right.T)[:, :SPACE].astype(np.float32)
        self.label = label.astype(np.float32)
        self.vectors = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._score(x[i : i + ONCE]) for i in range(0, len(x), ONCE)]) if len(x) else np.zeros(0)

    def _score(self, x: np.ndarray) -> np.ndarray:
        close = np.round(self.latent(x) @ self.vectors.T, 6)  # equal vectors tie whatever the block
        k = min(K, close.shape[1])
        last = -np.partition(-close, k - 1, axis=1)[:, k - 1 : k]
        above, tied = close > last, close == last
        share = above + tied * ((k - above.sum(1, keepdims=True)) / tied.sum(1, keepdims=True))
        power = share * np.maximum(close, 0).astype(np.float64) ** POWER
        total = power.sum(1)
        return np.where(total > 0, np.clip(power @ self.label / np.maximum(total, 1e-12), 0, 1), self.label.mean())


def vote(docs: DataFrame, labels: DataFrame, text_col: str = "text", label: str = "quality", learn: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """`docs` with score: the likelihood, by vote, that `label` is 1.

    labels: doc_id and the label. Only rows for which `learn`, a condition on doc_id, holds may vote; of these
    the `sample` rows of the lowest hashed doc_id do. All documents count for the document frequencies.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (learn if learn is not None else F.lit(True)))
    chosen = known.groupBy("doc_id").agg(F.min(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # of at most `sample` rows
    n, df = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1

    def pack():
        return lambda block: {"terms": [r.tobytes() for r in terms(block, idf).astype(np.float16)]}

    rows = add_columns(texts, "text", pack, T.StructType([T.StructField("terms", T.BinaryType())]), drop=("text",), limit=BLOCK, rows=ROWS)
    got = rows.groupBy("doc_id").agg(F.max("terms").alias("terms"), F.min("label").alias("label")).orderBy("doc_id").collect()
    voters = None
    if got:
        x = np.frombuffer(b"".join(bytes(r.terms) for r in got), np.float16).reshape(len(got), TERMS + SHAPES + AGAIN + len(FEATURES)).astype(np.float32)
        voters = Voters(x, np.array([r.label == 1 for r in got]))
    held = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        def work(block: pa.Array) -> dict:
            if held.value is None:
                return {"score": np.full(len(block), 0.5)}
            return {"score": held.value.score(terms(block, idf))}

        return work

    return add_columns(docs, text_col, make, T.StructType([T.StructField("score", T.DoubleType())]), limit=BLOCK, rows=ROWS)
