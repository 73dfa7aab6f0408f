"""Language-model scoring of whole texts with a gated recurrent model.

Tokens are words, A-Z lower-cased, and one end after each text. Counts of all training tokens give the base
score, a unigram probability with one added. The recurrent model predicts a token in two factors: its class, and
the word within the class. The most frequent words have classes of their own; all other words share one,
within which a word has its added-one share of the counts. So every word, known or not, has a probability.

1. Words are counted over all training texts, in tasks first; words of the same 64-bit hash count as one.
2. The frequent words (at most HEAD, by a threshold from a histogram of counts) are broadcast.
3. Each task trains the model on its own texts, set end to end, by truncated backpropagation from the same start; the tasks'
   parameters are averaged, weighted by tokens, in a tree of small groups.
4. Each text is scored from its first token to its last with the state carried on. Words that aren't among the
   frequent ones leave as rows and meet their counts in a join, so nothing that grows is broadcast.

All tasks start from the model after a warm start, so that their parameters stay close enough to be averaged: the
training texts of the lowest hashed doc_id, at most WARM of them and WARM_BYTES in all (a text that goes beyond that is
passed over here; it teaches its own task like all others). In training, state is carried along a lane of a block and
begins anew in the next block. What a task learns depends on its texts, so scores depend on how the table's files
split into tasks; on one split, reruns agree.

Null and empty texts consist of an end. Very long texts are scored whole, with the state carried to their end. Rows with a null doc_id are scored and learnt from like others. Without training rows
N and V are 0, and the model is the untrained one. Columns of the result replace columns of the same name; all
others are kept. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import gru
from docweave.llm.blocks import add_columns, blocks, hash_spans, lower, raw, word_bounds
from docweave.session import cut

#: Words with classes of their own, frequent words that are broadcast, texts and bytes of the warm start, rows averaged at once.
WORDS, HEAD, WARM, WARM_BYTES, FAN = 2048, 262_144, 1500, 16 << 20, 8
TEXT_BYTES, SCORE_BYTES = 1 << 20, 8 << 20
#: Distinct words that a task holds before it hands its counts on.
HELD = 2_000_000
END = np.uint64(0x9E3779B97F4A7C15)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text begins."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in blocks(texts, TEXT_BYTES):
        data, at = raw(texts.slice(low, high - low))
        data = lower(data)
        start, end, row = word_bounds(data, at)
        size = np.bincount(row, minlength=high - low) + 1
        out = np.full(int(size.sum()), END)
        out[np.arange(len(row)) + row] = hash_spans(data, start, end)
        parts.append(out)
        sizes.append(size)
    size = np.concatenate(sizes)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n[order], first) if len(first) else n


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c) of every distinct token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "c"])
        held: list = []
        for batch in batches:
            for low, high in blocks(batch.column(0), SCORE_BYTES):
                h, n = np.unique(tokens(batch.column(0).slice(low, high - low))[0], return_counts=True)
                held.append((h, n))
                if sum(len(x) for x, _ in held) > HELD:
                    h, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = [(h, n)]
                    if len(h) > HELD // 2:
                        yield out(h, n)
                        held = []
        if held:
            yield out(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count that leaves no more than `most` words, and those words by falling count."""
    level = F.floor(F.log2("c") * 64).cast("long").alias("level")
    least, total = 2**62, 0
    for r in counts.groupBy(level).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("level")).collect():  # 64 rows at most for each doubling
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    got = counts.where(F.col("c") >= least).select("h", "c").toPandas()
    h, c = got["h"].to_numpy(np.int64).view(np.uint64), got["c"].to_numpy(np.int64)
    order = np.lexsort((h, -c))
    return least, h[order], c[order]


class Facts:
    """What all tasks need of the counts: the frequent words, sorted, and the sums."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int):
        order = np.argsort(h)
        self.h, self.c, self.total, self.distinct = h[order], c[order], total, distinct
        own = np.sort(np.lexsort((h, -c))[:WORDS])
        if len(h) and END in h and END not in h[own]:
            own[-1] = int(np.flatnonzero(h == END)[0])
        self.vocabulary = gru.Vocabulary(h[own], c[own])
        #: log10 of the sum of added-one counts of the words without a class of their own, and of one unseen word.
        self.rest = float(np.log10(total - int(c[own].sum()) + distinct - len(own) + 1))

    def counts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token, and which of them are among the frequent words."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        words, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, words), len(self.h) - 1)
        known = self.h[at] == words
        return np.where(known, self.c[at], 0)[back], known[back]

    def prepared(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input rows, target ids, and where texts begin."""
        target, rows = self.vocabulary.ids(h)
        inp = np.concatenate([[self.vocabulary.begin], rows[:-1]])
        inp[first] = self.vocabulary.begin
        begins = np.zeros(len(h), bool)
        begins[first] = True
        return inp, target, begins


def averaged(parts: DataFrame) -> bytes | None:
    """The mean of the tasks' parameters (part, weight, packed), FAN rows at a time."""

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # sums in one order, so that reruns agree
        weight = group["weight"].to_pylist()
        packed = gru.mean(group["packed"].to_pylist(), weight)
        return pa.table({"part": pa.array([group["part"][0].as_py() // FAN], pa.int64()), "weight": pa.array([float(sum(weight))]), "packed": pa.array([packed], pa.binary())})

    parts = cut(parts)
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(merge, "part long, weight double, packed binary")
        n = -(-n // FAN)
    got = parts.select("packed").take(1)
    return bytes(got[0].packed) if got else None


def train(docs: DataFrame, text_col: str, facts: Facts, start: bytes | None) -> DataFrame:
    """(part, weight, packed): each task's parameters after its texts."""
    held = docs.sparkSession.sparkContext.broadcast((facts, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, start = held.value
        model, seen, part = gru.Model(facts.vocabulary), 0, 0
        if start is not None:
            model.load(start)
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
            for low, high in blocks(batch.column(0), 2 * TEXT_BYTES):
                h, first = tokens(batch.column(0).slice(low, high - low))
                model.train(*facts.prepared(h, first))
                seen += len(h)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([model.packed()], pa.binary())], names=["part", "weight", "packed"])

    return docs.select(text_col, F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "part long, weight double, packed binary")


def warm_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """text of the warm start, chosen by ids and sizes alone, so that no task gathers texts that aren't taken."""
    first = docs.where("doc_id is not null").select("doc_id", F.octet_length(F.coalesce(text_col, F.lit(""))).alias("size"))
    ids, total = [], 0
    for r in first.groupBy("doc_id").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM).collect():
        if total + r["size"] <= WARM_BYTES:
            ids.append((r["doc_id"],))
            total += r["size"]
    chosen = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)]))
    texts = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # WARM ids at most
    return texts.groupBy("doc_id").agg(F.max("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text")


LOCAL = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("__model", T.DoubleType()),
    T.StructField("__rare", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.LongType())]))),
])


def score(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens, n_known, train_tokens, base_score and score (log10). learn: which rows to learn from."""
    spark = docs.sparkSession
    learning = docs.where(F.coalesce(learn, F.lit(True)))
    counts = cut(count_words(learning, text_col))
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    least, h, c = frequent(counts, HEAD)
    facts = Facts(h, c, total, distinct)
    start = averaged(train(warm_texts(learning, text_col).coalesce(1), "text", facts, None))
    packed = averaged(train(learning, text_col, facts, start))
    held = spark.sparkContext.broadcast((facts, packed))

    def make():
        facts, packed = held.value
        model = gru.Model(facts.vocabulary)
        if packed is not None:
            model.load(packed)

        def work(texts: pa.Array) -> dict:
            h, first = tokens(texts)
            inp, target, _ = facts.prepared(h, first)
            count, known = facts.counts(h)
            plain = np.log10(count + 1.0)
            own = model.score(inp, target, first)
            other = target == facts.vocabulary.n
            own[other] += plain[other] - facts.rest
            text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            word, t = h[~known], text[~known]
            order = np.lexsort((word, t))
            word, t = word[order], t[order]
            one = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (t[1:] != t[:-1]))) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.append(one, len(word)))
            edge = np.searchsorted(t[one], np.arange(len(first) + 1))
            rare = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(word[one].view(np.int64)), pa.array(times, pa.int64())], names=["h", "n"]))
            add = lambda x: np.add.reduceat(x, first)
            return {"n_tokens": add(np.ones(len(h), np.int64)), "__known": add((count > 0).astype(np.int64)), "__base": add(plain), "__model": add(own), "__rare": rare}

        return work

    names = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [c for c in docs.columns if c.lower() not in names and c != text_col]
    local = add_columns(docs.select(*kept, text_col), text_col, make, LOCAL, drop=(text_col,), limit=SCORE_BYTES)
    rows = cut(local.withColumn("__row", F.monotonically_increasing_id()))
    rare = rows.select("__row", F.explode("__rare").alias("r")).select("__row", "r.h", "r.n").join(counts.where(F.col("c") < least), "h")
    sums = rare.groupBy("__row").agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("__sum"))
    more = F.coalesce("__sum", F.lit(0.0))
    return rows.join(sums, "__row", "left").select(
        *kept,
        "n_tokens",
        (F.col("__known") + F.coalesce("__n", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__base") + more - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("__model") + more).alias("score"),
    )
