"""Quality rules with an isolation forest over their statistics.

Every text gets statistics such as repeated lines, symbols and upper case. A forest of random axis-parallel
splits is drawn over the range of all labelled rows, and all good ones among them are counted in its cells; a
document that is soon alone, in a cell without good rows, has a short path and is an anomaly. The score that
parts kept from rejected documents is calibrated on all good and bad labelled rows.

Null and empty texts have no words and fail the base rules. Very long texts are counted whole, each as a block of its own. A
document at the threshold itself is kept. Of a labelled doc_id that comes with several texts, the least statistics teach. Rows with a null doc_id are scored like others.
Labels that are null, or whose document is missing, teach nothing; with no usable labels only the base rules
reject. Columns of the result replace columns of the same name; all others are kept. Repeated rows give
repeated results, an empty table an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.blocks import BLOCK_ROWS, SPACE, add_columns, hash_spans, mix, raw, word_bounds
from docweave.session import cut

TREES, TREE_ROWS, DEPTH = 128, 256, 8
#: Cells of a tree: inner ones and leaves.
NODES = 2 ** (DEPTH + 1) - 1
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "marks", "stutter")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _UPPER = _table("#*$%&|<>"), _table("!?"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def within(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only if key and row are."""
    return mix(key + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def repeated(key: np.ndarray) -> np.ndarray:
    """Which of the keys are there twice or more."""
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True values of each row."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[at[1:]] - total[at[:-1]]


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics, and the rows x FEATURES matrix: shares, on a logarithmic scale that sets the smallest apart from none."""
    data, at = raw(texts)
    n = len(at) - 1
    start, end, row = word_bounds(data, at)
    word = hash_spans(data, start, end)
    n_words = np.bincount(row, minlength=n)
    point = (data & 0xC0) != 0x80
    solid = ~SPACE[data]
    word_chars = _sums(point & solid, at)
    n_symbols = _sums(_SYMBOL[data], at)
    # lines: spans between line feeds and row ends, as far as they hold a word
    edge = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, at]))
    low, high = edge[:-1], edge[1:]
    high = high - (data[high - 1] == 10)
    filled = np.concatenate([[0], np.cumsum(solid)])
    full = filled[high] > filled[low]
    low, high = low[full], high[full]
    line_row = np.searchsorted(at[1:], low, "right")
    line = within(hash_spans(data, low, high), line_row)
    n_lines = np.bincount(line_row, minlength=n)
    n_dup_lines = n_lines - np.bincount(line_row[np.unique(line, return_index=True)[1]], minlength=n)
    # words in windows that come again
    first = np.flatnonzero(row[: max(0, len(row) - WINDOW + 1)] == row[WINDOW - 1 :])
    window = np.zeros(len(first), np.uint64)
    for j in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + word[first + j]
    again = first[repeated(within(window, row[first]))]
    covered = np.zeros(len(row) + 1, np.int64)
    covered[again] += 1
    covered[again + WINDOW] -= 1
    n_repeat_words = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    stutter = np.flatnonzero((word[1:] == word[:-1]) & (row[1:] == row[:-1])) + 1
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    shares = np.stack([
        n_symbols / words, n_dup_lines / np.maximum(n_lines, 1), n_repeat_words / words,
        _sums(_UPPER[data], at) / chars, _sums(_MARK[data], at) / words, np.bincount(row[stutter], minlength=n) / words,
    ], axis=1)
    return dict(zip(BASE, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True)), np.log1p(50 * shares)


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over the box from low to high, as a complete binary heap: feature (-1 at a leaf), split, and at leaves the path length."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, split, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    open_ = {0: (rows, low, high)}
    for node in range(nodes):
        if node not in open_:
            continue
        x, low, high = open_.pop(node)
        depth = (node + 1).bit_length() - 1
        if depth == DEPTH or not len(x):
            path[node] = depth + average_path(len(x))
            continue
        f = int(rng.integers(len(low)))
        feature[node], split[node] = f, rng.uniform(low[f], high[f])
        below, edge = x[:, f] < split[node], np.where(np.arange(len(low)) == f, split[node], np.nan)
        open_[2 * node + 1] = x[below], low, np.where(np.isnan(edge), high, edge)
        open_[2 * node + 2] = x[~below], np.where(np.isnan(edge), low, edge), high
    return {"feature": feature, "split": split, "path": path}


def average_path(n: int) -> float:
    """Mean depth of a row in a random search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    def __init__(self, rows: np.ndarray, good: np.ndarray, seed: int = 11):
        rng, low, high = np.random.default_rng(seed), rows.min(0), rows.max(0)
        rows = rows[good]
        size = min(TREE_ROWS, len(rows))
        trees = [grow(rows[rng.choice(len(rows), size, replace=False)], low, high, rng) for _ in range(TREES)]
        self.feature, self.split, self.path = (np.stack([t[k] for t in trees]) for k in ("feature", "split", "path"))
        self.scale = max(average_path(size), 1e-9)

    @classmethod
    def shaped(cls, low: np.ndarray, high: np.ndarray, seed: int = 11) -> Forest:
        """Splits of the whole depth over the box from low to high, without rows yet."""
        self, rng = cls.__new__(cls), np.random.default_rng(seed)
        self.feature, self.split, self.path, self.scale = np.full((TREES, NODES), -1), np.zeros((TREES, NODES)), np.zeros((TREES, NODES)), 1.0
        for tree in range(TREES):
            boxes = {0: (low, high)}
            for node in range(NODES // 2):
                low_, high_ = boxes.pop(node)
                f = int(rng.integers(len(low)))
                at = rng.uniform(low_[f], high_[f])
                self.feature[tree, node], self.split[tree, node] = f, at
                edge = np.arange(len(low)) == f
                boxes[2 * node + 1], boxes[2 * node + 2] = (low_, np.where(edge, at, high_)), (np.where(edge, at, low_), high_)
        return self

    def filled(self, held: dict[int, int], total: int) -> Forest:
        """The same splits with `held` rows (tree * NODES + leaf: rows) of `total`: an empty cell ends its path, a leaf's goes on as its rows would split."""
        out, n = Forest.__new__(Forest), np.zeros((TREES, NODES), np.int64)
        for cell, rows in held.items():
            n[cell // NODES, cell % NODES] = rows
        for node in range(NODES // 2 - 1, -1, -1):
            n[:, node] = n[:, 2 * node + 1] + n[:, 2 * node + 2]
        depth = np.array([(node + 1).bit_length() - 1 for node in range(NODES)])
        out.feature, out.split = np.where(n > 0, self.feature, -1), self.split
        out.path = depth + np.vectorize(average_path, otypes=[float])(np.where(depth == DEPTH, n, 0))
        out.scale = max(average_path(total), 1e-9)
        return out

    def cells(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each tree where a row's walk ends."""
        tree, node = np.arange(TREES)[None, :], np.zeros((len(rows), TREES), np.int64)
        at = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            f = self.feature[tree, node]
            go = 2 * node + 1 + (rows[at, np.maximum(f, 0)] >= self.split[tree, node])
            node = np.where(f >= 0, go, node)
        return node

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for anomalies."""
        return 2.0 ** (-self.path[np.arange(TREES)[None, :], self.cells(rows)].mean(1) / self.scale)


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The score above which documents are rejected: the share of bad rows rejected less ten times the share of
    good ones is highest there. It lies in the middle of the gap between two rows' scores."""
    if not good.any() or good.all():
        return 1.0
    order = np.argsort(score)
    s, g = score[order], good[order]
    bad_above = (~g)[::-1].cumsum()[::-1] / (~g).sum()
    good_above = g[::-1].cumsum()[::-1] / g.sum()
    gain = np.append(bad_above - 10 * good_above, 0.0)
    gain[1:-1][s[1:] == s[:-1]] = -np.inf
    i = int(np.argmax(gain))
    return 1.0 if i == len(s) else float((s[i] + s[max(i - 1, 0)]) / 2)


#: Cells that scores between 0 and 1 are summed by first, so that no task sorts all of them.
CELLS = 4096


def threshold_of(scored: DataFrame) -> float:
    """`threshold` of a table (score, good) of any length: sums over cells of the scores, then inside a cell."""
    each = scored.groupBy("score").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("fine")).withColumn("cell", F.floor(F.col("score") * CELLS))
    each = cut(each)
    total = each.agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).first()
    if not total.bad or not total.fine:
        return 1.0
    inside = W.partitionBy("cell").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)  # over CELLS + 1 rows at most
    cells = each.groupBy("cell").agg(F.sum("bad").alias("b"), F.sum("fine").alias("f"), F.max("score").alias("top"))
    cells = cells.select("cell", F.coalesce(F.sum("b").over(after), F.lit(0)).alias("bad_after"), F.coalesce(F.sum("f").over(after), F.lit(0)).alias("fine_after"), F.lag("top").over(W.orderBy("cell")).alias("top_below"))
    rows = each.join(F.broadcast(cells), "cell")
    gain = (F.sum("bad").over(inside) + F.col("bad_after")) / F.lit(total.bad) - 10 * ((F.sum("fine").over(inside) + F.col("fine_after")) / F.lit(total.fine))
    below = F.coalesce(F.lag("score").over(W.partitionBy("cell").orderBy("score")), "top_below", "score")
    best = rows.select(gain.alias("gain"), "score", below.alias("below")).orderBy(F.col("gain").desc(), "score").first()
    return 1.0 if best.gain < 0 else (best.score + best.below) / 2


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> tuple[Forest | None, float]:
    """The forest and its threshold, from all labelled rows: the box of its splits, the good rows of its cells and the threshold are counted over all of them."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    schema = T.StructType([T.StructField("features", T.ArrayType(T.DoubleType()))])
    every = add_columns(docs.select("doc_id", F.col(text_col).alias("text")), "text", lambda: lambda block: {"features": list(statistics(block)[1])}, schema, drop=("text",))
    rows = every.where("doc_id is not null").groupBy("doc_id").agg(F.min("features").alias("features")).join(usable.hint("merge"), "doc_id")  # labels may be as many as documents: never broadcast
    rows = cut(rows.select("features", (F.col("quality") == 1).alias("good")))
    edges = rows.agg(*[f(F.col("features")[k]) for f in (F.min, F.max) for k in range(len(FEATURES))], F.count_if("good").alias("n")).first()
    if not edges.n:
        return None, 1.0
    forest = Forest.shaped(np.array(edges[: len(FEATURES)]), np.array(edges[len(FEATURES) : -1]))
    sc = docs.sparkSession.sparkContext
    shape = sc.broadcast(forest)

    def counts(batches):
        seen = np.zeros(forest_cells, np.int64)
        for good, node in _walked(batches, lambda x: shape.value.cells(x)):
            seen += np.bincount((np.arange(TREES) * NODES + node[good]).ravel(), minlength=forest_cells)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["cell", "n"])

    forest_cells = TREES * NODES
    held = rows.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # TREES * NODES rows at most
    forest = forest.filled({r.cell: r.n for r in held}, edges.n)
    full = sc.broadcast(forest)

    def scores(batches):
        for good, score in _walked(batches, lambda x: full.value.score(x)):
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(good)], names=["score", "good"])

    return forest, threshold_of(rows.mapInArrow(scores, "score double, good boolean"))


def _walked(batches, of):
    """good and of(features), a block of rows at a time."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(part), len(FEATURES))
            yield part.column("good").to_numpy(zero_copy_only=False), of(x)


def judge(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the base statistics, base_failed, score of the forest, and kept."""
    forest, limit = fit(docs, labels, text_col)
    added = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        def work(block: pa.Array) -> dict:
            base, x = statistics(block)
            score = held.value.score(x) if held.value is not None else np.zeros(len(x))
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            return base | {"base_failed": failed, "score": score, "kept": ~failed & (score <= limit)}

        return work

    return add_columns(docs, text_col, make, added)
