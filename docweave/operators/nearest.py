"""Exact nearest rows of a set of queries: blocks of rows and of queries meet as matrices, and only the best k of each block come out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and queries of a block.
ROWS, QUERIES = 16_384, 2_048


def _unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
    v = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def nearest(points: DataFrame, asks: Column, k: int) -> DataFrame:
    """query, id, score, rank: for each point for which `asks` holds, the k others of the highest cosine; of equals, the least id. points: id, vector, all of one length."""
    asked = points.where(asks)
    n_rows, n_asked = points.count(), asked.count()
    high, wide = max(1, -(-n_rows // ROWS)), max(1, -(-n_asked // QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = points.select("id", "vector", own(high).alias("i"), spread(wide).alias("j"), F.lit(False).alias("asks"))
    questions = asked.select("id", "vector", spread(high).alias("i"), own(wide).alias("j"), F.lit(True).alias("asks"))

    def best(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy()
        q, r = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        empty = {"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if not q.num_rows or not r.num_rows:
            return pa.table(empty)
        ids, rows = r["id"].to_numpy(), _unit(r["vector"], r.num_rows)
        order = np.argsort(ids)
        ids, rows = ids[order], rows[order]
        out = []
        for low in range(0, q.num_rows, 256):
            part = q.slice(low, 256)
            name = part["id"].to_numpy()
            score = np.round(_unit(part["vector"], part.num_rows) @ rows.T, 9)
            score[name[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            out.append((np.repeat(name, top.shape[1]), ids[top].ravel(), np.take_along_axis(score, top, 1).ravel()))
        query, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
        real = np.isfinite(score)
        return pa.table({"query": query[real], "id": found[real], "score": score[real]})

    parts = rows.union(questions).groupBy("i", "j").applyInArrow(best, "query long, id long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
