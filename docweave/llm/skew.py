"""Joins of many rows with one row for each key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than this share of an average partition's rows, and with more than LEAST rows, which are about a megabyte.
SHARE, LEAST = 0.25, 1 << 16


def heavy_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """(key, __salts) of the heavy keys of `counts` (key, n), and in how many parts to deal each; None without any. As each
    holds more than 1 / (4 * partitions) of all rows, there are fewer than 4 * partitions of them: that bounds what is broadcast."""
    spark = counts.sparkSession
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(LEAST, int((total or 0) * SHARE / int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= limit:
        return None
    return counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__salts"))


def star_join(many: DataFrame, one: DataFrame, key: str, by: str, counts: DataFrame, rows: int | None = None) -> DataFrame:
    """Inner join of `many` with `one`, which has a row a key at most; a heavy key's rows are dealt by `by`, and its one row is repeated for each deal. counts: (key, n). rows: how many `many` has, if that is known; few rows have no heavy key."""
    heavy = None if rows is not None and rows <= LEAST else heavy_keys(counts, key)
    if heavy is None:
        return many.join(one, key)
    heavy, salts = F.broadcast(heavy), F.coalesce("__salts", F.lit(1))
    dealt = many.join(heavy, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("__salts")
    repeated = one.join(heavy, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")
