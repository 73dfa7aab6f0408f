"""A keyed table on files: rows lie in folders by a hash of their key, and a write touches the folders of its keys only.

A write reads the old rows of the buckets that its keys fall in, makes the new ones, and overwrites just these partitions
(dynamic partition overwrite: Spark stages the files and moves them when all tasks are done). The number of a batch that
was written is kept beside the rows, so that a batch which comes again changes no file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators import upserts
from docweave.session import cut

BUCKET = "__bucket"


class KeyedTable:
    """Rows of `schema` under `path`, one for each value of `keys`; a null in a key is a value like others.

    group: those of the keys whose hash says the bucket (all, if not given), so that rows of one group lie together.
    buckets: as many that one of them fits a task; the number is fixed for a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], group: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.group, self.buckets = spark, path, keys, group or keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.group), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _stored(self) -> DataFrame:
        """All rows with their buckets. Partitions are found by listing, when this is called."""
        whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not self.exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def rows_of(self, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; other folders aren't opened."""
        return self._stored().where(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of `rows` fall in: `buckets` numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def overwrite(self, buckets: list[int], rows: DataFrame) -> None:
        """Put `rows`, a written table, in place of all that these buckets hold; those left without rows go."""
        filled = self.buckets_of(rows)
        if filled:
            placed = rows.select(*self.schema.names).withColumn(BUCKET, self.bucket()).repartition(len(filled), BUCKET)
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/rows")
        for b in sorted(set(buckets) - set(filled)):
            self.remove(f"{self.path}/rows/{BUCKET}={b}")

    def written(self, batch: str) -> bool:
        return self.exists(f"{self.path}/batches/{batch}")

    def mark(self, batch: str) -> None:
        fs, p = self._fs(f"{self.path}/batches/{batch}")
        fs.create(p, True).close()

    def unmark(self, batch: str) -> None:
        self.remove(f"{self.path}/batches/{batch}")

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame], batch: str | None = None) -> list[int]:
        """Put make(old rows) in place of the rows of the buckets that `keys` fall in; the buckets written. A `batch` that was written before isn't written again."""
        if batch is not None and self.written(batch):
            return []
        buckets = self.buckets_of(keys)
        if buckets:
            self.overwrite(buckets, cut(make(self.rows_of(buckets)).select(*self.schema.names)))
        if batch is not None:
            self.mark(batch)
        return buckets

    # ── the writes ──

    def upsert(self, new: DataFrame, batch: str | None = None) -> list[int]:
        """Rows of new keys are added, those of old keys replaced. Of several new rows of a key the greatest stays, by all its columns."""
        one = self.last_of_key(new)
        return self.change(one, lambda old: upserts.upserted(old, one, self.keys), batch)

    def insert_missing(self, new: DataFrame, batch: str | None = None) -> list[int]:
        """Rows of keys that aren't there yet are added."""
        one = self.last_of_key(new)
        return self.change(one, lambda old: upserts.inserted(old, one, self.keys), batch)

    def set_values(self, new: DataFrame, batch: str | None = None) -> list[int]:
        """Each row of `new` (keys and some columns) gives its own values to the row of its key; nulls change nothing, unknown keys neither."""
        one = new.groupBy(*self.keys).agg(*[F.max(c).alias(c) for c in new.columns if c not in self.keys])
        return self.change(one, lambda old: upserts.patched(old, one, self.keys), batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> list[int]:
        return self.change(keys, lambda old: upserts.deleted(old, keys, self.keys), batch)

    def replace_groups(self, new: DataFrame, batch: str | None = None) -> list[int]:
        """All old rows of the groups of `new` go, its rows come; groups of which it has no row keep theirs."""
        one = self.last_of_key(new)
        return self.change(one, lambda old: upserts.upserted(old, one, self.group), batch)

    def last_of_key(self, new: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.keys]
        best = F.max(F.struct(*rest)) if rest else F.lit(None)
        return new.groupBy(*self.keys).agg(best.alias("__best")).select(*[F.col(c) if c in self.keys else F.col("__best")[c].alias(c) for c in self.schema.names])
