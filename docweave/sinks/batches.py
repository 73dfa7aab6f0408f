"""A batch that goes to several keyed tables: to all of them, or to none.

Before a table is written, the rows of the buckets that will change are put aside. If a later write fails, the tables
written before it get their old rows back, the last first. What was put aside lies in the sink's folder, so that a batch
whose driver was lost between two tables is undone when it comes again, before it is tried anew. When all tables are
written, the batch is marked; a batch with a mark isn't written again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docweave.session import cut
from docweave.sinks.keyed import KeyedTable


@dataclass
class Write:
    """A table, the name of one of its writes ("upsert", "insert_missing", "set_values", "delete", "replace_groups"), and the rows."""

    table: KeyedTable
    how: str
    rows: DataFrame


class BatchSink:
    """Batches under `folder`; writes(rows, batch) says what goes where."""

    def __init__(self, spark: SparkSession, folder: str, tables: list[KeyedTable], writes: Callable[[DataFrame, str], list[Write]]):
        self.spark, self.folder, self.tables, self.writes = spark, folder, tables, writes
        self.done = KeyedTable(spark, folder, "batch string", ["batch"])  # holds the marks only

    def _aside(self, batch: str, k: int, table: KeyedTable, rows: DataFrame) -> None:
        """Put aside the old rows of the buckets that `rows` fall in, and then which buckets these are."""
        buckets = table.buckets_of(rows)
        at = f"{self.folder}/undo/{batch}/{k}"
        table.rows_of(buckets).write.mode("overwrite").parquet(f"{at}/rows")
        which = [(self.tables.index(table), buckets)]
        self.spark.createDataFrame(which, "place int, buckets array<int>").coalesce(1).write.mode("overwrite").parquet(f"{at}/buckets")

    def undo(self, batch: str) -> int:
        """Give the tables their rows from before the batch, the last written first; how many."""
        k = 0
        while self.done.exists(f"{self.folder}/undo/{batch}/{k}/buckets/_SUCCESS"):
            k += 1
        for i in range(k - 1, -1, -1):
            at = f"{self.folder}/undo/{batch}/{i}"
            which = self.spark.read.parquet(f"{at}/buckets").first()
            table = self.tables[which.place]
            table.overwrite(list(which.buckets), self.spark.read.schema(table.schema).parquet(f"{at}/rows"))
            table.unmark(f"{batch}-{i}")
        self.done.remove(f"{self.folder}/undo/{batch}")
        return k

    def apply(self, rows: DataFrame, batch: str | int) -> bool:
        """Write a batch; False if it was written before."""
        batch = str(batch)
        if self.done.written(batch):
            return False
        self.undo(batch)
        try:
            for k, w in enumerate(self.writes(rows, batch)):
                new = cut(w.rows)
                self._aside(batch, k, w.table, new)
                getattr(w.table, w.how)(new, batch=f"{batch}-{k}")
        except Exception:
            self.undo(batch)
            raise
        self.done.mark(batch)
        self.done.remove(f"{self.folder}/undo/{batch}")
        return True

    def drain(self, stream: DataFrame) -> StreamingQuery:
        """Write what the stream has, a batch at a time, and stop; the checkpoint lies in the sink's folder."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.apply(rows, n) and None).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

