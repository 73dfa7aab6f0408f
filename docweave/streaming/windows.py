"""Streams of events: windowed counts with late data, sessions of keys, and a job queue drained in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Size of a KLL sketch; ranks of its quantiles are within ERROR of the exact ones, with a probability of 0.99, after merging too.
SKETCH, ERROR = 200, 0.0166


def read(spark: SparkSession, folder: str, schema: str, files: int = 5) -> DataFrame:
    """A folder of Parquet files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counted(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window. For streams, `late` is how late an event may come."""
    e = events.withWatermark("ts", late) if late is not None else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sketched(events: DataFrame, width: str, late: str | None = None, size: int = SKETCH) -> DataFrame:
    """start, event_type, n, sketch of each window: a KLL sketch of the values, which others can be merged with. For streams, `late` is how late an event may come."""
    e = events.withWatermark("ts", late) if late is not None else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch")).select(F.col("w.start").alias("start"), "event_type", "n", "sketch")


def merged_quantiles(sketches: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, n and a quantile for each of `shares`, from the merged sketches of any windows."""
    one = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return one.select(*by, "n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in shares.items()])


def first_of_key(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark: what an at-least-once source repeats is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all there is and stop; `checkpoint` lets the next call go on from there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
