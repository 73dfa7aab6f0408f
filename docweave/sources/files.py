"""Files as rows: what lies in a folder against what should, and texts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import intake


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path (below `folder`), bytes, modified of the files under `folder`. Only these columns are asked for, so that Spark lists the files and opens none. Files whose names begin with a dot or an underscore, and files without a byte, are left out, as everywhere in Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    bare = F.regexp_replace("path", "^[a-z]+:/*", "/")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    return files.select(F.substr(bare, F.instr(bare, F.lit(root + "/")) + F.lit(len(root) + 1)).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def compared(expected: DataFrame, files: DataFrame) -> DataFrame:
    """path, state, expected_bytes, bytes of expected files (path, bytes, wanted) and those there (path, bytes).

    wanted: whether the file's document is active. missing: wanted, not there; orphan: there, no longer wanted; extra:
    there, never expected; different: of another size; gone: neither wanted nor there; valid: as expected. A null path
    can't be checked (unverifiable); an unknown size is no difference. Of a path expected twice, wanted counts.
    """
    asked = expected.where("path is not null").groupBy("path").agg(F.max("bytes").alias("expected_bytes"), F.max("wanted").alias("wanted"))
    both = asked.withColumn("asked", F.lit(True)).join(files.select("path", "bytes").withColumn("there", F.lit(True)), "path", "full")
    state = (
        F.when(F.col("asked").isNull(), "extra").when(F.col("wanted") & F.col("there").isNull(), "missing").when(F.col("there").isNull(), "gone")
        .when(~F.col("wanted"), "orphan").when(F.col("expected_bytes") != F.col("bytes"), "different").otherwise("valid")
    )
    unknown = expected.where("path is null").select("path", F.lit("unverifiable").alias("state"), F.col("bytes").alias("expected_bytes"), F.lit(None).cast("bigint").alias("bytes"))
    return both.select("path", state.alias("state"), "expected_bytes", "bytes").unionByName(unknown)


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path, text, char_count of the text files under `folder`: UTF-8, else Latin-1, trimmed; empty ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return intake.decoded(files.select("path", "content"), key="path")
