"""Session helpers shared by every layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark alone reads the path, so any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that makes much of little: texts from a few columns of a compact table.
SPREAD_ROWS = 8192


def spread(df: DataFrame, key: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """`df` dealt by `key` to a task for every so many rows. A compact table is one split, or a few, however much work its rows are; groups and joins by the key need no shuffle after this."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Only a local master without that setting gets a temporary folder; a cluster without it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="docweave-"))
    return sc.getCheckpointDir()


#: Whether shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `release` removes with all others of this application."""
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there. From the first such write on, the session's shuffle files go as soon as the query that wrote them ends."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    if spark.conf.get(_CLEANUP) != "true":
        spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` as a written table, and its number of rows, seen while it is written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def release(spark: SparkSession) -> None:
    """Remove the tables that this application has written to the shared folder, once their results are stored."""
    jvm, folder = spark._jvm, shared_folder(spark)
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*-{spark.sparkContext.applicationId}-*")) or ():
        fs.delete(f.getPath(), True)
