"""Memories of users: search, merging, consolidation, and their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions import vectors as vx


def by_entity(memories: DataFrame, name: Column) -> DataFrame:
    """Active memories of which an entity (entities: array of name, type) holds the name, in any case."""
    return memories.where((F.col("status") == "active") & F.exists("entities", lambda e: F.contains(F.lower(e["name"]), F.lower(name))))


def merged(memories: DataFrame, merges: DataFrame) -> DataFrame:
    """Memories (id, user, content, importance, confidence, status, details) after merges (target, sources, user, new_content, new_importance, new_confidence).

    The target takes the new content, and scores brought into [0, 1]; its sources of the same user end as merged, with a pointer to it."""
    sources = merges.select(F.col("target"), F.col("user").alias("of"), F.explode("sources").alias("source")).where("source <> target")
    sources = sources.groupBy("source", "of").agg(F.min("target").alias("into"))
    rows = memories.join(merges.drop("sources").withColumnRenamed("user", "by"), (F.col("id") == F.col("target")) & (F.col("user") == F.col("by")), "left")
    rows = rows.join(sources, (F.col("id") == F.col("source")) & (F.col("user") == F.col("of")), "left")
    gone = F.col("into").isNotNull()
    score = lambda new, old: F.when(F.col(new).isNotNull(), vx.clamp(F.col(new))).otherwise(F.col(old)).alias(old)
    details = F.when(gone, F.map_concat(F.map_filter("details", lambda k, v: k != "merged_into"), F.create_map(F.lit("merged_into"), F.col("into").cast("string")))).otherwise(F.col("details"))
    return rows.select(
        "id", "user", F.coalesce("new_content", "content").alias("content"), score("new_importance", "importance"), score("new_confidence", "confidence"),
        F.when(gone, "merged").otherwise(F.col("status")).alias("status"), details.alias("details"),
    )


def consolidated(memories: DataFrame, found: DataFrame, kinds: tuple[str, ...], title_chars: int = 60) -> DataFrame:
    """What becomes of extractions (key, user, category, title, content, importance, confidence): action, merge with the memory (id, user, type, title, content, ...) of the same user and type whose title or content holds the beginning of the title (the most important one, then the newest), or insert.

    Extractions and memories meet by user and type."""
    kind = F.when(F.col("category").isin(*kinds) & (F.col("category") != "general"), F.col("category")).otherwise("temporary_memory")
    new = found.withColumn("type", kind).withColumn("head", F.lower(F.substring("title", 1, title_chars)))
    old = memories.where("status = 'active'").select("user", "type", F.col("id").alias("target"), F.lower("title").alias("old_title"), F.lower("content").alias("old_content"), F.col("importance").alias("old_importance"), "updated_at")
    hits = new.join(old, ["user", "type"]).where(F.contains("old_title", F.col("head")) | F.contains("old_content", F.col("head")))
    best = hits.groupBy("key").agg(F.min_by("target", F.struct(-F.col("old_importance"), -F.unix_micros(F.col("updated_at").cast("timestamp")), "target")).alias("target"))
    return new.join(best, "key", "left").select("key", "user", "type", F.when(F.col("target").isNotNull(), "merge").otherwise("insert").alias("action"), "target")


def ended(memories: DataFrame, now: Column, batch: int) -> DataFrame:
    """Memories with the state that an expiry of at most `batch` of them gives: those longest over first."""
    over = (F.col("status") == "active") & (F.col("expires_at") <= now)
    due = memories.where(over).orderBy("expires_at", "id").limit(batch).select("id", F.lit(True).alias("due"))
    return memories.join(F.broadcast(due), "id", "left").withColumn("status", F.when(F.col("due"), "expired").otherwise(F.col("status"))).drop("due")  # of at most `batch` rows


def kept_titles(rows: DataFrame, user: str, title: str, newest: str, most: int) -> DataFrame:
    """The newest row of each user's title, in any case, and of these the `most` newest."""
    low = F.lower(F.trim(title))
    last = rows.withColumn("n", F.row_number().over(W.partitionBy(user, low).orderBy(F.desc(newest), F.desc("id")))).where("n = 1")
    return last.withColumn("n", F.row_number().over(W.partitionBy(user).orderBy(F.desc(newest), F.desc("id")))).where(F.col("n") <= most).drop("n")
