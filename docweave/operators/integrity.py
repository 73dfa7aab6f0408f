"""Checks of stores against each other: passages, points and the graph, and what is to be done with what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators import dictionary

#: Fields of a point's payload that repeat its document's and its passage's.
FIELDS = ("document", "filename", "chunk_index", "content")


def point_issues(points: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, issue of every point (id, chunk, document, filename, chunk_index, content): its document isn't active; else its passage is missing; else fields that differ, and an id that isn't the passage's.

    docs: document, filename (active ones); chunks: chunk, document, chunk_index, content."""
    own = docs.select("document", F.col("filename").alias("want_filename"))
    held = chunks.select("chunk", F.col("document").alias("want_document"), F.col("chunk_index").alias("want_chunk_index"), F.col("content").alias("want_content"))
    rows = points.join(own, "document", "left").join(held, "chunk", "left")
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"want_{f}")), f"field {f}") for f in FIELDS]
    issues = (
        F.when(F.col("want_filename").isNull(), F.array(F.lit("orphan")))
        .when(F.col("want_document").isNull(), F.array(F.lit("missing passage")))
        .otherwise(F.array_compact(F.array(*differs, F.when(~F.col("id").eqNullSafe(F.col("chunk")), "id"))))
    )
    return rows.select("id", F.explode(issues).alias("issue"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def different_sets(expected: DataFrame, actual: DataFrame, group: str, item: str) -> DataFrame:
    """group, n_missing, n_extra where the items of the two tables differ."""
    both = expected.select(group, item).distinct().withColumn("e", F.lit(1)).join(actual.select(group, item).distinct().withColumn("a", F.lit(1)), [group, item], "full")
    return both.groupBy(group).agg(F.count_if(F.col("a").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_extra")).where("n_missing > 0 or n_extra > 0")


def graph_issues(nodes: DataFrame, edges: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind, id, issue of nodes (id, document, source, user) and edges (id, src_document, dst_document, document, chunk, source) against active documents (document, filename) and passages (chunk, document)."""
    own = docs.select("document", F.col("filename").alias("want"))
    n = nodes.join(own, "document", "left").where("document is not null or user is null")
    issue = F.when(F.col("want").isNull(), "orphan").when(~F.col("source").eqNullSafe(F.col("want")), "source")
    found = n.select(F.lit("node").alias("kind"), "id", issue.alias("issue")).where("issue is not null")
    owner = chunks.select("chunk", F.col("document").alias("chunk_document"))
    e = edges.join(own, "document", "left").join(owner, "chunk", "left")
    crossing = ~(F.col("src_document").eqNullSafe(F.col("document")) & F.col("dst_document").eqNullSafe(F.col("document")))
    wrong = F.col("chunk").isNotNull() & ~F.col("chunk_document").eqNullSafe(F.col("document"))
    issues = F.when(F.col("want").isNull(), F.array(F.lit("orphan"))).otherwise(
        F.array_compact(F.array(F.when(crossing, "crossing"), F.when(wrong, "passage"), F.when(~F.col("source").eqNullSafe(F.col("want")), "source")))
    )
    return found.union(e.select(F.lit("edge"), "id", F.explode(issues)))


def disposition(state: Column) -> Column:
    return F.when(state == "stale", "remove").otherwise("keep")


def classified_nodes(nodes: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, meant, state, disposition of nodes (id, document, source, chunk, user); docs: document, filename, deleted; chunks: chunk, document.

    The document that a node is meant for is the only active one that its passage, its source's filename and its own id name. A node of a user is valid; one whose meant document disagrees with its own is inconsistent; one without an active document is stale."""
    active = docs.where("not deleted")
    named = active.groupBy(F.col("filename").alias("source")).agg(F.min("document").alias("first_named"), F.max("document").alias("last_named"))  # whether several bear the name, not which: many may
    by_chunk = chunks.select("chunk", F.col("document").alias("by_chunk")).join(active.select(F.col("document").alias("by_chunk")), "by_chunk", "left_semi")
    rows = nodes.join(docs.select("document", F.col("filename").alias("want"), "deleted"), "document", "left").join(by_chunk, "chunk", "left").join(named, "source", "left")
    own = F.when(~F.col("deleted"), F.col("document"))
    may = F.array_distinct(F.array_compact(F.array("by_chunk", own, "first_named", "last_named")))
    rows = rows.withColumn("meant", F.when(F.size(may) == 1, may[0]))
    other = F.col("meant").isNotNull() & (~F.col("document").eqNullSafe(F.col("meant")) | ~F.col("source").eqNullSafe(F.col("meant_name")))
    rows = rows.join(docs.select(F.col("document").alias("meant"), F.col("filename").alias("meant_name")), "meant", "left")
    state = (
        F.when(F.col("document").isNull() & F.col("user").isNotNull(), "valid").when(other, "inconsistent").when(F.col("want").isNull() | F.col("deleted"), "stale")
        .when(~F.col("source").eqNullSafe(F.col("want")), "inconsistent").otherwise("valid")
    )
    return rows.select("id", "meant", state.alias("state"), disposition(state).alias("disposition"))


def repair_plan(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """old_id, document, new_id, owner: global nodes (id, type, name, without a document) scoped anew to each document that shows them: through an edge (src, dst, document) or a passage (document, chunk_index, content) that holds the name; and the passage that owns the node there: the first that names it, else the document's first."""
    free = nodes.where("document is null").select("id", "type", "name")
    seen = edges.where("document is not null").select(F.explode(F.array("src", "dst")).alias("id"), "document").distinct()
    pairs = free.join(seen, "id").select("id", "type", "name", "document")
    owned = dictionary.owners(pairs.select("id", "document").distinct(), free.select("id", "name"), chunks)
    new = F.substring(F.sha2(F.concat_ws(":", "type", F.lower("name"), F.col("document").cast("string")), 256), 1, 16)
    return pairs.join(owned, ["id", "document"], "left").select(F.col("id").alias("old_id"), "document", new.alias("new_id"), "owner")


def backfill_actions(docs: DataFrame) -> DataFrame:
    """document, action of documents (document, n_chunks, n_embedded, n_points, has_text): what an incremental backfill does."""
    done = (F.col("n_points") >= F.col("n_embedded")) & (F.col("n_embedded") > 0)
    action = F.when(F.col("n_chunks") > 0, F.when(done, "skip").when(F.col("n_embedded") == 0, "embed").otherwise("reindex")).when(F.col("has_text"), "chunk").otherwise("skip")
    return docs.select("document", action.alias("action"))


def snapshot(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """name, n and a digest of a table's rows that doesn't depend on their order: the sum of 32 bits of each row's MD5."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), 1, 8), 16, 10).cast("long")
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("digest"))
