"""Graph retrieval, hybrid retrieval, and budgets of what goes into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.config import CONTEXT
from docweave.operators import graph

#: Candidates looked at for each entity wanted; types of entities that come after all others.
CANDIDATES, DEMOTED = 6, ("document",)


def ranked_entities(found: DataFrame, query: Column, k: int, demoted: tuple[str, ...] = DEMOTED) -> DataFrame:
    """The k of `found` (id, type, name, ...) that are the query, then of types not demoted, then whose name is covered most densely by the query's words, then most often, then by name."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\w-]+"), F.lit(0)), lambda w: F.length(w) > 2)
    name = F.lower(F.coalesce("name", F.lit("")))
    parts = F.size(F.filter(F.split(name, r"[\s_\-.]+"), lambda w: w != ""))
    hits = F.size(F.filter(words, lambda w: F.contains(name, w)))
    marked = found.withColumns({
        "__exact": name == F.lower(query),
        "__demoted": F.lower(F.coalesce("type", F.lit(""))).isin(*demoted),
        "__density": F.when(parts > 0, hits / parts).otherwise(F.lit(0.0)),
        "__hits": hits,
    })
    order = [F.desc("__exact"), F.col("__demoted"), F.desc("__density"), F.desc("__hits"), F.col("name"), F.col("id")]
    return marked.orderBy(*order).limit(k).withColumn("place", F.row_number().over(W.orderBy(*order))).drop("__exact", "__demoted", "__density", "__hits")  # k rows


def entity_facts(entities: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts of a few entities (id, name, type, confidence, source, document, place): entity, type, relationship, related, confidence, source.

    An entity with edges gives its edges, one without itself. An edge whose ends and itself name several documents
    tells of none. Of facts with the same words the surest stays; it comes from the edge's document, else the neighbour's, else its own."""
    ways = edges.where("src <> dst")
    ahead = ways.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("type").alias("relationship"), F.col("document").alias("edge_document"), F.col("source").alias("edge_source"))
    back = ways.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.col("type").alias("relationship"), F.col("document").alias("edge_document"), F.col("source").alias("edge_source"))
    first = entities.groupBy("name").agg(F.min_by(F.struct(*entities.columns), "place").alias("e")).select("e.*")
    near = ahead.union(back).join(F.broadcast(first), "id")  # a top-k
    other = nodes.select(F.col("id").alias("other"), F.col("name").alias("related"), F.col("confidence").alias("sure"), F.col("document").alias("other_document"), F.col("source").alias("other_source"))
    pairs = near.join(other, "other")
    named = F.size(F.array_distinct(F.array_compact(F.array("document", "edge_document", "other_document"))))
    facts = pairs.where(named <= 1).select("name", "type", "relationship", "related", F.col("sure").alias("confidence"), F.coalesce("edge_source", "other_source", "source").alias("source"))
    best = F.min_by(F.struct("confidence", "source"), F.struct((-F.col("confidence")).alias("a"), F.coalesce("source", F.lit("~")).alias("b"))).alias("f")
    facts = facts.groupBy("name", "type", "relationship", "related").agg(best).select(F.col("name").alias("entity"), "type", "relationship", "related", "f.confidence", "f.source")
    alone = first.join(near.select("id").distinct(), "id", "left_anti")
    text = F.lit(None).cast("string")
    return facts.unionByName(alone.select(F.col("name").alias("entity"), "type", text.alias("relationship"), text.alias("related"), "confidence", "source"))


def graph_facts(nodes: DataFrame, edges: DataFrame, query: Column, terms: Column, k: int, demoted: tuple[str, ...] = DEMOTED) -> DataFrame:
    """Search of entities, their ranking, their edges, and the facts these give."""
    found = graph.entity_search(nodes, query, terms).orderBy(F.desc("exact"), F.desc("coverage"), "name", "id").limit(CANDIDATES * k)
    return entity_facts(ranked_entities(found.drop("exact", "coverage", "total"), query, k, demoted), nodes, edges)


def combined_confidence(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """confidence: the best hit's score or nine tenths of the surest fact, at most 1; 0 without either."""
    top = hits.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("a")).crossJoin(facts.agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("b")))  # one row each
    return top.select(F.round(F.least(F.greatest("a", F.col("b") * 0.9), F.lit(1.0)), 9).alias("confidence"))


def prompt_blocks(hits: DataFrame, overhead: Column, most: int = CONTEXT.prompt_chars) -> DataFrame:
    """n, id, block: the hits (id, source, content, score; a bounded top-k) by falling score that fit a prompt of `most` characters less `overhead`; the first that doesn't is cut, if more than 60 characters are left or nothing fit."""
    order = W.orderBy(F.desc("score"), "id")
    numbered = hits.withColumn("n", F.row_number().over(order))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] Source: "), F.col("source"))
    block = F.concat(line, F.lit("\n    Content: "), F.col("content"))
    room = F.lit(most) - overhead
    rows = numbered.withColumns({"line": line, "block": block}).withColumn("used", F.sum(F.length("block") + 2).over(order))
    rows = rows.withColumn("before", F.col("used") - F.length("block") - 2).withColumn("fits", F.col("used") <= room)
    first = F.min(F.when(~F.col("fits"), F.col("n"))).over(W.partitionBy())
    left = room - F.col("before")
    cut = F.concat("line", F.lit("\n    Content: "), F.substring("content", F.lit(1), F.greatest(left - F.length("line") - 30, F.lit(0)).cast("int")), F.lit("...[truncated]"))
    kept = rows.withColumn("first", first).where(F.col("fits") & (F.col("first").isNull() | (F.col("n") < F.col("first"))) | ((F.col("n") == F.col("first")) & ((left > 60) | ((F.col("n") == 1) & (left > 0)))))
    return kept.select("n", "id", F.when(F.col("n") == F.col("first"), cut).otherwise(F.col("block")).alias("block"))


def memory_lines(memories: DataFrame, user: str, most: int = CONTEXT.memory_chars) -> DataFrame:
    """user, n, line: each user's memories (user, id, type, title, content, summary, score) by falling score, as lines that fit `most` characters with a heading of two lines; the first that doesn't is cut if more than 40 characters are left."""
    heading = len("Relevant Memories:") + 1 + len("------------------") + 1
    own = W.partitionBy(user).orderBy(F.desc("score"), "id")
    said = F.substring(F.coalesce(F.when(F.col("summary") != "", F.col("summary")), "content"), 1, 200)
    line = F.concat(F.lit("- ["), F.initcap(F.replace("type", F.lit("_"), F.lit(" "))), F.lit("] "), "title", F.lit(": "), said)
    rows = memories.withColumn("line", line).withColumn("n", F.row_number().over(own)).withColumn("used", F.lit(heading) + F.sum(F.length("line") + 1).over(own))
    rows = rows.withColumn("left", F.lit(most) - (F.col("used") - F.length("line") - 1)).withColumn("first", F.min(F.when(F.col("used") > most, F.col("n"))).over(W.partitionBy(user)))
    kept = rows.where(F.col("first").isNull() | (F.col("n") < F.col("first")) | ((F.col("n") == F.col("first")) & (F.col("left") > 40)))
    return kept.select(user, "n", F.when(F.col("n") == F.col("first"), F.substring("line", F.lit(1), F.col("left").cast("int"))).otherwise(F.col("line")).alias("line"))
