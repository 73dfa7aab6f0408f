"""Property-graph operators over nodes (id, type, name) and edges (src, dst, type, confidence).

Walks go outward one join at a time from the nodes reached last, so that a step costs the frontier's edges and
not the graph's paths.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import counted, cut

#: Longest walks that are answered.
MOST_DEPTH, MOST_PATH = 10, 20


def both_ways(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, other, type, confidence, outgoing): each edge seen from both of its ends; self edges are left out."""
    e = edges.where(F.col("src") != F.col("dst"))
    if types is not None:
        e = e.where(F.col("type").isin(types))
    ahead = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", "confidence", F.lit(True).alias("outgoing"))
    return ahead.unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", "confidence", F.lit(False).alias("outgoing")))


def neighbours(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """One row for each start and distinct neighbour, with the surest edge's type. starts: node."""
    near = both_ways(edges).join(starts, "node").groupBy("node", "other").agg(F.max_by("type", F.struct("confidence", "type")).alias("type"), F.max("confidence").alias("confidence"))
    return near.join(nodes.select(F.col("id").alias("other"), F.col("name").alias("neighbour")), "other").select("node", "other", "neighbour", "type", "confidence")


#: Most nodes of a frontier that is broadcast, so that a step doesn't shuffle the edges.
FRONTIER = 100_000


def small(frontier: DataFrame, n: int) -> DataFrame:
    """The frontier of n nodes, to be broadcast if it is small enough."""
    return F.broadcast(frontier) if n <= FRONTIER else frontier


def within_depth(edges: DataFrame, starts: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(node, depth): what is reached from the starts, and in how few steps; the starts themselves at 0."""
    links = both_ways(edges, types).select("node", "other")
    frontier, n = counted(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for d in range(1, min(depth, MOST_DEPTH) + 1):
        step = small(frontier, n).join(links, "node").select(F.col("other").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier, n = counted(step.withColumn("depth", F.lit(d)))
        if not n:
            break
        reached = reached.unionByName(frontier)
    return reached


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = MOST_PATH) -> DataFrame:
    """(path, length) of one shortest undirected path, that of the least predecessors; no row if there is none."""
    links = both_ways(edges).select("node", "other")
    frontier, n = counted(edges.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>"))
    seen = frontier.select("node")
    for _ in range(min(depth, MOST_PATH) + 1):
        found = frontier.where(F.col("node") == target)
        if not n or not found.isEmpty():
            break
        step = small(frontier, n).join(links, "node").groupBy(F.col("other").alias("node")).agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        frontier, n = counted(step.select("node", F.concat("path", F.array("node")).alias("path")))
        seen = seen.union(frontier.select("node"))
    return frontier.where(F.col("node") == target).select("path", (F.size("path") - 1).alias("length"))


def entity_search(nodes: DataFrame, query: Column, terms: Column) -> DataFrame:
    """Nodes whose name is the query or holds a term, in any case, with exact, coverage and the total; exact ones first. The query and its few terms are constants, computed once and not for each node."""
    low = F.lower("name")
    asked = nodes.sparkSession.range(1).select(F.lower(query).alias("query"), F.transform(terms, F.lower).alias("terms")).first()
    n = len(asked.terms) if asked.terms is not None else 0
    hits = reduce(add, [F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in asked.terms or ()], F.lit(0))
    found = nodes.withColumn("exact", low == F.lit(asked.query)).withColumn("coverage", hits / n if n else F.lit(0.0))
    found = cut(found.where("exact or coverage > 0"))
    return found.crossJoin(found.agg(F.count("*").alias("total")))  # with one row


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, name, n): number of nodes of each type and of edges of each type."""
    a = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "name", "n")
    return a.union(edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge"), "name", "n"))


def facts_around(edges: DataFrame, node: str) -> DataFrame:
    """Distinct (subject, relation, object) of one node's edges, in their directions."""
    near = both_ways(edges).where(F.col("node") == node)
    ends = lambda a, b: F.when(F.col("outgoing"), F.col(a)).otherwise(F.col(b))
    return near.select(ends("node", "other").alias("subject"), F.col("type").alias("relation"), ends("other", "node").alias("object")).distinct()


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after an upsert by id: the surer of two rows stays, the older one if they are equal. Both have id, name, type, confidence."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    best = lambda c: F.max_by(c, F.struct("confidence", "__age")).alias(c)
    return both.groupBy("id").agg(best("name"), best("type"), F.max("confidence").alias("confidence"))


def walked(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """id, src, dst, type, depth of the edges (id, src, dst, type) on which a node of `reached` (node, depth; see within_depth) is come to from one a step nearer, or that lie between two of them; depth: that of the farther end, at least 1."""
    at = lambda end: reached.select(F.col("node").alias(end), F.col("depth").alias(f"{end}_depth"))
    both = edges.where("src <> dst").join(at("src"), "src").join(at("dst"), "dst")
    return both.select("id", "src", "dst", "type", F.greatest("src_depth", "dst_depth", F.lit(1)).alias("depth"))


def path_of_edges(edges: DataFrame, source: str, target: str, depth: int = MOST_PATH) -> DataFrame:
    """nodes, edges, length of the shortest undirected path over edges (id, src, dst): of equal ones that whose list of edge ids is the least. No row if there is none of up to `depth` edges.

    Two frontiers go out from the ends, the smaller one first, and meet in the middle; each of their rows has the least
    list of edges to its node, of as many as the frontier has gone steps. A path crosses both frontiers when they first
    share a node, so the least of the joined lists is the least of all.
    """
    spark = edges.sparkSession
    e = edges.where("src <> dst").select("id", "src", "dst")
    links = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "id").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "id"))
    kind = "node string, edges array<string>, nodes array<string>"
    sides = [counted(spark.createDataFrame([(end, [], [end])], kind)) for end in (source, target)]
    seen = [sides[0][0].select("node"), sides[1][0].select("node")]
    met = sides[0][0].alias("a").join(sides[1][0].alias("b"), "node")
    for gone in range(min(depth, MOST_PATH) + 1):
        met = sides[0][0].alias("a").join(sides[1][0].alias("b"), "node")
        if gone == min(depth, MOST_PATH) or not sides[0][1] or not sides[1][1] or not met.isEmpty():
            break
        k = 0 if sides[0][1] <= sides[1][1] else 1
        front, n = sides[k]
        step = small(front, n).join(links, "node")
        longer = (lambda c, x: F.concat(c, F.array(x))) if k == 0 else (lambda c, x: F.concat(F.array(x), c))
        step = step.select(F.col("other").alias("node"), longer(F.col("edges"), F.col("id")).alias("edges"), longer(F.col("nodes"), F.col("other")).alias("nodes"))
        least = step.join(seen[k], "node", "left_anti").groupBy("node").agg(F.min(F.struct("edges", "nodes")).alias("p"))
        sides[k] = counted(least.select("node", "p.edges", "p.nodes"))
        seen[k] = seen[k].union(sides[k][0].select("node"))
    whole = met.select(F.concat("a.edges", "b.edges").alias("edges"), F.concat("a.nodes", F.slice("b.nodes", F.lit(2), F.greatest(F.size("b.nodes") - 1, F.lit(0)))).alias("nodes"))
    best = whole.agg(F.min(F.struct("edges", "nodes")).alias("p")).where("p is not null")
    return best.select("p.nodes", "p.edges", F.size("p.edges").alias("length"))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All `edges` (id, src, dst, src_name, dst_name, document) with src_node and dst_node: each end is the node (id, name, document) of the id it gives, or, if it gives none, the one of its name in the edge's document (of several the least id); null where there isn't any.

    Nodes and ends meet over one key, which says which of the two kinds it is; so no join needs an OR.
    """
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)
    named = nodes.where("name is not null and document is not null").groupBy("name", "document").agg(F.min("id").alias("node"))
    known = nodes.select(key("id", F.col("id")).alias("key"), F.col("id").alias("node")).distinct()
    known = known.union(named.select(key("name", F.col("name"), F.col("document").cast("string")), "node"))
    end = lambda side: F.struct(F.lit(side).alias("side"), F.when(F.col(side).isNotNull(), key("id", F.col(side))).otherwise(F.when(F.col(f"{side}_name").isNotNull() & F.col("document").isNotNull(), key("name", F.col(f"{side}_name"), F.col("document").cast("string")))).alias("key"))
    ends = edges.select("id", F.explode(F.array(end("src"), end("dst"))).alias("e")).select("id", "e.side", "e.key").distinct()
    found = ends.join(known, "key").groupBy("id").agg(*[F.max(F.when(F.col("side") == side, F.col("node"))).alias(f"{side}_node") for side in ("src", "dst")])
    return edges.join(found, "id", "left").select(*edges.columns, "src_node", "dst_node")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, F.col("src") == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(both_ways(edges).select(F.col("node").alias("id")).distinct(), "id", "left_anti")
