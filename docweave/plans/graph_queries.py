"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import graph
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql

_BOTH = ", ways as (select src as node, dst as other, type, confidence, true as outgoing from edges union all select dst, src, type, confidence, false from edges)\n"


@query("gr01_entities_by_name", sql("nodes", rest="select id, type, name from nodes where type = 'Nation' order by name, id limit 10 offset 5"))
def gr01(spark, sf):
    return corpus.nodes(spark, sf).where("type = 'Nation'").orderBy("name", "id").limit(15).offset(5)


@query("gr02_entity_search", sql("nodes", rest="""select id, name, exact, coverage, count(*) over () as total from (select id, name, lower(name) = 'customer 17' as exact,
  (cast(contains(lower(name), 'customer') as int) + cast(contains(lower(name), '17') as int)) / 2.0::double as coverage from nodes) where exact or coverage > 0"""))
def gr02(spark, sf):
    found = graph.entity_search(corpus.nodes(spark, sf), F.lit("customer 17"), tx.query_terms(F.lit("customer 17")))
    return found.select("id", "name", "exact", "coverage", "total")


@query("gr03_batch_neighbours", sql("nodes", "edges", rest=_BOTH + """select node, other, n.name as neighbour, max(w.type) as type, max(confidence) as confidence
  from ways w join nodes n on n.id = other where node in ('N1', 'N2', 'R3') group by all"""))
def gr03(spark, sf):
    starts = spark.createDataFrame([("N1",), ("N2",), ("R3",)], "node string")
    return graph.neighbours(corpus.edges(spark, sf), corpus.nodes(spark, sf), starts)


@query("gr04_typed_neighbours", sql("edges", rest=_BOTH + "select other, type, count(*) over () as total from ways where node = 'N3' and type = 'LOCATED_IN'"))
def gr04(spark, sf):
    near = graph.both_ways(corpus.edges(spark, sf), ["LOCATED_IN"]).where("node = 'N3'").select("other", "type")
    return near.crossJoin(near.agg(F.count("*").alias("total")))  # with one row


@query("gr05_within_depth", sql("edges", rest=_BOTH + """, walk as (select 'R1' as node, 0 as depth union select w.other, walk.depth + 1 from walk join ways w on w.node = walk.node where walk.depth < 3)
  select node, cast(min(depth) as int) as depth from walk group by node"""))
def gr05(spark, sf):
    return graph.within_depth(corpus.edges(spark, sf), spark.createDataFrame([("R1",)], "node string"), 3)


@query("gr06_shortest_path", sql("edges", rest=""", ends as (select (select dst from edges where src = 'C1') as n, (select dst from edges where src = 'C11') as m)
  , up as (select n, m, (select dst from edges where src = n) as r, (select dst from edges where src = m) as s from ends)
  select case when n = m then ['C1', n, 'C11'] when r = s then ['C1', n, r, m, 'C11'] end as path, cast(case when n = m then 2 when r = s then 4 end as int) as length from up where r = s"""))
def gr06(spark, sf):
    return graph.shortest_path(corpus.edges(spark, sf), "C1", "C11")


@query("gr07_graph_statistics", sql("nodes", "edges", rest="select 'node' as part, type as name, count(*) as n from nodes group by type union all select 'edge', type, count(*) from edges group by type"))
def gr07(spark, sf):
    return graph.statistics(corpus.nodes(spark, sf), corpus.edges(spark, sf))


@query("gr08_facts_around_node", sql("edges", rest="select distinct src as subject, type as relation, dst as object from edges where src = 'N4' or dst = 'N4'"))
def gr08(spark, sf):
    return graph.facts_around(corpus.edges(spark, sf), "N4")


@query("gr09_merge_nodes", sql("nodes", rest=""", old as (select id, name, type, cast(0.5 as double) as confidence from nodes where type <> 'Region'), new as (select id, upper(name) as name, type, case when type = 'Nation' then 0.9 else 0.4 end::double as confidence from nodes where type in ('Region', 'Nation', 'Supplier'))
  select id, case when n.confidence > coalesce(o.confidence, 0) then n.name else o.name end as name, coalesce(o.type, n.type) as type, greatest(coalesce(o.confidence, 0), coalesce(n.confidence, 0)) as confidence from old o full join new n using (id)"""))
def gr09(spark, sf):
    n = corpus.nodes(spark, sf)
    new = n.where("type in ('Region', 'Nation', 'Supplier')").select("id", F.upper("name").alias("name"), "type", F.when(F.col("type") == "Nation", 0.9).otherwise(0.4).alias("confidence"))
    return graph.merged_nodes(n.where("type <> 'Region'").withColumn("confidence", F.lit(0.5)), new)


@query("gr10_delete_node", sql("nodes", "edges", rest="select id, type, name from nodes where id <> 'N5' and id not in (select src from edges where dst = 'N5')"))
def gr10(spark, sf):
    near = graph.both_ways(corpus.edges(spark, sf)).where("node = 'N5' and not outgoing").select(F.col("other").alias("id"))
    return corpus.nodes(spark, sf).where("id <> 'N5'").join(near, "id", "left_anti")


@query("ag06_graph_counts", sql("nodes", "edges", rest="select (select count(distinct id) from nodes) as entities, (select count(distinct type) from nodes) as types, (select count(*) from edges) as relationships"))
def ag06(spark, sf):
    n, e = corpus.nodes(spark, sf), corpus.edges(spark, sf)
    return n.agg(F.count_distinct("id").alias("entities"), F.count_distinct("type").alias("types")).crossJoin(e.agg(F.count("*").alias("relationships")))  # one row each


@query("ag07_type_counts", sql("edges", rest="select type, count(*) as n from edges group by type"))
def ag07(spark, sf):
    return corpus.edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("ag09_neighbour_counts", sql("edges", rest=_BOTH + "select node, count(distinct other) as n from ways group by node"))
def ag09(spark, sf):
    return graph.both_ways(corpus.edges(spark, sf)).groupBy("node").agg(F.count_distinct("other").alias("n"))


@query("jn12_valid_edges", sql("nodes", "edges", rest="select src, dst, type, confidence from edges where src in (select id from nodes where id not in ('N3', 'R2')) and dst in (select id from nodes where id not in ('N3', 'R2'))"))
def jn12(spark, sf):
    n = corpus.nodes(spark, sf)
    return graph.valid_edges(corpus.edges(spark, sf), n.where("id not in ('N3', 'R2')")).select("src", "dst", "type", "confidence")


@query("jn13_nodes_with_neighbours", sql("nodes", "edges", rest=_BOTH + "select id, other from nodes left join ways on node = id where nodes.type in ('Region', 'Nation')"))
def jn13(spark, sf):
    n = corpus.nodes(spark, sf).where("type in ('Region', 'Nation')").select("id")
    return n.join(graph.both_ways(corpus.edges(spark, sf)).select(F.col("node").alias("id"), "other"), "id", "left").select("id", "other")


_EDGE_IDS = ", named as (select src || '-' || type || '-' || dst as id, src, dst, type from edges), ways as (select src as node, dst as other, id from named union all select dst, src, id from named)\n"


def _with_ids(spark, sf):
    return corpus.edges(spark, sf).select(F.concat_ws("-", "src", "type", "dst").alias("id"), "src", "dst", "type")


@query("gr05_edges_within_depth", sql("edges", rest=_EDGE_IDS + """, walk as (select 'R1' as node, 0 as depth union select w.other, walk.depth + 1 from walk join ways w on w.node = walk.node where walk.depth < 2),
  reached as (select node, min(depth) as depth from walk group by node) select n.id, src, dst, type, cast(greatest(a.depth, b.depth, 1) as int) as depth from named n join reached a on a.node = src join reached b on b.node = dst"""))
def gr05_edges(spark, sf):
    """The edges of the subgraph of up to two steps around a node."""
    e = _with_ids(spark, sf)
    return graph.walked(e, graph.within_depth(corpus.edges(spark, sf), spark.createDataFrame([("R1",)], "node string"), 2))


@query("gr06_path_with_edges", sql("edges", rest=_EDGE_IDS + """, walk as (select 'C1' as node, []::varchar[] as edges, ['C1'] as nodes union all
    select w.other, list_append(edges, w.id), list_append(nodes, w.other) from walk join ways w on w.node = walk.node where len(edges) < 4 and not list_contains(nodes, w.other) and (w.other[1] <> 'C' or w.other = 'C11') and w.other[1] <> 'S'),
  found as (select nodes, edges, cast(len(edges) as int) as length from walk where node = 'C11') select nodes, edges, length from found where length = (select min(length) from found) order by edges limit 1"""))
def gr06_edges(spark, sf):
    """The shortest path between two customers, with its edges."""
    return graph.path_of_edges(_with_ids(spark, sf), "C1", "C11")


_ENDS = """, ends as (select src || '-' || e.type || '-' || dst as id, case when length(src) % 2 = 0 then src end as src, case when length(dst) % 2 = 1 then dst end as dst, a.name as src_name, b.name as dst_name, e.document
  from pedges e join nodes a on a.id = e.src join nodes b on b.id = e.dst),
homes as (select id, name, coalesce(document, 'doc-' || (ascii(right(id, 1)) % 5)) as document from pnodes where id not in ('C7', 'S2')),
by_name as (select name, document, min(id) as id from homes group by all),
resolved as (select e.id, case when e.src is not null then (select h.id from homes h where h.id = e.src) else (select b.id from by_name b where b.name = e.src_name and b.document = e.document) end as src_node,
  case when e.dst is not null then (select h.id from homes h where h.id = e.dst) else (select b.id from by_name b where b.name = e.dst_name and b.document = e.document) end as dst_node from ends e)"""


def _resolved(spark, sf):
    p, n = corpus.placed_edges(spark, sf), corpus.nodes(spark, sf)
    name = lambda end: n.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    numbered = p.join(name("src"), "src").join(name("dst"), "dst").withColumn("id", F.concat_ws("-", "src", "type", "dst"))
    keep = lambda end, odd: F.when(F.length(end) % 2 == odd, F.col(end)).alias(end)
    ends = numbered.select("id", keep("src", 0), keep("dst", 1), "src_name", "dst_name", "document")
    homes = corpus.placed_nodes(spark, sf).where("id not in ('C7', 'S2')").select("id", "name", F.coalesce("document", F.concat(F.lit("doc-"), (F.ascii(F.substring("id", -1, 1)) % 5).cast("string"))).alias("document"))
    return graph.resolved_edges(ends, homes)


@query("jn12_endpoints_by_id_or_name", sql("nodes", "edges", "pnodes", "pedges", rest=_ENDS + " select id, src_node, dst_node from resolved"))
def jn12_either(spark, sf):
    """Ends of edges by id, or by name in the edge's document where no id is given."""
    return _resolved(spark, sf).select("id", "src_node", "dst_node")


@query("snk12_edges_written", sql("nodes", "edges", "pnodes", "pedges", rest=_ENDS + " select count(*) filter (src_node is not null and dst_node is not null) as written, count(*) filter (src_node is null or dst_node is null) as dropped from resolved"))
def snk12(spark, sf):
    there = F.col("src_node").isNotNull() & F.col("dst_node").isNotNull()
    return _resolved(spark, sf).agg(F.count_if(there).alias("written"), F.count_if(~there).alias("dropped"))
