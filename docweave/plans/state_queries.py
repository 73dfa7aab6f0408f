"""Queries of memories, jobs, checks between stores, and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import dictionary, graph, integrity, jobs, upserts
from docweave.operators import memories as mem
from docweave.plans.registry import query
from docweave.session import scratch
from docweave.sources import corpus, intake
from docweave.sources.corpus import sql, table
from docweave.streaming import windows

NOW = "2024-01-15"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# ── memories ──


@query("me03_memory_entities", sql("memories", rest="select doc_id from memories where status = 'active' and contains(lower(string_split(title, ' ')[1]), 'en')"))
def me03(spark, sf):
    m = corpus.memories(spark, sf).withColumn("entities", F.array(F.struct(F.split("title", " ")[0].alias("name"), F.lit("Word").alias("type"))))
    return mem.by_entity(m, F.lit("EN")).select("doc_id")


@query("me04_memory_lists", sql("memories", rest="select user_name as user, count(*) as n, count(*) filter (status = 'active') as n_active, max(case when status = 'active' then doc_id end) as newest from memories group by 1"))
def me04(spark, sf):
    active = F.col("status") == "active"
    return corpus.memories(spark, sf).groupBy("user").agg(F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.max(F.when(active, F.col("doc_id"))).alias("newest"))


@query("me05_merged_memories", sql("memories", rest=""", m as (select * from memories), merges as (select doc_id as target, user_name, unnest([doc_id, doc_id + 1, doc_id + 7]) as source, case when doc_id % 4 = 0 then 1.4 end as score from m where doc_id % 5 = 0),
  into_ as (select source, user_name, min(target) as target from merges where source <> target group by all)
  select m.doc_id as id, case when m.doc_id % 5 = 0 then 'merged text' else content end as content, case when m.doc_id % 5 = 0 and m.doc_id % 4 = 0 then 1.0 else importance end as importance, confidence,
    case when i.target is not null then 'merged' else status end as status, cast(i.target as varchar) as merged_into from m left join into_ i on i.source = m.doc_id and i.user_name = m.user_name"""))
def me05(spark, sf):
    m = corpus.memories(spark, sf).select(F.col("doc_id").alias("id"), "user", "content", "importance", "confidence", "status", F.create_map(F.lit("from"), F.lit("test")).alias("details"))
    score = F.when(F.col("id") % 4 == 0, 1.4)
    merges = m.where("id % 5 = 0").select(
        F.col("id").alias("target"), "user", F.array(F.col("id"), F.col("id") + 1, F.col("id") + 7).alias("sources"), F.lit("merged text").alias("new_content"), score.alias("new_importance"), F.lit(None).cast("double").alias("new_confidence")
    )
    return mem.merged(m, merges).select("id", "content", "importance", "confidence", "status", F.element_at("details", "merged_into").alias("merged_into"))


@query("me08_consolidated_memories", sql("memories", rest=""", old as (select doc_id as id, user_name, case when doc_id % 2 = 0 then 'preference' else 'temporary_memory' end as type, title, content, importance, status, expires_at from memories),
  new as (select doc_id as key, user_name, case when doc_id % 3 = 0 then 'preference' else 'temporary_memory' end as type, lower(left(case when doc_id % 5 = 0 then 'nothing like it' else left(title, 8) end, 60)) as head from memories where doc_id % 2 = 0),
  hits as (select key, arg_min(o.id, (-o.importance, -epoch_us(o.expires_at), o.id)) as target from new n join old o on o.user_name = n.user_name and o.type = n.type and o.status = 'active' and (contains(lower(o.title), head) or contains(lower(o.content), head)) group by key)
  select n.key, n.user_name as user, n.type, case when h.key is null then 'insert' else 'merge' end as action, h.target from new n left join hits h using (key)"""))
def me08(spark, sf):
    m = corpus.memories(spark, sf)
    old = m.select(F.col("doc_id").alias("id"), "user", F.when(F.col("doc_id") % 2 == 0, "preference").otherwise("temporary_memory").alias("type"), "title", "content", "importance", "status", F.col("expires_at").alias("updated_at"))
    title = F.when(F.col("doc_id") % 5 == 0, "nothing like it").otherwise(F.substring("title", 1, 8))
    found = m.where("doc_id % 2 = 0").select(F.col("doc_id").alias("key"), "user", F.when(F.col("doc_id") % 3 == 0, "preference").when(F.col("doc_id") % 7 == 0, "general").otherwise("gossip").alias("category"), title.alias("title"))
    return mem.consolidated(old, found, ("preference", "fact"))


@query("sm09_expiry_batches", sql("memories", rest="select m.doc_id as id, case when d.doc_id is not null then 'expired' else status end as status from memories m left join (select doc_id from memories where status = 'active' and expires_at <= timestamp '2024-01-08' order by expires_at, doc_id limit 20) d on d.doc_id = m.doc_id"))
def sm09(spark, sf):
    m = corpus.memories(spark, sf).select(F.col("doc_id").alias("id"), "status", "expires_at")
    return mem.ended(m, F.lit("2024-01-08").cast("timestamp_ntz"), 20).select("id", "status")


@query("snk10_search_history", """with rows as (select event_id as id, user_id, case when event_id % 2 = 0 then upper(event_type) else event_type end || ' ' || (event_id % 4) as title, ts from events),
  last as (select * from rows qualify row_number() over (partition by user_id, lower(trim(title)) order by ts desc, id desc) = 1)
  select id, user_id, title from last qualify row_number() over (partition by user_id order by ts desc, id desc) <= 10""")
def snk10(spark, sf):
    title = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" "), (F.col("event_id") % 4).cast("string"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", title.alias("title"), "ts")
    return mem.kept_titles(rows, "user_id", "title", "ts", 10).select("id", "user_id", "title")


# ── jobs ──

_STATE = "case event_type when (select min(event_type) from events) then 'pending' when (select max(event_type) from events) then 'completed' else case when event_id % 9 = 0 then 'failed' else 'processing' end end"


@query("sm02_claimed_jobs", f"select event_id as id from events where event_type = 'view' and (event_id % 3 = 0 or ts + interval 1 hour <= timestamp '{NOW}') order by ts, event_id limit 5")
def sm02(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'")
    rows = e.select(F.col("event_id").alias("id"), F.lit("pending").alias("state"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.expr("interval 1 hour")).alias("next_at"))
    return jobs.claimed(rows, _now(), 5).select("id")


@query("sm04_retry_ladder", f"""with e as (select event_id as id, event_id % 5 as tries, props as error from events)
  select id, case when tries >= 3 then 'failed' else 'pending' end as state, case when tries >= 3 then tries else tries + 1 end as tries,
    case when tries < 3 then timestamp '{NOW}' + to_seconds(least(300, 2 ** (tries + 1))::bigint) end as next_at,
    case when tries >= 3 then 'Failed after ' || tries || '/3 attempts: ' else 'Attempt ' || (tries + 1) || '/3 failed: ' end || left(error, 500) as message from e""")
def sm04(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("tries"), F.col("props").alias("error"))
    return jobs.after_failure(e, _now())


@query("sm05_job_states", """with e as (select user_id as job, ts, event_id, case event_id % 9 when 0 then 'failed' when 1 then 'completed' when 2 then 'pending' else 'processing' end as state from events),
  ends as (select *, min(case when state in ('completed', 'failed') then (ts, event_id) end) over (partition by job) as over from e)
  select job, arg_max(state, (ts, event_id)) as state, count(*) as n_events, map {'pending': 'queued', 'processing': 'processing', 'completed': 'indexed', 'failed': 'failed'}[arg_max(state, (ts, event_id))] as document_state from ends where over is null or (ts, event_id) <= over group by job""")
def sm05(spark, sf):
    n = F.col("event_id") % 9
    state = F.when(n == 0, "failed").when(n == 1, "completed").when(n == 2, "pending").otherwise("processing")
    return jobs.current(table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state")))


@query("sm01_drained_queue", "select event_type, count(*) as n, count(distinct user_id) as n_users from events group by event_type")
def sm01(spark, sf):
    """A stream over the folder of events, some files at a time, drained into a table, which is then counted."""
    folder = scratch(spark, "queue")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(f"{sf}/events.parque[t]").select("event_id", "user_id", "event_type")
    windows.drain(stream, f"{folder}/jobs", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/jobs").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("cv01_conversation_states", "select user_id as conv_id, case arg_max(event_id % 4, (ts, event_id)) when 0 then 'archived' when 1 then 'deleted' else 'active' end as state, count(*) as n_changes from events group by user_id having arg_max(event_id % 4, (ts, event_id)) <> 1")
def cv01(spark, sf):
    """Conversations after their renamings, archivings, restorings and deletions, without those deleted."""
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("conv_id")).agg(F.max_by(F.col("event_id") % 4, F.struct("ts", "event_id")).alias("k"), F.count("*").alias("n_changes"))
    return last.where("k <> 1").select("conv_id", F.when(F.col("k") == 0, "archived").otherwise("active").alias("state"), "n_changes")


@query("sm12_answer_streams", "select conv_id, string_agg(text, '' order by turn) as answer, count(*) as n_tokens from conversations where role <> 'system' group by conv_id")
def sm12(spark, sf):
    """Streamed pieces put together in order, by answer."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return corpus.messages(spark, sf).where("role <> 'system'").groupBy("conv_id").agg(F.array_join(listed, "").alias("answer"), F.count("*").alias("n_tokens"))


# ── checks between stores ──

_POINTS = """act as (select doc_id as document, filename, text as content from docs where not deleted),
passages as (select document as chunk, document, 0 as chunk_index, content from act where document % 17 <> 0),
pts as (select vec_id as id, case when vec_id % 11 = 0 then vec_id + 1 else vec_id end as chunk, vec_id as document, case when vec_id % 7 = 0 then 'old.txt' else 'DOC-' || lpad(cast(vec_id as varchar), 6, '0') || '.txt' end as filename,
  case when vec_id % 5 = 0 then 1 else 0 end as chunk_index, case when vec_id % 6 = 0 then 'x' else d.text end as content from embeddings left join documents d on d.doc_id = vec_id)"""


def _points(spark, sf):
    active = corpus.documents(spark, sf).where("not deleted").select(F.col("doc_id").alias("document"), "filename", F.col("text").alias("content"))
    chunks = active.where("document % 17 <> 0").select(F.col("document").alias("chunk"), "document", F.lit(0).alias("chunk_index"), "content")
    v = F.col("vec_id")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    name = F.when(v % 7 == 0, "old.txt").otherwise(F.concat(F.lit("DOC-"), F.lpad(v.cast("string"), 6, "0"), F.lit(".txt")))
    points = table(spark, sf, "embeddings").select("vec_id").join(texts, "vec_id", "left").select(
        v.alias("id"), F.when(v % 11 == 0, v + 1).otherwise(v).alias("chunk"), v.alias("document"), name.alias("filename"), F.when(v % 5 == 0, 1).otherwise(0).alias("chunk_index"), F.when(v % 6 == 0, "x").otherwise(F.col("text")).alias("content")
    )
    return points, active, chunks


@query("in01_point_issues", sql("docs", rest=f""", {_POINTS}, j as (select p.*, a.filename as want, c.document as cd, c.chunk_index as ci, c.content as cc from pts p left join act a on a.document = p.document left join passages c on c.chunk = p.chunk),
issues as (select id, unnest(case when want is null then ['orphan'] when cd is null then ['missing passage'] else list_filter([case when document is distinct from cd then 'field document' end, case when filename is distinct from want then 'field filename' end,
  case when chunk_index is distinct from ci then 'field chunk_index' end, case when content is distinct from cc then 'field content' end, case when id is distinct from chunk then 'id' end], lambda x: x is not null) end) as issue from j) select id, issue from issues"""))
def in01(spark, sf):
    points, active, chunks = _points(spark, sf)
    return integrity.point_issues(points, active.select("document", "filename"), chunks)


@query("in02_repeated_passages", sql("docs", rest=f", {_POINTS} select chunk, count(*) as n from pts group by chunk having count(*) > 1"))
def in02(spark, sf):
    return integrity.repeated(_points(spark, sf)[0], ["chunk"])


@query("in03_different_sets", sql("docs", rest=f", {_POINTS}, e as (select document % 10 as g, chunk as i from passages), a as (select distinct document % 10 as g, chunk as i from pts), b as (select coalesce(e.g, a.g) as g, e.i as ei, a.i as ai from e full join a on e.g = a.g and e.i = a.i) select g as document, count(*) filter (ai is null) as n_missing, count(*) filter (ei is null) as n_extra from b group by g having count(*) filter (ai is null or ei is null) > 0"))
def in03(spark, sf):
    points, _, chunks = _points(spark, sf)
    by = lambda rows: rows.select((F.col("document") % 10).alias("document"), "chunk")
    return integrity.different_sets(by(chunks), by(points), "document", "chunk")


_GRAPH = """act as (select doc_id as document, filename from reports where doc_id % 13 <> 0), passages as (select doc_id as chunk, doc_id as document from reports where doc_id % 10 <> 4),
gn as (select 'n' || doc_id as id, case when doc_id % 9 <> 0 then doc_id end as document, case when doc_id % 5 = 0 then 'old.txt' else filename end as source, case when doc_id % 18 = 0 then 'u1' end as user_name, case when doc_id % 4 = 0 then doc_id - doc_id % 8 else doc_id end as chunk from reports),
ge as (select 'e' || doc_id as id, case when doc_id % 7 = 0 then doc_id + 1 else doc_id end as src_document, doc_id as dst_document, doc_id as document, case when doc_id % 3 = 0 then doc_id end as chunk, case when doc_id % 11 = 0 then 'old.txt' else filename end as source from reports)"""


def _graph(spark, sf):
    r, n = corpus.reports(spark, sf), F.col("doc_id")
    docs = r.select(n.alias("document"), "filename", (n % 13 == 0).alias("deleted"))
    chunks = r.where("doc_id % 10 <> 4").select(n.alias("chunk"), n.alias("document"))
    source = lambda k: F.when(n % k == 0, "old.txt").otherwise(F.col("filename")).alias("source")
    nodes = r.select(F.concat(F.lit("n"), n.cast("string")).alias("id"), F.when(n % 9 != 0, n).alias("document"), source(5), F.when(n % 18 == 0, "u1").alias("user"), F.when(n % 4 == 0, n - n % 8).otherwise(n).alias("chunk"))
    edges = r.select(F.concat(F.lit("e"), n.cast("string")).alias("id"), F.when(n % 7 == 0, n + 1).otherwise(n).alias("src_document"), n.alias("dst_document"), n.alias("document"), F.when(n % 3 == 0, n).alias("chunk"), source(11))
    return nodes, edges, docs, chunks


@query("in04_graph_issues", sql("reports", rest=f""", {_GRAPH}, nj as (select g.*, a.filename as want from gn g left join act a on a.document = g.document where g.document is not null or user_name is null),
ej as (select g.*, a.filename as want, c.document as cd from ge g left join act a on a.document = g.document left join passages c on c.chunk = g.chunk),
es as (select id, unnest(case when want is null then ['orphan'] else list_filter([case when src_document is distinct from document or dst_document is distinct from document then 'crossing' end, case when chunk is not null and cd is distinct from document then 'passage' end, case when source is distinct from want then 'source' end], lambda x: x is not null) end) as issue from ej)
select 'node' as kind, id, case when want is null then 'orphan' else 'source' end as issue from nj where want is null or source is distinct from want union all select 'edge', id, issue from es"""))
def in04(spark, sf):
    nodes, edges, docs, chunks = _graph(spark, sf)
    return integrity.graph_issues(nodes, edges, docs.where("not deleted").select("document", "filename"), chunks)


@query("in05_node_classes", sql("reports", rest=f""", {_GRAPH}, docs3 as (select doc_id as document, filename, doc_id % 13 = 0 as deleted from reports), by_name as (select filename, list(document) as ids from docs3 where not deleted group by filename),
j as (select g.*, d.filename as want, d.deleted, case when a.document is not null then c.document end as by_chunk, n.ids from gn g left join docs3 d on d.document = g.document left join passages c on c.chunk = g.chunk left join act a on a.document = c.document left join by_name n on n.filename = g.source),
m as (select *, list_distinct(list_filter(list_concat([by_chunk, case when not deleted then document end], coalesce(ids, [])), lambda x: x is not null)) as may from j), k as (select m.*, case when len(may) = 1 then may[1] end as meant from m),
s as (select k.id, k.meant, case when k.document is null and user_name is not null then 'valid' when k.meant is not null and (k.document is distinct from k.meant or k.source is distinct from t.filename) then 'inconsistent' when k.want is null or k.deleted then 'stale'
  when k.source is distinct from k.want then 'inconsistent' else 'valid' end as state from k left join docs3 t on t.document = k.meant) select *, case when state = 'stale' then 'remove' else 'keep' end as disposition from s"""))
def in05(spark, sf):
    nodes, _, docs, chunks = _graph(spark, sf)
    return integrity.classified_nodes(nodes, docs, chunks)


_DIGEST = "cast(sum(('0x' || substring(md5({0}), 1, 8))::bigint) as bigint)"


@query("in09_snapshot", "select 'documents' as name, count(*) as n, " + _DIGEST.format("doc_id || '|' || coalesce(text, '~')") + " as digest from documents union all select 'orders', count(*), " + _DIGEST.format("o_orderkey || '|' || o_orderstatus") + " from orders")
def in09(spark, sf):
    return integrity.snapshot(table(spark, sf, "documents"), "documents", ["doc_id", "text"]).union(integrity.snapshot(table(spark, sf, "orders"), "orders", ["o_orderkey", "o_orderstatus"]))


@query("in10_rechunk_comparison", sql("chunks", rest=", counts as (select document, count(*) as old_n, cast(ceil(sum(length(content)) / 512) as bigint) as new_n from chunks group by document) select document, cast(sum(old_n) as bigint) as old_n, cast(sum(new_n) as bigint) as new_n, cast(sum(new_n - old_n) as bigint) as delta, grouping(document)::int as total from counts group by grouping sets ((document), ())"))
def in10(spark, sf):
    """Passages of each document now and in chunks of 512 characters, and the sums."""
    counts = corpus.chunks(spark, sf).groupBy("document").agg(F.count("*").alias("old_n"), F.ceil(F.sum(F.length("content")) / 512).alias("new_n"))
    one = counts.select("document", "old_n", "new_n", (F.col("new_n") - F.col("old_n")).alias("delta"), F.lit(0).alias("total"))
    return one.union(counts.agg(F.lit(None).cast("bigint").alias("document"), F.sum("old_n"), F.sum("new_n"), F.sum(F.col("new_n") - F.col("old_n")), F.lit(1)))


@query("gr12_repair_plan", sql("nodes", "edges", "pnodes", "pedges", rest=""", free as (select id, type, name from pnodes where document is null), seen as (select distinct unnest([src, dst]) as id, document from pedges where document is not null),
pairs as (select f.*, s.document from free f join seen s using (id)), passages as (select 'doc-' || (s_suppkey % 5) as document, s_suppkey as chunk_index, 'Made in NATION_' || s_nationkey as content from supplier),
owned as (select id, p.document, arg_min(chunk_index, (not contains(lower(content), lower(name)), chunk_index)) as owner from pairs p join passages c on c.document = p.document group by all)
select p.id as old_id, p.document, substring(sha256(type || ':' || lower(name) || ':' || p.document), 1, 16) as new_id, owner from pairs p left join owned o on o.id = p.id and o.document = p.document"""))
def gr12(spark, sf):
    s = table(spark, sf, "supplier")
    passages = s.select(F.concat(F.lit("doc-"), (F.col("s_suppkey") % 5).cast("string")).alias("document"), F.col("s_suppkey").alias("chunk_index"), F.concat(F.lit("Made in NATION_"), F.col("s_nationkey").cast("string")).alias("content"))
    return integrity.repair_plan(corpus.placed_nodes(spark, sf), corpus.placed_edges(spark, sf), passages)


@query("jn20_passage_owners", sql("nodes", rest=""", passages as (select 'doc-' || (s_suppkey % 5) as document, s_suppkey as chunk_index, 'Made in NATION_' || s_nationkey as content from supplier)
  select n.id, p.document, arg_min(chunk_index, (not contains(lower(content), lower(name)), chunk_index)) as owner from nodes n cross join passages p where n.type = 'Nation' group by all"""))
def jn20(spark, sf):
    """The passage of each document that owns an entity: the first that names it, else the first. Asked for every nation in every document."""
    s = table(spark, sf, "supplier")
    passages = s.select(F.concat(F.lit("doc-"), (F.col("s_suppkey") % 5).cast("string")).alias("document"), F.col("s_suppkey").alias("chunk_index"), F.concat(F.lit("Made in NATION_"), F.col("s_nationkey").cast("string")).alias("content"))
    names = corpus.nodes(spark, sf).where("type = 'Nation'").select("id", "name")
    asked = names.select("id").crossJoin(passages.select("document").distinct())  # the pairs that are asked for, all of them answers
    return dictionary.owners(asked, names, passages)


# ── writes ──


@query("snk04_replaced_passages", "with old as (select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 3 <> 0), new as (select l_orderkey, l_linenumber, l_quantity + 1 as l_quantity from lineitem where l_orderkey % 2 = 0 and l_linenumber <> 2) select * from old where l_orderkey not in (select l_orderkey from new) union all select * from new")
def snk04(spark, sf):
    """Passages of documents processed anew replace the old ones; a document that gave none keeps its own."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return upserts.replaced_partition(l.where("l_orderkey % 3 <> 0"), l.where("l_orderkey % 2 = 0 and l_linenumber <> 2").withColumn("l_quantity", F.col("l_quantity") + 1), "l_orderkey")


@query("snk14_graph_build", sql("edges", rest=", given as (select *, case when src like '%7' then 'X' || dst else dst end as to_ from edges), nodes_ as (select src as id from edges union select dst from edges) select type, count(*) as given, count(*) filter (to_ in (select id from nodes_)) as written, count(*) filter (to_ not in (select id from nodes_)) as lost from given group by type"))
def snk14(spark, sf):
    """Edges given and written, by type: those without both ends are lost."""
    e = corpus.edges(spark, sf)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    given = e.withColumn("dst", F.when(F.col("src").endswith("7"), F.concat(F.lit("X"), "dst")).otherwise(F.col("dst")))
    count = lambda rows, name: rows.groupBy("type").agg(F.count("*").alias(name))
    out = count(given, "given").join(count(graph.valid_edges(given, nodes), "written"), "type", "left").na.fill(0)
    return out.withColumn("lost", F.col("given") - F.col("written"))


@query("snk15_delete_subgraph", sql("nodes", "edges", "pnodes", "pedges", rest=", left_edges as (select * from pedges where document is distinct from 'doc-1') select id from pnodes where document is distinct from 'doc-1' or id in (select src from left_edges union all select dst from left_edges)"))
def snk15(spark, sf):
    """Nodes after a document goes: its edges first, then its nodes that no other edge holds."""
    left = corpus.placed_edges(spark, sf).where("not (document <=> 'doc-1')")
    held = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("held", F.lit(True))
    n = corpus.placed_nodes(spark, sf).join(held, "id", "left")
    return n.where("not (document <=> 'doc-1') or held").select("id")


@query("snk18_partial_update", "select o.o_orderkey, coalesce(n.status, o.o_orderstatus) as o_orderstatus, coalesce(n.price, o.o_totalprice) as o_totalprice from orders o left join (select o_orderkey, case when o_orderkey % 2 = 0 then 'X' end as status, case when o_orderkey % 3 = 0 then 1.0 end as price from orders where o_orderkey % 5 = 0) n using (o_orderkey)")
def snk18(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, 1.0).alias("o_totalprice"))
    return upserts.patched(o, new, ["o_orderkey"])


@query("snk19_audit_appended", f"select event_id, event_type as action, ts from events union all select (select max(event_id) from events) + 1, 'audit', timestamp '{NOW}'")
def snk19(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("action"), "ts")
    return e.union(e.agg((F.max("event_id") + 1).alias("event_id"), F.lit("audit").alias("action"), _now().alias("ts")))


@query("snk21_backfilled_conversations", "select l.doc_id, c.conv_id from labels l left join (select distinct conv_id from conversations) c on case when l.doc_id % 2 = 0 then 'conversation:' || l.doc_id else 'auto' end = 'conversation:' || c.conv_id")
def snk21(spark, sf):
    source = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("conversation:"), F.col("doc_id").cast("string"))).otherwise("auto")
    known = corpus.messages(spark, sf).select("conv_id").distinct().withColumn("source", F.concat(F.lit("conversation:"), F.col("conv_id").cast("string")))
    return table(spark, sf, "labels").select("doc_id", source.alias("source")).join(known, "source", "left").select("doc_id", "conv_id")


@query("snk24_markdown_report", sql("docs", rest="select row_number() over (order by status) as line, '| ' || status || ' | ' || count(*) || ' |' as text from docs group by status"))
def snk24(spark, sf):
    """Lines of a table in Markdown; one for each state."""
    from pyspark.sql import Window as W

    n = corpus.documents(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return n.select(F.row_number().over(W.orderBy("status")).alias("line"), F.concat(F.lit("| "), "status", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("text"))


@query("snk26_full_reindex", "select vec_id, label as document, 'pending' as state, null::float[] as embedding from embeddings")
def snk26(spark, sf):
    """Every vector marked for a new one."""
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("document"), F.lit("pending").alias("state"), F.lit(None).cast("array<float>").alias("embedding"))


@query("snk27_backfill_actions", sql("chunks", rest=""", c as (select document, count(*) as n from chunks where document % 5 <> 0 group by document), v as (select vec_id as document, 1 as n from embeddings where vec_id % 3 <> 0),
  f as (select doc_id as document, coalesce(c.n, 0) as n_chunks, case when doc_id % 4 = 0 then 0 else coalesce(c.n, 0) end as n_embedded, case when v.n is null then 0 else coalesce(c.n, 0) end as n_points, coalesce(trim(text), '') <> '' and doc_id % 10 <> 5 as has_text from documents left join c on c.document = doc_id left join v on v.document = doc_id)
  select document, case when n_chunks > 0 then case when n_points >= n_embedded and n_embedded > 0 then 'skip' when n_embedded = 0 then 'embed' else 'reindex' end when has_text then 'chunk' else 'skip' end as action from f"""))
def snk27(spark, sf):
    c = corpus.chunks(spark, sf).where("document % 5 <> 0").groupBy("document").agg(F.count("*").alias("n"))
    v = table(spark, sf, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("document"), F.lit(True).alias("v"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document"), ((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("doc_id") % 10 != 5)).alias("has_text"))
    rows = d.join(c, "document", "left").join(v, "document", "left")
    n = F.coalesce("n", F.lit(0))
    return integrity.backfill_actions(rows.select("document", n.alias("n_chunks"), F.when(F.col("document") % 4 == 0, 0).otherwise(n).alias("n_embedded"), F.when(F.col("v"), n).otherwise(0).alias("n_points"), "has_text"))


# ── intake ──


@query("src01_decoded_texts", "select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as char_count from documents where trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def src01(spark, sf):
    """Bytes in UTF-8, or for every third document in Latin-1 where its text allows it, back to text."""
    d = table(spark, sf, "documents")
    plain = F.col("text").rlike(r"^[\x00-\xFF]*$") & (F.col("doc_id") % 3 == 0)
    return intake.decoded(d.select("doc_id", F.when(plain, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content")))


@query("src08_ocr_lines", sql("reports", rest=", words as (select doc_id, unnest(range(len(w))) as i, unnest(w) as word from (select doc_id, regexp_split_to_array(content, '\\s+') as w from reports)) select doc_id, i // 4 // 3 as block, i // 4 as line, string_agg(word, ' ' order by i) as text, round(avg(case when i % 5 <> 0 then 60 + i % 40 end), 6) as confidence from words group by all"))
def src08(spark, sf):
    """Words of a page, by block and line, as lines with their mean confidence; a negative confidence counts as none."""
    words = corpus.reports(spark, sf).select("doc_id", F.posexplode(F.split("content", r"\s+")).alias("i", "word"))
    block, line = F.floor(F.floor(F.col("i") / 4) / 3), F.floor(F.col("i") / 4)
    rows = words.select("doc_id", block.alias("block"), line.alias("line"), "i", "word", F.when(F.col("i") % 5 == 0, -1).otherwise(60 + F.col("i") % 40).alias("confidence"))
    return intake.ocr_lines(rows, ["doc_id", "block", "line"])


@query("src17_marked_pages", sql("reports", rest=", marked as (select doc_id, string_split(content, chr(10)) as p from reports) select doc_id, unnest(range(1, len(p) + 1))::int as page, trim(unnest(p)) as text from marked"))
def src17(spark, sf):
    """Texts with page marks between their lines, back to pages."""
    lines = F.transform(F.split("content", "\n"), lambda s, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), s, F.lit("\n")))
    return intake.marked_pages(corpus.reports(spark, sf).select("doc_id", F.array_join(lines, "").alias("text")))


@query("src23_admitted_uploads", """with u as (select doc_id, case doc_id % 6 when 0 then 'a.PDF' when 1 then 'b.png' when 2 then 'c.exe' when 3 then 'd.txt' when 4 then 'e' else 'f.docx' end as name,
  case doc_id % 6 when 0 then '%PDF-1.7' when 1 then 'GIF89a' when 3 then case when doc_id % 12 = 3 then '' else text end when 5 then 'PK' || chr(3) || chr(4) || 'x' else text end as content from documents)
  select doc_id, case when length(content) = 0 then 'empty' when octet_length(encode(content)) > 3000 then 'too large' when doc_id % 6 in (2, 4) then 'extension' when doc_id % 6 = 1 then 'content' else 'admitted' end as verdict from u""")
def src23(spark, sf):
    n = F.col("doc_id") % 6
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.PDF", "b.png", "c.exe", "d.txt", "e", "f.docx")]), (n + 1).cast("int"))
    content = F.when(n == 0, "%PDF-1.7").when(n == 1, "GIF89a").when((n == 3) & (F.col("doc_id") % 12 == 3), "").when(n == 5, "PK\x03\x04x").otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", name.alias("name"), content.cast("binary").alias("content"))
    return d.select("doc_id", intake.admission(F.col("name"), F.col("content"), most=3000).alias("verdict"))


@query("fn01_relative_times", "select event_id, case when s < 60 then 'now' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end as ago from (select event_id, epoch(timestamp '2024-02-15')::bigint - epoch(ts)::bigint as s from (select event_id, date_trunc('second', ts) as ts from events)) where s >= 0")
def fn01(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.where(F.col("ts") <= F.lit("2024-02-15").cast("timestamp")).select("event_id", intake.ago(F.col("ts"), F.lit("2024-02-15").cast("timestamp")).alias("ago"))
