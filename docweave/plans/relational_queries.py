"""Queries of filters, sorts, joins, aggregations and windows over the application's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import relational as rel
from docweave.plans.registry import query
from docweave.plans.search_queries import _CONTEXT_HITS, _SEMANTIC, context_hits
from docweave.sources import corpus
from docweave.sources.corpus import sql, table

# filters, projections, pages


@query("flt01_document_list", sql("docs", rest="select doc_id, filename, status from docs where not deleted and (filename ilike '%THE%' or text ilike '%THE%') and status = 'review' and lang = 'en'"))
def flt01(spark, sf):
    return rel.documents_where(corpus.documents(spark, sf), search="THE", status="review", language="en").select("doc_id", "filename", "status")


@query("flt02_payload_filter", sql("docs", rest="select doc_id, lang, uploaded_by, created_at from docs where lang = 'de' and uploaded_by = 'src4' and created_at between timestamp '2024-01-01 01:00:00' and timestamp '2024-01-01 12:00:00'"))
def flt02(spark, sf):
    d = corpus.documents(spark, sf).where((F.col("lang") == "de") & (F.col("uploaded_by") == "src4"))
    return d.where(F.col("created_at").between(F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))).select("doc_id", "lang", "uploaded_by", "created_at")


@query("flt03_audit_filter", "select event_id, user_id, event_type from events where event_type = 'error' and cast(user_id as varchar) like '1%' and ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20'")
def flt03(spark, sf):
    e = table(spark, sf, "events").where((F.col("event_type") == "error") & F.col("user_id").cast("string").ilike("1%"))
    return e.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))).select("event_id", "user_id", "event_type")


@query("flt04_due_jobs", sql("docs", rest="select doc_id, status from docs where status = 'pending' and (doc_id % 3 = 0 or created_at + interval 5 minute <= timestamp '2024-01-01 06:00:00')"))
def flt04(spark, sf):
    due = F.when(F.col("doc_id") % 3 != 0, F.col("created_at") + F.expr("interval 5 minutes"))
    return corpus.documents(spark, sf).where("status = 'pending'").where(due.isNull() | (due <= F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))).select("doc_id", "status")


@query("flt06_conversations_filter", "select distinct conv_id from conversations where role = 'user' and text ilike '%the%'")
def flt06(spark, sf):
    return corpus.messages(spark, sf).where((F.col("role") == "user") & F.col("text").ilike("%the%")).select("conv_id").distinct()


@query("flt07_json_path", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') = '7'")
def flt07(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").where(k == "7").select("event_id", k.cast("long").alias("k"))


@query("flt08_point_lookup", "select doc_id, source from documents where doc_id = 42")
def flt08(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 42").select("doc_id", "source")


@query("flt09_junk_names", sql("docs", rest="select doc_id, filename from docs where filename in ('DOC-000003.txt', 'DOC-000007.txt') or filename ilike '%99%'"))
def flt09(spark, sf):
    d = corpus.documents(spark, sf)
    return d.where(F.col("filename").isin("DOC-000003.txt", "DOC-000007.txt") | F.col("filename").ilike("%99%")).select("doc_id", "filename")


@query("flt10_stale_documents", sql("docs", rest="select doc_id from docs where status <> 'indexed' and created_at < timestamp '2024-01-01 08:00:00' - interval 5 minute"))
def flt10(spark, sf):
    return corpus.documents(spark, sf).where((F.col("status") != "indexed") & (F.col("created_at") < F.lit("2024-01-01 08:00:00").cast("timestamp_ntz") - F.expr("interval 5 minutes"))).select("doc_id")


@query("flt11_cross_document_facts", "select l_orderkey, l_linenumber from lineitem where l_returnflag = l_linestatus or l_returnflag = 'A'")
def flt11(spark, sf):
    """Facts whose parts name one document: a part that is empty (flag A) names none."""
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("")
    return table(spark, sf, "lineitem").where(rel.one_document([flag, F.col("l_linestatus")])).select("l_orderkey", "l_linenumber")


@query("flt12_facts_of_scope", sql("facts", "points", rest=f", {_SEMANTIC}, {_CONTEXT_HITS} select * from facts where lower(document) in (select document from hits)"))
def flt12(spark, sf):
    """Facts of the documents that a search over all points retrieves."""
    scope = context_hits(spark, sf).select(F.col("document").alias("scope"))
    f = corpus.facts(spark, sf)
    return f.join(scope, F.lower("document") == F.col("scope"), "left_semi")


@query("flt14_informative_facts", sql("facts", rest="select * from facts where relationship is not null and target <> '' and target not in ('T1', 'UNKNOWN')"))
def flt14(spark, sf):
    return corpus.facts(spark, sf).where(F.col("relationship").isNotNull() & (F.col("target") != "") & ~F.col("target").isin("T1", "UNKNOWN"))


@query("flt15_role_permissions", "select distinct role, p as permission from conversations join (select 'user' as r, unnest(['read', 'ask']) as p union all select 'assistant', 'answer' union all select 'system', 'configure') on role = r")
def flt15(spark, sf):
    allowed = spark.createDataFrame([("user", "read"), ("user", "ask"), ("assistant", "answer"), ("system", "configure")], "role string, permission string")
    return corpus.messages(spark, sf).select("role").distinct().join(F.broadcast(allowed), "role")


@query("prj01_truncated_content", "select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as preview from documents")
def prj01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


@query("prj02_latest_version", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderstatus = 'O' desc, o_orderdate desc, o_orderkey) = 1")
def prj02(spark, sf):
    order = [(F.col("o_orderstatus") == "O").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return rel.latest(table(spark, sf, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("prj03_page_facts", "select status, count(*) as total, cast(greatest(ceil(count(*) / 20), 1) as bigint) as total_pages, 3 < ceil(count(*) / 20) as has_next, true as has_previous from (select o_orderstatus as status from orders) group by status")
def prj03(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).select("status", *rel.page_facts(F.col("n"), 3, 20))


@query("prj04_view_mapping", sql("docs", rest="select doc_id, coalesce(nullif(status, 'pending'), 'queued') as state, case when n_chars >= 10000 then 'large' when n_chars >= 1000 then 'medium' else 'small' end as size_class from docs"))
def prj04(spark, sf):
    size = F.when(F.col("n_chars") >= 10000, "large").when(F.col("n_chars") >= 1000, "medium").otherwise("small")
    return corpus.documents(spark, sf).select("doc_id", F.coalesce(F.nullif(F.col("status"), F.lit("pending")), F.lit("queued")).alias("state"), size.alias("size_class"))


# sorts


@query("sr01_recent_page", sql("docs", rest="select doc_id, created_at from docs where not deleted order by created_at desc, doc_id limit 20 offset 20"))
def sr01(spark, sf):
    return rel.page(corpus.documents(spark, sf).where("not deleted").select("doc_id", "created_at"), [F.col("created_at").desc(), F.col("doc_id")], 2, 20)


@query("sr02_search_history_order", "select event_id, ts from events where event_type = 'view' order by ts desc, event_id desc limit 10")
def sr02(spark, sf):
    return table(spark, sf, "events").where("event_type = 'view'").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10)


@query("sr03_chunks_in_order", sql("chunks", rest="select id, chunk_index from chunks where document = 5 order by chunk_index"))
def sr03(spark, sf):
    return corpus.chunks(spark, sf).where("document = 5").select("id", "chunk_index").orderBy("chunk_index")


@query("sr11_claim_batches", sql("docs", rest="select doc_id, created_at from docs where status = 'pending' order by created_at, doc_id limit 5"))
def sr11(spark, sf):
    return corpus.documents(spark, sf).where("status = 'pending'").select("doc_id", "created_at").orderBy("created_at", "doc_id").limit(5)


# joins


@query("jn01_versions_of_documents", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' and o_orderstatus <> 'F'")
def jn01(spark, sf):
    o, c = table(spark, sf, "orders").where("o_orderstatus <> 'F'"), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name")


@query("jn02_documents_with_chunks", sql("chunks", "docs", rest="select filename, c.id, c.tokens from docs d join chunks c on d.doc_id = c.document where not deleted"))
def jn02(spark, sf):
    d, c = corpus.documents(spark, sf).where("not deleted").select("doc_id", "filename"), corpus.chunks(spark, sf)
    return d.join(c, d["doc_id"] == c["document"]).select("filename", "id", "tokens")


@query("jn03_latest_text_chunks", "with v as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1) select c_custkey, o_orderkey, l_linenumber from customer join v on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey and l_quantity > 25")
def jn03(spark, sf):
    last = rel.latest(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    lines = table(spark, sf, "lineitem").where("l_quantity > 25")
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber")


@query("jn04_left_latest", "select c_custkey, o_orderkey from customer left join (select * from orders where o_orderpriority = '1-URGENT' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1) on c_custkey = o_custkey")
def jn04(spark, sf):
    last = rel.latest(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("jn05_conversation_counts", "select d.doc_id as conv_id, coalesce(n, 0) as n_messages from documents d left join (select conv_id, count(*) as n from conversations group by 1) on d.doc_id = conv_id")
def jn05(spark, sf):
    counts = corpus.messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"))
    return ids.join(counts, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n_messages"))


@query("jn06_lateral_latest_job", "select c_custkey, o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) on true")
def jn06(spark, sf):
    """The latest order of each customer, one for each customer; dates and keys that are null come last, as in SQL."""
    last = rel.latest(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]).select("o_custkey", "o_orderkey")
    return table(spark, sf, "customer").join(last.hint("merge"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("jn07_not_extracted", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def jn07(spark, sf):
    return rel.not_in(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("jn08_without_chunks", sql("chunks", rest="select doc_id from documents where doc_id not in (select document from chunks where length(content) > 400)"))
def jn08(spark, sf):
    """Documents without a long passage."""
    held = corpus.chunks(spark, sf).where("length(content) > 400").select(F.col("document").alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(held, "doc_id", "left_anti")


@query("jn09_single_version", "select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) <= 1")
def jn09(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").where(F.coalesce("n", F.lit(0)) <= 1).select("c_custkey")


@query("jn10_users_of_role", "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where n_name like '%A%'")
def jn10(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation").where("n_name like '%A%'"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", "n_name")


@query("jn11_nested_rows", "select n_nationkey, cast(count(s_suppkey) as bigint) as n, string_agg(s_name, ',' order by s_name) as names from nation left join supplier on n_nationkey = s_nationkey group by 1")
def jn11(spark, sf):
    joined = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    names = F.array_join(F.array_sort(F.collect_list("s_name")), ",")
    return joined.groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"), F.when(names != "", names).alias("names"))


# aggregations


@query("ag01_filtered_counts", sql("docs", rest="select count(*) filter (not deleted) as documents, count(*) filter (status = 'failed') as failed, count(*) filter (not deleted and lang = 'fr') as french from docs"))
def ag01(spark, sf):
    return corpus.documents(spark, sf).agg(F.count_if(~F.col("deleted")).alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.col("deleted") & (F.col("lang") == "fr")).alias("french"))


@query("ag02_messages_per_conversation", "select conv_id, count(*) as n from conversations group by 1")
def ag02(spark, sf):
    return corpus.messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("ag03_chunks_per_document", sql("chunks", rest="select document, count(*) as n from chunks group by 1 order by n desc, document limit 50"))
def ag03(spark, sf):
    return corpus.chunks(spark, sf).groupBy("document").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document").limit(50)


@query("ag04_chunk_statistics", sql("chunks", rest="select document, count(*) as n, round(avg(tokens), 6) as avg_tokens, max(tokens) as max_tokens, min(tokens) as min_tokens, cast(sum(tokens) as bigint) as sum_tokens, round(sum(length(content)) / count(*), 6) as avg_chars from chunks group by 1"))
def ag04(spark, sf):
    c = corpus.chunks(spark, sf).groupBy("document")
    return c.agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 6).alias("avg_tokens"), F.max("tokens").alias("max_tokens"), F.min("tokens").alias("min_tokens"), F.sum("tokens").alias("sum_tokens"), F.round(F.sum(F.length("content")) / F.count("*"), 6).alias("avg_chars"))


@query("ag05_token_estimates", sql("chunks", rest="select document, cast(sum(tokens) as bigint) as tokens, cast(sum(length(content)) // 4 as bigint) as by_four, cast(ceil(sum(length(content)) / 500) as bigint) as chunks_500 from chunks group by 1"))
def ag05(spark, sf):
    chars = F.sum(F.length("content"))
    return corpus.chunks(spark, sf).groupBy("document").agg(F.sum("tokens").alias("tokens"), F.floor(chars / 4).alias("by_four"), F.ceil(chars / 500).alias("chunks_500"))


@query("ag10_status_flags", sql("docs", rest="select uploaded_by, count(*) as n, count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'failed') as failed, bool_and(status <> 'failed') as none_failed, bool_or(deleted) as some_deleted from docs group by 1"))
def ag10(spark, sf):
    return corpus.documents(spark, sf).groupBy("uploaded_by").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.bool_and(F.col("status") != "failed").alias("none_failed"), F.bool_or("deleted").alias("some_deleted"))


@query("ag11_index_summary", sql("chunks", "docs", rest="select uploaded_by, cast(sum(tokens) as bigint) as tokens, round(avg(tokens), 1) as avg_tokens, min(page) || '-' || max(page) as pages, string_agg(distinct lang, ',' order by lang) as languages, max(created_at) as newest from docs join chunks on doc_id = document group by 1"))
def ag11(spark, sf):
    joined = corpus.documents(spark, sf).join(corpus.chunks(spark, sf), F.col("doc_id") == F.col("document"))
    return joined.groupBy("uploaded_by").agg(F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 1).alias("avg_tokens"), F.concat_ws("-", F.min("page").cast("string"), F.max("page").cast("string")).alias("pages"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"), F.max("created_at").alias("newest"))


@query("ag13_surest_edges", "select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_discount from lineitem qualify row_number() over (partition by l_partkey, l_suppkey order by l_discount desc, l_orderkey, l_linenumber) = 1")
def ag13(spark, sf):
    order = [F.col("l_discount").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return rel.latest(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_discount"), ["l_partkey", "l_suppkey"], order)


@query("ag18_means_and_percentiles", "select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1")
def ag18(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    means = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return rel.with_columns_of(means, rel.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}), "event_type").withColumns({p: F.round(p, 6) for p in ("p50", "p95")})


@query("ag19_latency_histogram", "select event_type, count(*) as n, round(sum(value), 4) as total, round(min(value), 4) as low, round(max(value), 4) as high, round(list_sort(list(value))[cast(floor(count(*) * 0.95) as int) + 1], 4) as p95, count(*) filter (value <= 10) as le_10, count(*) filter (value <= 50) as le_50 from events group by 1")
def ag19(spark, sf):
    """Counts, and the value at place int(n * 0.95) by counts of equal values, so that no group's values meet in one task."""
    e = table(spark, sf, "events").select("event_type", "value")
    counts = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.count_if(F.col("value") <= 10).alias("le_10"), F.count_if(F.col("value") <= 50).alias("le_50"))
    at = rel.values_at(e, "event_type", "value", {"p95": lambda n: F.floor(n * 0.95)})
    return rel.with_columns_of(counts, at, "event_type").withColumn("p95", F.round("p95", 4))


@query("ag20_counters_and_gauges", "select event_type, count(*) as n, arg_max(value, ts || '-' || lpad(cast(event_id as varchar), 12, '0')) as last_value from events group by 1")
def ag20(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("ag21_rates", "select user_id, round(count(*) filter (event_type = 'purchase') / nullif(cast(count(*) filter (event_type = 'view') as double), 0), 6) as conversion from events group by 1")
def ag21(spark, sf):
    bought, seen = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.when(seen > 0, bought / seen), 6).alias("conversion"))


@query("ag26_dashboard", sql("docs", "chunks", rest="select (select count(*) from docs where not deleted) as documents, (select count(*) from chunks) as chunks, (select count(distinct conv_id) from conversations) as conversations, (select string_agg(cast(doc_id as varchar), ',' order by created_at desc) from (select * from docs order by created_at desc, doc_id limit 5)) as newest"))
def ag26(spark, sf):
    d = corpus.documents(spark, sf)
    newest = d.select("doc_id", "created_at").orderBy(F.col("created_at").desc(), "doc_id").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "doc_id")), False), lambda s: s["doc_id"].cast("string")), ",").alias("newest"))
    one = d.agg(F.count_if(~F.col("deleted")).alias("documents")).crossJoin(corpus.chunks(spark, sf).agg(F.count("*").alias("chunks")))
    return one.crossJoin(corpus.messages(spark, sf).agg(F.count_distinct("conv_id").alias("conversations"))).crossJoin(newest)


@query("ag27_storage_inventory", sql("docs", rest="select uploaded_by, count(*) as files, cast(sum(octet_length(encode(text))) as bigint) as bytes, count(*) filter (n_chars <> length(text)) as mismatches from docs group by 1"))
def ag27(spark, sf):
    return corpus.documents(spark, sf).groupBy("uploaded_by").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("n_chars") != F.length("text")).alias("mismatches"))


@query("ag28_findings_pivot", "select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase from events group by 1")
def ag28(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).count().fillna(0)


@query("ag29_fingerprints", sql("chunks", rest="select document, sha256(string_agg(content, chr(30) order by chunk_index)) as fingerprint from chunks group by 1"))
def ag29(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return corpus.chunks(spark, sf).groupBy("document").agg(F.sha2(F.array_join(F.transform(ordered, lambda s: s["content"]), "\u001e"), 256).alias("fingerprint"))


@query("ag30_payload_keys", "select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by 1")
def ag30(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("ag32_mean_confidence", sql("facts", rest="select document, round(avg(confidence), 6) as mean, count(*) filter (confidence < 0.7) as low from facts group by 1"))
def ag32(spark, sf):
    return corpus.facts(spark, sf).groupBy("document").agg(F.round(F.avg("confidence"), 6).alias("mean"), F.count_if(F.col("confidence") < 0.7).alias("low"))


# windows


@query("wn04_distinct_in_order", "select user_id, string_agg(event_type, ',' order by first_ts, first_id) as kinds from (select user_id, event_type, min(ts) as first_ts, arg_min(event_id, (ts, event_id)) as first_id from events group by 1, 2) group by 1")
def wn04(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda s: s["event_type"]), ",").alias("kinds"))


@query("wn06_page_of_offset", sql("chunks", rest=""", pages as (select document, chunk_index as page, sum(length(content) + 2) over (partition by document order by chunk_index) as e, length(content) as l, row_number() over (partition by document order by chunk_index desc) as back from chunks)
select o.document, o.off as offset, p.page from (select doc_id as document, unnest([0, 100, 5000]) as off from documents) o join pages p on o.document = p.document and o.off >= p.e - p.l - 2 and (o.off < p.e or back = 1)"""))  # fmt: skip
def wn06(spark, sf):
    pages = corpus.chunks(spark, sf).select("document", F.col("chunk_index").alias("page"), F.col("content").alias("text"))
    offsets = table(spark, sf, "documents").select(F.col("doc_id").alias("document"), F.explode(F.array(F.lit(0), F.lit(100), F.lit(5000))).alias("offset"))
    return rel.page_of_offset(pages, offsets)


@query("wn09_chunk_numbers", sql("chunks", rest="select id, cast(row_number() over (partition by document order by chunk_index) - 1 as int) as place, count(*) over (partition by document) as total from chunks"))
def wn09(spark, sf):
    own = W.partitionBy("document")
    return corpus.chunks(spark, sf).select("id", (F.row_number().over(own.orderBy("chunk_index")) - 1).alias("place"), F.count("*").over(own).alias("total"))


@query("wn13_latest_job", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n from events group by 1")
def wn13(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))


@query("wn15_evicted", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) > 20")
def wn15(spark, sf):
    own = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf, "events").withColumn("n", F.row_number().over(own)).where("n > 20").select("user_id", "event_id")


# set operations


@query("st03_id_differences", "(select doc_id, 'no label' as what from documents except all select doc_id, 'no label' from labels) union all (select vec_id, 'no document' from embeddings except all select doc_id, 'no document' from documents)")
def st03(spark, sf):
    d, l, e = (table(spark, sf, t) for t in ("documents", "labels", "embeddings"))
    one = d.select("doc_id", F.lit("no label").alias("what")).exceptAll(l.select("doc_id", F.lit("no label")))
    return one.unionAll(e.select("vec_id", F.lit("no document")).exceptAll(d.select("doc_id", F.lit("no document"))))


@query("st04_common_to_all", "select user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'error' intersect select user_id from events where event_type = 'purchase'")
def st04(spark, sf):
    of = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).select("user_id")
    return of("click").intersect(of("error")).intersect(of("purchase"))


@query("st06_add_missing_nodes", sql("nodes", rest="select id, type from nodes where type in ('Region', 'Nation') union select id, type from nodes where type in ('Nation', 'Supplier')"))
def st06(spark, sf):
    n = corpus.nodes(spark, sf).select("id", "type")
    return n.where("type in ('Region', 'Nation')").union(n.where("type in ('Nation', 'Supplier')")).dropDuplicates(["id"])
