"""Queries of conversations, memories, evaluation, reconciliation and job state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.config import DIALOGUE
from docweave.functions import vectors as vx
from docweave.operators import jobs, upserts
from docweave.operators import relational as rel
from docweave.operators.nearest import nearest
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql, table


@query("wn10_history_window", f"""select conv_id, turn, text from (
  select *, max(case when role = 'user' then back end) over (partition by conv_id) as first from (
    select *, sum(least(length(text), {DIALOGUE.message_chars})) over (partition by conv_id order by turn desc) as chars from (
      select conv_id, turn, role, substring(text, 1, {DIALOGUE.message_chars}) as text, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= {DIALOGUE.history_messages})
  where chars <= {DIALOGUE.history_chars}) where back <= first""")
def wn10(spark, sf):
    """The last messages within the budgets, from a user's turn on."""
    own = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = corpus.messages(spark, sf).withColumn("back", F.row_number().over(own)).where(F.col("back") <= DIALOGUE.history_messages)
    m = m.withColumn("text", F.substring("text", 1, DIALOGUE.message_chars)).withColumn("chars", F.sum(F.length("text")).over(own)).where(F.col("chars") <= DIALOGUE.history_chars)
    m = m.withColumn("first", F.max(F.when(F.col("role") == "user", F.col("back"))).over(W.partitionBy("conv_id")))
    return m.where("back <= first").select("conv_id", "turn", "text")


@query("wn14_last_answer", "select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'assistant' group by conv_id")
def wn14(spark, sf):
    return corpus.messages(spark, sf).where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query("wn16_latest_mention", "select conv_id, max(turn) as turn from conversations where regexp_matches(text, '(?i)\\bthe\\b') and role <> 'system' group by conv_id")
def wn16(spark, sf):
    return corpus.messages(spark, sf).where(F.col("text").rlike(r"(?i)\bthe\b") & (F.col("role") != "system")).groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("me01_memory_search", sql("memories", rest=""", q as (select embedding as v from embeddings where vec_id = 0)
  select doc_id, round(0.6 * list_cosine_similarity(vector::double[], (select v from q)::double[]) + 0.3 * importance + 0.1 * confidence, 6) as score from memories where status = 'active'"""))
def me01(spark, sf):
    m = corpus.memories(spark, sf).where("status = 'active'")
    sure = 0.6 * vx.cosine(F.col("vector"), vx.literal_vector(corpus.query_vector(spark, sf))) + 0.3 * F.col("importance") + 0.1 * F.col("confidence")
    return m.select("doc_id", F.round(sure, 6).alias("score"))


@query("me02_memory_keywords", sql("memories", rest="select doc_id, 0.7 * importance + 0.3 * confidence as score from memories where status = 'active' and (title ilike '%en%' or content ilike '%en%')"))
def me02(spark, sf):
    m = corpus.memories(spark, sf).where((F.col("status") == "active") & (F.col("title").ilike("%en%") | F.col("content").ilike("%en%")))
    return m.select("doc_id", (0.7 * F.col("importance") + 0.3 * F.col("confidence")).alias("score"))


@query("me06_blended_memories", sql("memories", rest="select doc_id, least(1, greatest(0, 0.6 * importance + 0.4 * 0.9)) as importance, 0.5 * confidence + 0.5 * 0.8 as confidence, content || chr(10) || title as content from memories"))
def me06(spark, sf):
    return corpus.memories(spark, sf).select("doc_id", vx.clamp(0.6 * F.col("importance") + 0.4 * 0.9).alias("importance"), (0.5 * F.col("confidence") + 0.5 * 0.8).alias("confidence"), F.concat("content", F.lit("\n"), "title").alias("content"))


@query("me07_expired_memories", sql("memories", rest="select doc_id, case when status = 'active' and expires_at <= timestamp '2024-01-03' then 'expired' else status end as status from memories"))
def me07(spark, sf):
    m = corpus.memories(spark, sf).select("doc_id", "status", "expires_at")
    due = (F.col("status") == "active") & (F.col("expires_at") <= F.lit("2024-01-03").cast("timestamp_ntz"))
    return upserts.updated(m, due, {"status": F.lit("expired")}).drop("expires_at")


@query("el10_slices", "select case when grouping(lang) = 1 then 'all' else coalesce(lang, '(none)') end as slice, count(*) as n, avg(quality) as quality, quantile_cont(n_chars, 0.95) as p95 from documents join labels using (doc_id) group by grouping sets ((lang), ())")
def el10(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "quality", "n_chars")
    one, every = F.struct(F.col("lang"), F.lit(False).alias("whole")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("whole"))
    d = d.select(F.explode(F.array(one, every)).alias("key"), "quality", "n_chars")
    means = d.groupBy("key").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"))
    return rel.with_columns_of(means, rel.percentiles(d, "key", "n_chars", {"p95": 0.95}), "key").select(F.when(F.col("key.whole"), "all").otherwise(F.coalesce("key.lang", F.lit("(none)"))).alias("slice"), "n", "quality", "p95")


@query("el11_floors", "select count(*) filter (quality = 1) / count(*)::double as good, count(*) filter (quality = 1) / count(*)::double >= 0.5 as passed from labels")
def el11(spark, sf):
    share = F.count_if(F.col("quality") == 1) / F.count("*")
    return table(spark, sf, "labels").agg(share.alias("good"), (share >= 0.5).alias("passed"))


@query("in06_dimensions", "select len(embedding)::int as dims, count(*) as n from embeddings group by all")
def in06(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


@query("in08_chunk_warnings", sql("chunks", rest="select count(*) filter (trim(content) = '') as blank, count(*) filter (tokens = 0) as empty, count(*) filter (tokens > 200) as large from chunks"))
def in08(spark, sf):
    return corpus.chunks(spark, sf).agg(F.count_if(F.trim("content") == "").alias("blank"), F.count_if(F.col("tokens") == 0).alias("empty"), F.count_if(F.col("tokens") > 200).alias("large"))


_SPLIT = "old as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, 'N' as o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0)"


def _split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


@query("snk01_upsert", f"with {_SPLIT} select * from old where o_orderkey not in (select o_orderkey from new) union all select * from new")
def snk01(spark, sf):
    return upserts.upserted(*_split(spark, sf), ["o_orderkey"])


@query("snk08_insert_missing", f"with {_SPLIT} select * from old union all select * from new where o_orderkey not in (select o_orderkey from old)")
def snk08(spark, sf):
    return upserts.inserted(*_split(spark, sf), ["o_orderkey"])


@query("snk03_update_where", "select o_orderkey, case when o_totalprice > 100000 then 'L' else o_orderstatus end as o_orderstatus from orders")
def snk03(spark, sf):
    return upserts.updated(table(spark, sf, "orders"), F.col("o_totalprice") > 100000, {"o_orderstatus": F.lit("L")}).select("o_orderkey", "o_orderstatus")


@query("snk02_deleted_rows", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def snk02_deleted(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return upserts.deleted(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("sm03_expired_leases", "select event_id, case when expired and tries + 1 > 3 then 'failed' when expired then 'pending' else 'processing' end as state, case when expired then tries + 1 else tries end as tries from (select event_id, event_id % 5 as tries, ts <= timestamp '2024-01-15' - interval 2100 second as expired from events where event_type = 'view')")
def sm03(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'").select("event_id", (F.col("event_id") % 5).alias("tries"), F.col("ts").alias("claimed_at"))
    return jobs.expired_leases(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "state", "tries")


@query("sm07_rate_limit", "select event_id, count(*) over (partition by user_id order by ts range between interval 3600 second preceding and current row) <= 2 as allowed from events")
def sm07(spark, sf):
    return jobs.rate_limited(table(spark, sf, "events"), "user_id", most=2, seconds=3600).select("event_id", "allowed")


@query("sm11_event_windows", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def sm11(spark, sf):
    from docweave.streaming import windows

    return windows.counted(table(spark, sf, "events"), "1 day")
