"""Queries whose rows go through keyed tables on files and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.plans.registry import query
from docweave.session import scratch, table
from docweave.sinks.batches import BatchSink, Write
from docweave.sinks.keyed import KeyedTable
from docweave.sources import corpus
from docweave.sources.corpus import sql


def _table(spark, name: str, schema, keys: list[str], group: list[str] | None = None) -> KeyedTable:
    return KeyedTable(spark, scratch(spark, name), schema, keys, group, buckets=16)


@query("snk05_bulk_passages", sql("chunks", rest="select id, document, chunk_index, content, tokens from chunks"))
def snk05(spark, sf):
    """All passages in two batches, the second of which comes twice."""
    c = corpus.chunks(spark, sf).select("id", "document", "chunk_index", "content", "tokens")
    store = _table(spark, "passages", c.schema, ["id"], None)
    store.upsert(c.where("document % 2 = 0"), batch="even")
    for _ in range(2):
        store.upsert(c.where("document % 2 = 1"), batch="odd")
    return store.rows()


@query("snk06_states_by_id", "select vec_id as id, case when vec_id % 3 = 0 then 'embedded' when vec_id % 3 = 1 then 'failed' else 'pending' end as state, case when vec_id % 3 = 0 then embedding end as vector from embeddings")
def snk06(spark, sf):
    """Vectors and states of many rows at once, each with values of its own; a null leaves what was there."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    store = _table(spark, "states", "id bigint, state string, vector array<float>", ["id"])
    store.upsert(e.select(n.alias("id"), F.lit("pending").alias("state"), F.lit(None).cast("array<float>").alias("vector")))
    store.set_values(e.where("vec_id % 3 <> 2").select(n.alias("id"), F.when(n % 3 == 0, "embedded").otherwise("failed").alias("state"), F.when(n % 3 == 0, F.col("embedding")).alias("vector")), batch="1")
    return store.rows()


@query("snk07_texts_by_version", "select doc_id as document, v as version, case when v = 1 or doc_id % 5 = 0 then text else text || '!' end as text, coalesce(length(text), 0) as char_count from documents, (select unnest([1, 2]) as v) where v = 1 or doc_id % 3 = 0")
def snk07(spark, sf):
    """The extracted text of each version of a document; what is extracted again replaces it."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document"), "text")
    row = lambda rows, v, text: rows.select("document", F.lit(v).alias("version"), text.alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("char_count"))
    store = _table(spark, "texts", "document bigint, version int, text string, char_count int", ["document", "version"], ["document"])
    text = F.col("text")
    store.upsert(row(d, 1, text).union(row(d.where("document % 3 = 0"), 2, F.concat(text, F.lit("!")))), batch="first")
    store.upsert(row(d.where("document % 15 = 0"), 2, text), batch="again")
    return store.rows()


@query("snk09_snapshots", "select conv_id, turn, case when turn % 2 = 0 then text else role end as snapshot, case when turn % 2 = 0 then 2 else 1 end as created from (select conv_id, turn, min(text) as text, min(role) as role from conversations group by all)")
def snk09(spark, sf):
    """One snapshot for a turn of a conversation; a later one takes its place."""
    m = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    store = _table(spark, "snapshots", "conv_id bigint, turn bigint, snapshot string, created int", ["conv_id", "turn"], ["conv_id"])
    store.upsert(m.select("conv_id", "turn", F.col("role").alias("snapshot"), F.lit(1).alias("created")))
    store.upsert(m.where("turn % 2 = 0").select("conv_id", "turn", F.col("text").alias("snapshot"), F.lit(2).alias("created")))
    return store.rows()


class _Down(RuntimeError):
    """What the second store raises in sm13."""


@query("sm13_undone_batches", """select 'passages' as store, vec_id as id, 'batch 1' as state from embeddings where vec_id % 3 <> 0 union all select 'points', vec_id, 'batch 1' from embeddings where vec_id % 3 <> 0
  union all select 'passages', vec_id, 'batch 3' from embeddings where vec_id % 3 = 0 union all select 'points', vec_id, 'batch 3' from embeddings where vec_id % 3 = 0""")
def sm13(spark, sf):
    """Three batches to two stores. The second batch fails between them and is undone in both; the third comes twice."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    passages, points = _table(spark, "passages", "id bigint, state string", ["id"]), _table(spark, "points", "id bigint, state string", ["id"])

    def writes(rows, batch):
        yield Write(passages, "upsert", rows)
        if batch == "2":
            raise _Down("the second store doesn't answer")
        yield Write(points, "upsert", rows)

    sink = BatchSink(spark, scratch(spark, "sink"), [passages, points], writes)
    of = lambda n, where: e.where(where).withColumn("state", F.lit(f"batch {n}"))
    sink.apply(of(1, "id % 3 <> 0"), 1)
    try:
        sink.apply(of(2, "id % 2 = 0"), 2)
    except _Down:
        pass  # as asked for: both stores are as after the first batch
    for _ in range(2):
        sink.apply(of(3, "id % 3 = 0"), 3)
    name = lambda t, s: t.rows().select(F.lit(s).alias("store"), "id", "state")
    return name(passages, "passages").union(name(points, "points"))


_SPLIT = "old as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, 'N' as o_orderstatus, o_totalprice from orders where o_orderkey % 2 = 0)"


@query("snk01_stored_upsert", f"with {_SPLIT} select * from old where o_orderkey not in (select o_orderkey from new) union all select * from new")
def snk01_stored(spark, sf):
    """The upsert of snk01 on files, in two batches of changes."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))
    store = _table(spark, "orders", o.schema, ["o_orderkey"])
    store.upsert(o.where("o_orderkey % 3 <> 0"), batch="0")
    store.upsert(new.where("o_orderkey % 4 = 0"), batch="1")
    store.upsert(new.where("o_orderkey % 4 <> 0"), batch="2")
    return store.rows()


@query("snk04_stored_passages", "with l as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by all), old as (select * from l where l_orderkey % 3 <> 0), new as (select l_orderkey, l_linenumber, l_quantity + 1 as l_quantity from l where l_orderkey % 2 = 0 and l_linenumber <> 2) select * from old where l_orderkey not in (select l_orderkey from new) union all select * from new")
def snk04_stored(spark, sf):
    """Passages of documents processed anew on files: those of one document lie in one bucket and are replaced together."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    store = _table(spark, "lines", l.schema, ["l_orderkey", "l_linenumber"], ["l_orderkey"])
    store.upsert(l.where("l_orderkey % 3 <> 0"))
    store.replace_groups(l.where("l_orderkey % 2 = 0 and l_linenumber <> 2").withColumn("l_quantity", F.col("l_quantity") + 1))
    return store.rows()
