"""Queries of search, fusion, ranking and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.functions import vectors as vx
from docweave.operators import dictionary, search
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql, table

ASKED = "Where is the rent of P-101 and the thing that was heard with erin?"
TERMS = ["P-101", "heard", "thing", "rent", "erin"]
TERMS_SQL = "['P-101', 'heard', 'thing', 'rent', 'erin']"
NOW = "2024-06-01"

_COSINE = "list_cosine_similarity(cast(vector as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"
_SEMANTIC = f"semantic as (select id, document, round({_COSINE}, 9) as score from points)"
_COVER = f"round(cast(len(list_filter({TERMS_SQL}, lambda t: contains(lower(content), lower(t)))) as double) / 5, 9)"
_KEYWORD = f"words as (select doc_id as id, {_COVER} as score from (select doc_id, text as content from documents) where {_COVER} > 0)"


def _vector(spark: SparkSession, sf: str):
    return vx.literal_vector(corpus.query_vector(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _arms(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    return search.semantic(corpus.points(spark, sf), _vector(spark, sf), k), search.keyword(_texts(spark, sf), tx.strings(TERMS), k).select("id", "score")


@query("se01_semantic_search", sql("points", rest=f", {_SEMANTIC} select id, document, score from semantic order by score desc, id limit 20 offset 5"))
def se01(spark, sf):
    return search.semantic(corpus.points(spark, sf), _vector(spark, sf), 20, offset=5)


@query("se02_keyword_search", f"with {_KEYWORD} select id, score from words order by score desc, id limit 25")
def se02(spark, sf):
    return search.keyword(_texts(spark, sf), tx.strings(TERMS), 25).select("id", "score")


_FUSED = f"""{_SEMANTIC}, {_KEYWORD},
a as (select id, score, row_number() over (order by score desc, id) as rank from (select * from semantic order by score desc, id limit 40)),
b as (select id, score, row_number() over (order by score desc, id) as rank from (select * from words order by score desc, id limit 40)),
hits as (select *, 0 as arm from a union all select *, 1 from b),
fused as (select id, round(case when (select count(distinct arm) from hits) > 1 then sum(1.0 / (60 + rank)) else max(score) end, 9) as score, cast(count(*) as int) as n_arms from hits group by id)"""


@query("se03_hybrid_search", sql("points", rest=f", {_FUSED} select id, score, n_arms from fused order by score desc, id limit 20"))
def se03(spark, sf):
    return search.hybrid(corpus.points(spark, sf), _vector(spark, sf), _texts(spark, sf), tx.strings(TERMS), 20)


_CANDIDATES = f"""{_SEMANTIC}, {_KEYWORD},
arms as (select coalesce(a.id, b.id) as id, a.score as semantic, b.score as keyword from (select * from semantic order by score desc, id limit 60) a full join (select * from words order by score desc, id limit 60) b on a.id = b.id)"""


@query("st01_union_of_arms", sql("points", rest=f", {_CANDIDATES} select id, semantic, keyword from arms"))
def st01(spark, sf):
    return search.union_arms(*_arms(spark, sf, 60))


_FRACTION = "case when len(asked) > 0 then cast(len(list_filter(asked, lambda w: list_contains(have, w))) as double) / len(asked) else 0.0 end"


@query("se04_ranked_search", sql("points", "docs", rest=f""", {_CANDIDATES},
joined as (select a.*, regexp_extract_all(lower(d.lang || ' ' || d.uploaded_by || ' ' || d.status), '[a-z0-9]+') as have, ['en', 'src1'] as asked, d.created_at from arms a left join docs d on a.id = d.doc_id)
select id, round(coalesce(semantic, 0) * 0.35 + coalesce(keyword, 0) * 0.30 + coalesce({_FRACTION}, 0) * 0.20
  + (case when created_at is null then 0 when created_at > timestamp '{NOW}' then 1 else exp(-(epoch(timestamp '{NOW}') - epoch(created_at)) / 86400.0 / 365) end) * 0.15, 6) as score
from joined order by score desc, id limit 30"""))  # fmt: skip
def se04(spark, sf):
    docs = corpus.documents(spark, sf)
    fields = docs.select(F.col("doc_id").alias("id"), tx.match_fraction(tx.strings(["en", "src1"]), F.concat_ws(" ", "lang", "uploaded_by", "status")).alias("metadata"), F.col("created_at").alias("uploaded"))
    joined = search.union_arms(*_arms(spark, sf, 60)).join(fields, "id", "left")
    ranked = search.weighted(joined, F.lit(NOW).cast("timestamp_ntz").cast("timestamp"), 60)
    return search.top(ranked.select("id", F.round("score", 6).alias("score")), 30)


@query("se05_keyword_match", f"select doc_id, round({_FRACTION}, 9) as matched from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as have, ['p', '101', 'heard', 'thing', 'rent', 'erin'] as asked from documents)")
def se05(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.round(tx.match_fraction(tx.strings(TERMS), F.col("text")), 9).alias("matched"))


@query("se06_metadata_boost", sql("docs", rest=f"select doc_id, round({_FRACTION}, 9) as boost from (select doc_id, regexp_extract_all(lower(lang || ' ' || uploaded_by || ' ' || status), '[a-z0-9]+') as have, ['en', 'src3', 'review'] as asked from docs)"))
def se06(spark, sf):
    return corpus.documents(spark, sf).select("doc_id", F.round(tx.match_fraction(tx.strings(["en", "src3", "review"]), F.concat_ws(" ", "lang", "uploaded_by", "status")), 9).alias("boost"))


@query("se07_freshness", "select o_orderkey, round(case when o_orderdate > timestamp '1997-01-01' then 1 else exp(-(epoch(timestamp '1997-01-01') - epoch(o_orderdate)) / 86400.0 / 365) end, 9) as fresh from orders")
def se07(spark, sf):
    orders = corpus.table(spark, sf, "orders")
    return orders.select("o_orderkey", F.round(vx.freshness(F.col("o_orderdate").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"), 365.0), 9).alias("fresh"))


_HITS = "hits as (select id, document, score from semantic order by score desc, id limit 60)"


@query("se08_rerank", sql("points", rest=f", {_SEMANTIC}, {_HITS} select id, document, round(1 / (1 + exp(-(8 * score - 2))), 9) as score from hits order by score desc, id limit 15"))
def se08(spark, sf):
    hits = search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60)
    return search.reranked(hits, F.col("score") * 8 - 2, 15)


@query("wn01_dedup_by_document", sql("points", rest=f""", {_SEMANTIC}, {_HITS},
kept as (select *, row_number() over (partition by document order by score desc, id) as passage from hits), best as (select document from kept where passage = 1 order by score desc, id limit 5)
select id, document, score, cast(passage as int) as passage from kept where passage <= 2 and document in (select document from best)"""))  # fmt: skip
def wn01(spark, sf):
    return search.by_document(search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60), 2, 5)


@query("wn02_arm_ranks", sql("points", rest=f", {_SEMANTIC}, {_HITS} select id, score, cast(row_number() over (order by score desc, id) as int) as rank from hits"))
def wn02(spark, sf):
    return search.ranked(search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60)).select("id", "score", "rank")


@query("se09_vector_pipeline", sql("points", rest=f""", {_FUSED}, wide as (select id, score from fused order by score desc, id limit 40),
again as (select w.id, p.document, round(1 / (1 + exp(-(100 * w.score - 2))), 9) as score from wide w join points p on w.id = p.id),
kept as (select *, row_number() over (partition by document order by score desc, id) as passage from again), best as (select document from kept where passage = 1 order by score desc, id limit 5)
select id, document, score, cast(passage as int) as passage from kept where passage <= 2 and document in (select document from best)"""))  # fmt: skip
def se09(spark, sf):
    """Hybrid candidates, reranked, at most two passages of five documents."""
    points, texts = corpus.points(spark, sf), _texts(spark, sf)
    arms = [search.semantic(points, _vector(spark, sf), 40), search.keyword(texts, tx.strings(TERMS), 40)]
    hits = search.fused(arms, 40).join(points.select("id", "document"), "id").select("id", "document", "score")
    return search.by_document(search.reranked(hits, F.col("score") * 100 - 2, 60), 2, 5)


@query("se10_threshold_retrieval", sql("points", rest=f", {_SEMANTIC}, {_HITS} select id, document, score from hits where score >= 0.2"))
def se10(spark, sf):
    return search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60).where("score >= 0.2")


_BUDGET_WORDS = "resume|cv|education|experience|projects?|qualifications|background|summari[sz]e|overview"


@query("se11_passage_budget", f"""select conv_id, turn, cast(case when regexp_matches(asked, '(?i)\\b({_BUDGET_WORDS})\\b') then 4 else 2 end as int) as budget from (
  select conv_id, turn, case when turn % 3 = 0 then 'Overview: ' when turn % 3 = 1 then 'profile and summary of ' else 'his PROJECTS, ' end || text as asked from conversations)""")
def se11(spark, sf):
    lead = F.when(F.col("turn") % 3 == 0, "Overview: ").when(F.col("turn") % 3 == 1, "profile and summary of ").otherwise("his PROJECTS, ")
    return corpus.messages(spark, sf).select("conv_id", "turn", search.passage_budget(F.concat(lead, "text")).alias("budget"))


_CONTEXT_HITS = "hits as (select id, 'doc-' || document as document, score from semantic order by score desc, id limit 20)"


#: Hits without those that repeat a better one: a walk by falling score that carries what is kept.
_KEPT_HITS = """placed as (select h.*, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x1c-\\x1f\\x{85}\\pZ]+'), lambda w: w <> '')) as words, row_number() over (order by score desc, id) as r
  from hits h left join documents d on d.doc_id = h.id),
walk as (select 0::bigint as r, []::struct(id bigint, document varchar, words varchar[])[] as kept union all
  select p.r, case when len(p.words) > 0 and len(list_filter(w.kept, lambda k: k.document = p.document and len(list_intersect(k.words, p.words))::double / len(list_distinct(list_concat(k.words, p.words))) >= 0.6)) > 0
    then w.kept else list_append(w.kept, {'id': p.id, 'document': p.document, 'words': p.words}) end from walk w join placed p on p.r = w.r + 1),
kept_hits as (select * from hits where id in (select unnest(list_transform(kept, lambda k: k.id)) from (select kept from walk order by r desc limit 1)))"""


def context_hits(spark, sf):
    hits = search.semantic(corpus.points(spark, sf), _vector(spark, sf), 20)
    return hits.select("id", F.concat(F.lit("doc-"), F.col("document").cast("string")).alias("document"), "score")


@query("jn14_facts_of_documents", sql("points", "facts", rest=f""", {_SEMANTIC}, {_CONTEXT_HITS}, counted as (select lower(document) as document, count(*) as n from facts group by 1)
select h.id, h.document, round(least(h.score + least(coalesce(n, 0) * 0.02, 0.1), 1), 9) as score, coalesce(n, 0) as n_facts from hits h left join counted c on lower(h.document) = c.document"""))  # fmt: skip
def jn14(spark, sf):
    return search.with_facts(context_hits(spark, sf), corpus.facts(spark, sf))


@query("jn15_uncovered_facts", sql("points", "facts", rest=f""", {_SEMANTIC}, {_CONTEXT_HITS}
select document, round(least(greatest(0.3, coalesce(max(confidence), 0.5) * 0.7), 1), 9) as score, count(*) as n_facts from facts where lower(document) not in (select document from hits) group by document"""))  # fmt: skip
def jn15(spark, sf):
    return search.graph_only(corpus.facts(spark, sf), context_hits(spark, sf))


@query("se13_context_merge", sql("points", "facts", rest=f""", {_SEMANTIC}, {_CONTEXT_HITS}, {_KEPT_HITS}, counted as (select lower(document) as document, count(*) as n from facts group by 1),
items as (select cast(h.id as varchar) as id, h.document, round(least(h.score + least(coalesce(n, 0) * 0.02, 0.1), 1), 9) as score, coalesce(n, 0) as n_facts, 'vector' as origin from kept_hits h left join counted c on lower(h.document) = c.document
  union all select 'graph:' || document, document, round(least(greatest(0.3, coalesce(max(confidence), 0.5) * 0.7), 1), 9), count(*), 'graph' from facts where lower(document) not in (select document from hits) group by document)
select * from items order by score desc, id limit 15"""))  # fmt: skip
def se13(spark, sf):
    return search.context(placed_hits(spark, sf), corpus.facts(spark, sf), 15)


def placed_hits(spark, sf):
    """Hits with page and content: a hit's passage is the whole text of its id, which begins on page 1."""
    hits = context_hits(spark, sf)
    texts = _texts(spark, sf).join(F.broadcast(hits.select("id")), "id").groupBy("id").agg(F.min("content").alias("content"))  # of a top-k
    return hits.join(texts, "id", "left").withColumn("page", F.lit(1))


@query("se15_search_with_entities", sql("points", "nodes", rest=f""", {_SEMANTIC}, {_HITS}, texts as (select h.id, h.score, d.text from hits h join documents d on h.id = d.doc_id),
names as (select distinct name from nodes where type in ('Nation', 'Region'))
select t.id, t.score, cast(coalesce(list_sum(list_transform((select list(name) from names), lambda n: case when contains(lower(t.text), lower(n)) then 1 else 0 end)), 0) as int) as n_entities from texts t"""))  # fmt: skip
def se15(spark, sf):
    """Hits with the number of entity names in their text."""
    hits = search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60).join(_texts(spark, sf), "id")
    names = corpus.nodes(spark, sf).where("type in ('Nation', 'Region')").select(F.col("name").alias("id"), "name")
    found = dictionary.named_in(names, hits.select(F.col("id").alias("passage"), "content")).groupBy(F.col("passage").alias("id")).agg(F.count("*").cast("int").alias("n"))
    return hits.join(found, "id", "left").select("id", "score", F.coalesce("n", F.lit(0)).alias("n_entities"))


@query("jn16_names_in_passages", sql("reports", rest=""", names as (select distinct regexp_extract(content, 'P-[0-9]+') as name from reports union select distinct p_brand from part)
  select name as id, doc_id as passage from names n join reports r on contains(lower(r.content), lower(n.name))"""))
def jn16(spark, sf):
    """Which reports hold which tags of pumps and which brands, inside other tags too."""
    r = corpus.reports(spark, sf)
    names = r.select(F.regexp_extract("content", "P-[0-9]+", 0).alias("id")).union(table(spark, sf, "part").select("p_brand")).distinct()
    return dictionary.named_in(names.withColumn("name", F.col("id")), r.select(F.col("doc_id").alias("passage"), "content"))


@query("jn22_near_duplicate_passages", sql("chunks", rest=""", words as (select distinct id, document, page, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) as word from chunks), sizes as (select id, count(*) as n from words group by id),
shared as (select a.id as a, b.id as b, count(*) as n from words a join words b on a.document = b.document and a.page = b.page and a.word = b.word and a.id < b.id group by 1, 2)
select a, b, round(cast(s.n as double) / (x.n + y.n - s.n), 6) as jaccard from shared s join sizes x on a = x.id join sizes y on b = y.id where round(cast(s.n as double) / (x.n + y.n - s.n), 6) >= 0.6"""))  # fmt: skip
def jn22(spark, sf):
    return search.near_passages(corpus.chunks(spark, sf))


@query("se17_distinct_graph_facts", sql("facts", rest="select entity, relationship, target, max(confidence) as confidence, count(*) as n from facts group by all"))
def se17(spark, sf):
    return corpus.facts(spark, sf).groupBy("entity", "relationship", "target").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
