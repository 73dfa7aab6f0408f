"""Queries of graph retrieval, hybrid retrieval, excerpts and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.config import CONTEXT
from docweave.functions import text as tx
from docweave.operators import graph, retrieval, search
from docweave.operators.nearest import nearest
from docweave.plans.registry import query
from docweave.plans.search_queries import _CONTEXT_HITS, _KEPT_HITS, _SEMANTIC, context_hits, placed_hits
from docweave.sources import corpus
from docweave.sources.corpus import sql, table

GRAPH_ASKED = "supplier customer nation"
_ASKED_TERMS = "['supplier', 'customer', 'nation']"
_FOUND = f"""found as (select *, lower(name) = '{GRAPH_ASKED}' as exact, len(list_filter({_ASKED_TERMS}, lambda t: contains(lower(name), t))) / 3.0 as coverage from pnodes),
candidates as (select * from found where exact or coverage > 0 order by exact desc, coverage desc, name, id limit 30),
marked as (select *, len(list_filter({_ASKED_TERMS}, lambda t: contains(lower(name), t))) as hits, len(list_filter(regexp_split_to_array(lower(name), '[\\s_\\-.]+'), lambda w: w <> '')) as parts from candidates),
chosen as (select *, row_number() over (order by exact desc, lower(type) in ('nation'), hits / parts::double desc, hits desc, name, id) as place from marked qualify place <= 5)"""


@query("sr07_entity_ranking", sql("nodes", "pnodes", rest=f", {_FOUND} select id, name, cast(place as int) as place from chosen"))
def sr07(spark, sf):
    nodes = corpus.placed_nodes(spark, sf)
    found = graph.entity_search(nodes, F.lit(GRAPH_ASKED), tx.query_terms(F.lit(GRAPH_ASKED))).orderBy(F.desc("exact"), F.desc("coverage"), "name", "id").limit(30)
    return retrieval.ranked_entities(found, F.lit(GRAPH_ASKED), 5, ("nation",)).select("id", "name", "place")


@query("sr08_entity_search_page", sql("nodes", "pnodes", rest=f", {_FOUND} select id, name, count(*) over () as total from found where exact or coverage > 0 order by exact desc, coverage desc, name, id limit 10 offset 5"))
def sr08(spark, sf):
    found = graph.entity_search(corpus.placed_nodes(spark, sf), F.lit(GRAPH_ASKED), tx.query_terms(F.lit(GRAPH_ASKED)))
    return found.orderBy(F.desc("exact"), F.desc("coverage"), "name", "id").limit(15).offset(5).select("id", "name", "total")


_FACTS = f"""{_FOUND}, firsts as (select arg_min(chosen, place) as e from chosen group by name),
ways as (select src as id, dst as other, type as relationship, document as edge_document, source as edge_source from pedges where src <> dst union all select dst, src, type, document, source from pedges where src <> dst),
near as (select f.e, w.*, n.name as related, n.confidence, n.document as other_document, n.source as other_source from firsts f join ways w on w.id = f.e.id join pnodes n on n.id = w.other),
good as (select e.name as entity, e.type as type, relationship, related, confidence, coalesce(edge_source, other_source, e.source) as source from near
  where len(list_distinct(list_filter([e.document, edge_document, other_document], lambda d: d is not null))) <= 1),
gfacts as (select entity, type, relationship, related, confidence, source from good qualify row_number() over (partition by entity, type, relationship, related order by confidence desc, coalesce(source, '~')) = 1
  union all select e.name, e.type, null, null, e.confidence, e.source from firsts where e.id not in (select id from near))"""


def found_facts(spark, sf):
    asked = F.lit(GRAPH_ASKED)
    return retrieval.graph_facts(corpus.placed_nodes(spark, sf), corpus.placed_edges(spark, sf), asked, tx.query_terms(asked), 5, ("nation",))


@query("se12_graph_retrieval", sql("nodes", "edges", "pnodes", "pedges", rest=f", {_FACTS} select * from gfacts"))
def se12(spark, sf):
    return found_facts(spark, sf)


_SCOPED = "scoped as (select regexp_replace(source, '[.]txt$', '') as document, confidence from gfacts where regexp_replace(source, '[.]txt$', '') in (select document from hits))"
_MERGED = """counted as (select lower(document) as document, count(*) as n from scoped group by 1),
items as (select cast(h.id as varchar) as id, h.document, round(least(h.score + least(coalesce(n, 0) * 0.02, 0.1), 1), 9) as score, coalesce(n, 0) as n_facts, 'vector' as origin from kept_hits h left join counted c on lower(h.document) = c.document
  union all select 'graph:' || document, document, round(least(greatest(0.3, coalesce(max(confidence), 0.5) * 0.7), 1), 9), count(*), 'graph' from scoped where lower(document) not in (select document from hits) group by document)"""


def scoped_facts(spark, sf):
    """Facts of the retrieved documents, as a filtered question asks for."""
    facts = found_facts(spark, sf).select(F.regexp_replace("source", "[.]txt$", "").alias("document"), "confidence")
    return facts.join(F.broadcast(context_hits(spark, sf).select("document").distinct()), "document", "left_semi")  # a top-k


@query("se14_hybrid_retrieval", sql("nodes", "edges", "pnodes", "pedges", "points", rest=f", {_SEMANTIC}, {_CONTEXT_HITS}, {_KEPT_HITS}, {_FACTS}, {_SCOPED}, {_MERGED} select * from items order by score desc, id limit 10"))
def se14(spark, sf):
    """Both arms, the graph's facts scoped to the retrieved documents, and their merge."""
    return search.context(placed_hits(spark, sf), scoped_facts(spark, sf), 10)


@query("flt13_answer_evidence", sql("nodes", "edges", "pnodes", "pedges", "points", rest=f", {_SEMANTIC}, {_CONTEXT_HITS}, {_KEPT_HITS}, {_FACTS}, {_SCOPED}, {_MERGED} select id, document, score from items where origin <> 'graph' order by score desc, id limit 10"))
def flt13(spark, sf):
    """What of the merged context may serve as evidence: passages, not the graph's own items."""
    return search.top(search.context(placed_hits(spark, sf), scoped_facts(spark, sf), 1000).where("origin <> 'graph'"), 10).select("id", "document", "score")


@query("sr10_context_counts", sql("nodes", "edges", "pnodes", "pedges", "points", rest=f", {_SEMANTIC}, {_CONTEXT_HITS}, {_KEPT_HITS}, {_FACTS}, {_SCOPED}, {_MERGED} select origin, count(*) as n from (select * from items order by score desc, id limit 10) group by origin"))
def sr10(spark, sf):
    return se14(spark, sf).groupBy("origin").agg(F.count("*").alias("n"))


@query("ag17_combined_confidence", sql("nodes", "edges", "pnodes", "pedges", "points", rest=f", {_SEMANTIC}, {_CONTEXT_HITS}, {_FACTS} select round(least(greatest(coalesce((select max(score) from hits), 0), 0.9 * coalesce((select max(confidence) from gfacts), 0)), 1), 9) as confidence"))
def ag17(spark, sf):
    return retrieval.combined_confidence(context_hits(spark, sf), found_facts(spark, sf))


EXCERPT_ASKED = "<the> heard erin & thing was"
_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("se16_highlight", f"""with terms as (select ['<the>', 'heard', 'erin', 'thing', 'was'] as t), said as (
  select doc_id, coalesce(text, '') as text, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts from documents),
found as (select doc_id, list_filter(parts, lambda s: len(list_filter(t, lambda w: contains(lower(s), w))) > 0) as f, text from said, terms),
whole as (select doc_id, case when len(f) > 0 then array_to_string(f, ' ') else text end as w from found),
cuts as (select doc_id, w, 300 - least(case when instr(reverse(left(w, 300)), ' ') > 0 then instr(reverse(left(w, 300)), ' ') else 301 end, case when instr(reverse(left(w, 300)), '.') > 0 then instr(reverse(left(w, 300)), '.') else 301 end) as brk from whole)
select doc_id, replace(replace({_ESCAPE.format("regexp_replace(case when length(w) <= 300 then w when brk > 150 then left(w, brk) else left(w, 300) end, '(?i)(<the>|heard|thing|erin|was)', chr(57344) || '\\1' || chr(57345), 'g')")}, chr(57344), '<mark>'), chr(57345), '</mark>') as excerpt from cuts""")
def se16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.highlight(F.col("text"), F.lit(EXCERPT_ASKED)).alias("excerpt"))


#: Every item of the benchmark asks, with its words and with the vector of twenty times its number, if there is one.
_BATCH = f"""questions as (select item_id as question, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2 and not list_contains({str(list(tx.QUERY_STOPWORDS))}, w))) as words from benchmark),
asked as (select question, unnest(words) as word, len(words) as n from questions), said as (select distinct doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as word from documents),
word_hits as (select question, id, round(count(*) / max(n)::double, 9) as score from said join asked using (word) group by all), b as (select * , row_number() over (partition by question order by score desc, id) as rank from word_hits qualify rank <= 20),
near as (select q.vec_id // 20 as question, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as score from embeddings q join embeddings e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0 and q.vec_id // 20 in (select item_id from benchmark)),
a as (select *, row_number() over (partition by question order by score desc, id) as rank from near qualify rank <= 20), hits as (select *, 0 as arm from a union all select *, 1 from b), arms as (select question, count(distinct arm) as n from hits group by question)"""


def questions(spark, sf):
    words = F.filter(tx.words_of(F.col("text")), lambda w: (F.length(w) >= 2) & ~F.array_contains(tx.strings(tx.QUERY_STOPWORDS), w))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), words.alias("words"))


def vector_batch(spark, sf, k):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = nearest(e, F.col("id") % 20 == 0, k).withColumn("question", F.floor(F.col("query") / 20)).join(questions(spark, sf).select("question"), "question", "left_semi")
    return near.select("question", "id", F.round("score", search.DIGITS).alias("score"), "rank")


@query("se02_keyword_batch", f"with {_BATCH} select question, id, score, cast(rank as int) as rank from b")
def se02_batch(spark, sf):
    return search.keyword_batch(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), questions(spark, sf), 20)


@query("se03_hybrid_batch", f"with {_BATCH}, fused as (select question, id, round(case when max(n) > 1 then sum(1.0 / (60 + rank)) else max(score) end, 9) as score from hits join arms using (question) group by question, id) select question, id, score, cast(row_number() over (partition by question order by score desc, id) as int) as rank from fused qualify row_number() over (partition by question order by score desc, id) <= 10")
def se03_batch(spark, sf):
    """Hybrid search for all questions of the benchmark at once."""
    return search.fused_batch([vector_batch(spark, sf, 20), se02_batch(spark, sf)], 10)


@query("wn12_prompt_budget", sql("points", rest=f""", {_SEMANTIC}, wide as (select id, 'doc-' || document as source, score from semantic order by score desc, id limit 60),
blocks as (select w.id, score, w.source, coalesce(d.text, '') as content, row_number() over (order by score desc, w.id) as n from wide w join documents d on d.doc_id = w.id),
lined as (select *, '[' || n || '] Source: ' || source as line from blocks), whole as (select *, line || chr(10) || '    Content: ' || content as block from lined),
summed as (select *, sum(length(block) + 2) over (order by n) as used from whole), firsts as (select min(n) as first from summed where used > {CONTEXT.prompt_chars} - 900),
kept as (select s.*, f.first, {CONTEXT.prompt_chars} - 900 - (used - length(block) - 2) as room from summed s, firsts f)
select cast(n as int) as n, id, case when n = first then line || chr(10) || '    Content: ' || left(content, greatest(room - length(line) - 30, 0)::bigint) || '...[truncated]' else block end as block
from kept where first is null or n < first or (n = first and (room > 60 or (n = 1 and room > 0)))"""))
def wn12(spark, sf):
    hits = search.semantic(corpus.points(spark, sf), _vector(spark, sf), 60)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    named = hits.join(texts, "id").select("id", F.concat(F.lit("doc-"), F.col("document").cast("string")).alias("source"), "content", "score")
    return retrieval.prompt_blocks(named, F.lit(900))


def _vector(spark, sf):
    from docweave.functions import vectors as vx

    return vx.literal_vector(corpus.query_vector(spark, sf))


@query("wn11_memory_lines", sql("memories", rest=""", lined as (select doc_id, user_name, importance,
  '- [' || case when doc_id % 2 = 0 then 'Long Term' else 'Temporary Memory' end || '] ' || title || ': ' || left(case when doc_id % 3 = 0 then 'In short' else content end, 200) as line from memories),
summed as (select *, row_number() over (partition by user_name order by importance desc, doc_id) as n, 38 + sum(length(line) + 1) over (partition by user_name order by importance desc, doc_id) as used from lined),
cut as (select *, 4000 - (used - length(line) - 1) as room, min(case when used > 4000 then n end) over (partition by user_name) as first from summed)
select user_name as user, cast(n as int) as n, case when n = first then left(line, room::bigint) else line end as line from cut where first is null or n < first or (n = first and room > 40)"""))
def wn11(spark, sf):
    kind = F.when(F.col("doc_id") % 2 == 0, "long_term").otherwise("temporary_memory")
    m = corpus.memories(spark, sf).select("user", F.col("doc_id").alias("id"), kind.alias("type"), "title", "content", F.when(F.col("doc_id") % 3 == 0, "In short").alias("summary"), F.col("importance").alias("score"))
    return retrieval.memory_lines(m, "user")
