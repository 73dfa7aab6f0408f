"""Queries of all questions of the benchmark at once: four modes of search, entities in the hits, retrieval with a fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.config import SEARCH
from docweave.functions import text as tx
from docweave.functions import vectors as vx
from docweave.operators import modes
from docweave.plans.registry import query
from docweave.plans.retrieval_queries import _BATCH, questions, se02_batch, se03_batch, vector_batch
from docweave.plans.search_queries import NOW
from docweave.sources import corpus
from docweave.sources.corpus import SQL, table

THRESHOLD = 0.2
_FRACTION = "len(list_filter(['en', 'src1'], lambda w: list_contains(have, w))) / 2.0"
_MODES = f"""{SQL["docs"]}, {_BATCH}, modes as (select item_id as question, ['semantic', 'keyword', 'hybrid', 'ranked'][item_id % 4 + 1] as mode from benchmark),
fields as (select doc_id as id, {_FRACTION} as metadata, case when created_at is null then 0 when created_at > timestamp '{NOW}' then 1 else exp(-(epoch(timestamp '{NOW}') - epoch(created_at)) / 86400.0 / 365) end as freshness
  from (select *, regexp_extract_all(lower(lang || ' ' || uploaded_by || ' ' || status), '[a-z0-9]+') as have from docs)),
fused as (select question, id, round(case when max(n) > 1 then sum(1.0 / (60 + rank)) else max(score) end, 9) as score from hits join arms using (question) group by question, id),
parts as (select coalesce(a.question, b.question) as question, coalesce(a.id, b.id) as id, a.score as semantic, b.score as keyword from a full join b on a.question = b.question and a.id = b.id),
scored as (select question, 'semantic' as mode, id, score from a union all select question, 'keyword', id, score from b union all select question, 'hybrid', id, score from fused
  union all select question, 'ranked', p.id, round(coalesce(semantic, 0) * 0.35 + coalesce(keyword, 0) * 0.30 + coalesce(metadata, 0) * 0.20 + coalesce(freshness, 0) * 0.15, 9) from parts p left join fields f on f.id = p.id),
found as (select s.question, s.mode, id, score, cast(row_number() over (partition by s.question order by score desc, id) as int) as rank from scored s join modes m on m.question = s.question and m.mode = s.mode
  qualify row_number() over (partition by s.question order by score desc, id) <= 10)"""


def _found(spark, sf):
    mode = F.element_at(F.array(*[F.lit(m) for m in modes.MODES]), (F.col("item_id") % 4 + 1).cast("int"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), mode.alias("mode"))
    metadata = tx.match_fraction(tx.strings(["en", "src1"]), F.concat_ws(" ", "lang", "uploaded_by", "status"))
    fields = corpus.documents(spark, sf).select(F.col("doc_id").alias("id"), metadata.alias("metadata"), vx.freshness(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz"), SEARCH.freshness_days).alias("freshness"))
    return modes.by_mode(asked, vector_batch(spark, sf, 20), se02_batch(spark, sf), fields, 10)


@query("se15_four_modes", f"with {_MODES} select question, mode, id, score, rank from found")
def se15_modes(spark, sf):
    return _found(spark, sf)


_NAMES = "names as (select distinct lower(regexp_extract(text, '^([A-Za-z]{4,})', 1)) as name from documents where regexp_matches(text, '^[A-Za-z]{4,}'))"
_ENTITIES = f"""{_NAMES}, named as (select question, name, count(*) as n from (select question, unnest(words) as word from questions) w join names on contains(name, word) group by all),
entities as (select question, name, row_number() over (partition by question order by n desc, name) as place from named qualify place <= 5)"""


def _nodes(spark, sf):
    """First words of documents as entities."""
    name = F.lower(F.regexp_extract("text", "^([A-Za-z]{4,})", 1))
    return table(spark, sf, "documents").select(name.alias("name"), F.lit("Word").alias("type")).where("name <> ''").distinct()


def _asked(spark, sf):
    return questions(spark, sf).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), "text"), "question")


@query("se15_entities_of_hits", f"""with {_MODES}, {_ENTITIES}, pairs as (select f.question, f.id, e.name from found f join entities e on e.question = f.question join documents d on d.doc_id = f.id where contains(lower(d.text), e.name)),
  listed as (select question, id, list(name order by name) as entities from pairs group by all) select f.question, f.mode, f.id, f.rank, coalesce(l.entities, []) as entities from found f left join listed l on l.question = f.question and l.id = f.id""")
def se15_entities(spark, sf):
    """Hits with those of the question's entities that stand in their texts."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return modes.with_entities(_found(spark, sf), modes.asked_entities(_asked(spark, sf), _nodes(spark, sf)), texts).select("question", "mode", "id", "rank", "entities")


@query("se18_graph_with_fallback", f"""with {_BATCH}, {_NAMES}, facts as (select question, count(*) as n_facts from (select question, unnest(words) as word from questions) w join names on name = word group by all),
  fused as (select question, id, round(case when max(n) > 1 then sum(1.0 / (60 + rank)) else max(score) end, 9) as score from hits join arms using (question) group by question, id),
  top as (select *, cast(row_number() over (partition by question order by score desc, id) as int) as rank from fused qualify row_number() over (partition by question order by score desc, id) <= 10),
  wanted as (select q.question, coalesce(n_facts, 0) as n_facts, case when n_facts > 0 then 'hybrid' else 'semantic_fallback' end as source from questions q left join facts f on f.question = q.question),
  rows_ as (select question, 'hybrid' as source, id, score, rank from top union all select question, 'semantic_fallback', id, score, rank from a where rank <= 10 and score >= {THRESHOLD})
  select w.question, case when r.id is null then 'insufficient' else w.source end as source, r.id, r.score, cast(r.rank as int) as rank, n_facts from wanted w left join rows_ r on r.question = w.question and r.source = w.source""")
def se18(spark, sf):
    """Hybrid hits where the graph knows a word of the question; else its semantic hits; a row that says so without either."""
    asked = _asked(spark, sf)
    words = asked.select("question", F.explode(F.array_distinct("words")).alias("name"))
    facts = words.join(_nodes(spark, sf), "name").groupBy("question").agg(F.count("*").alias("n_facts"))
    return modes.with_fallback(asked, se03_batch(spark, sf), vector_batch(spark, sf, 20), facts, 10, THRESHOLD)
