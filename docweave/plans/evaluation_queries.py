"""Queries of evaluation: recall, ranks, refusals, facts, citations, slices, comparisons, and checks of the golden set."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import evaluation as ev
from docweave.operators.nearest import nearest
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql, table

# every twentieth vector asks; labels stand for documents, and the relevant ones are its own and the next
_RANKED = """ranked as (select q.vec_id, q.label as own, e.label as document, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) desc, e.vec_id) as rank
  from embeddings q join embeddings e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0 qualify rank <= 10),
expected as (select vec_id, label as document from embeddings where vec_id % 20 = 0 union select vec_id, (label + 1) % 10 from embeddings where vec_id % 20 = 0 and vec_id % 3 <> 0)"""
_PLACES = "places as (select vec_id, document, row_number() over (partition by vec_id order by min(rank)) as place from ranked group by vec_id, document)"
_SCORES = f"""{_RANKED}, {_PLACES}, scores as (select e.vec_id, count(*) filter (p.place <= 3)::double / count(*) as recall, coalesce(1.0 / min(p.place), 0)::double as reciprocal
  from expected e left join places p on p.vec_id = e.vec_id and p.document = e.document group by e.vec_id)"""


def ranked(spark, sf):
    e = table(spark, sf, "embeddings")
    near = nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), F.col("id") % 20 == 0, 10)
    return near.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("document")), "id").select(F.col("query").alias("vec_id"), "document", "rank")


def expected(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    return e.select("vec_id", F.col("label").alias("document")).union(e.where("vec_id % 3 <> 0").select("vec_id", (F.col("label") + 1) % 10))


@query("wn03_distinct_places", f"with {_RANKED}, {_PLACES} select vec_id, document, cast(place as int) as place from places")
def wn03(spark, sf):
    return ev.distinct_in_order(ranked(spark, sf), "vec_id")


@query("el01_recall_at_k", f"with {_SCORES} select vec_id, recall from scores")
def el01(spark, sf):
    return ev.retrieval_scores(ranked(spark, sf), expected(spark, sf), "vec_id", 3).select("vec_id", "recall")


@query("el02_reciprocal_rank", f"with {_SCORES} select vec_id, reciprocal from scores")
def el02(spark, sf):
    return ev.retrieval_scores(ranked(spark, sf), expected(spark, sf), "vec_id", 3).select("vec_id", "reciprocal")


@query("ag22_metric_slices", f"""with {_SCORES}, tagged as (select s.*, e.label, ['even', 'third'] as tags from scores s join embeddings e using (vec_id)),
keyed as (select 'all' as kind, null as slice, recall, reciprocal from tagged union all select 'type', cast(label as varchar), recall, reciprocal from tagged
  union all select 'tag', t, recall, reciprocal from (select unnest(case when vec_id % 3 = 0 then tags else ['even'] end) as t, recall, reciprocal from tagged))
select kind, slice, count(*) as n, avg(recall) as recall, avg(reciprocal) as reciprocal from keyed group by kind, slice""")
def ag22(spark, sf):
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    tags = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("even"), F.lit("third"))).otherwise(F.array(F.lit("even")))
    rows = ev.retrieval_scores(ranked(spark, sf), expected(spark, sf), "vec_id", 3).join(labels, "vec_id").withColumn("tags", tags)
    return ev.slices(rows, ["recall", "reciprocal"], "label", "tags")


@query("el13_ablation_deltas", f"""with {_RANKED}, {_PLACES}, runs as (select config, k, avg(hit)::double as recall from (
  select c.config, c.k, e.vec_id, count(*) filter (p.place <= c.k)::double / count(*) as hit from expected e cross join (values ('narrow', 1), ('usual', 3), ('wide', 8)) c(config, k) left join places p on p.vec_id = e.vec_id and p.document = e.document group by all) group by all)
select config, recall, round(recall - (select recall from runs where config = 'usual'), 9) as delta from runs""")
def el13(spark, sf):
    """Mean recall of three configurations, and how they differ from the usual one."""
    r, e, runs = ranked(spark, sf), expected(spark, sf), None
    for config, k in (("narrow", 1), ("usual", 3), ("wide", 8)):
        one = ev.retrieval_scores(r, e, "vec_id", k).agg(F.avg("recall").alias("recall")).select(F.lit(config).alias("config"), F.lit("all").alias("slice"), "recall")
        runs = one if runs is None else runs.union(one)
    return ev.deltas(runs, ["slice"], "recall", "usual").drop("slice")


_ANSWER = """case doc_id % 5 when 0 then content when 1 then 'The documents do not mention **' || title || '**.' when 2 then 'I could not find information; SOP-' || lpad(cast(doc_id % 40 as varchar), 3, '0') || ' applies.'
  when 3 then 'See ' || filename || ': 44 per cent at 12 deg C, T-' || doc_id else 'No data on flow are available. ' || replace(title, ' ', '_') end"""
_ANSWERS = f"answers as (select doc_id, filename, content, {_ANSWER} as answer from reports)"


def answers(spark, sf):
    """Answers about each report: quotes, refusals, and statements with codes and numbers."""
    n = F.col("doc_id") % 5
    answer = (
        F.when(n == 0, F.col("content")).when(n == 1, F.concat(F.lit("The documents do not mention **"), "title", F.lit("**.")))
        .when(n == 2, F.concat(F.lit("I could not find information; SOP-"), F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0"), F.lit(" applies.")))
        .when(n == 3, F.concat(F.lit("See "), "filename", F.lit(": 44 per cent at 12 deg C, T-"), F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.lit("No data on flow are available. "), F.replace("title", F.lit(" "), F.lit("_"))))
    )
    return corpus.reports(spark, sf).select("doc_id", "filename", "content", answer.alias("answer"))


def _normal_sql(x: str) -> str:
    x = f"lower(translate({x}, '{ev.FOLDED_FROM}', '{ev.FOLDED_TO}'))"
    for pattern, new in ev.SPELLINGS:
        x = f"regexp_replace({x}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"trim({x})"


_REFUSED = "regexp_matches(" + _normal_sql("answer") + ", '" + "|".join(f"(?:{p})" for p in ev.REFUSALS).replace("'", "''") + "')"


@query("el09_normal_text", sql("reports", rest=f", {_ANSWERS} select doc_id, {_normal_sql('answer')} as text from answers"))
def el09(spark, sf):
    return answers(spark, sf).select("doc_id", ev.normal(F.col("answer")).alias("text"))


_FACTS = "[[('P-' || (doc_id % 900 + 100)), 'the pump'], ['44%'], ['12°C', '12 degrees celsius'], ['T-1', 'T-2']]"
_COVERED = f"""said as (select *, {_normal_sql('answer')} as text, {_REFUSED} as refused from answers), phrased as (select *, {_normal_sql("'P-' || (doc_id % 900 + 100)")} as pump from said),
covered as (select *, ((case when regexp_matches(text, pump || '($|[^0-9.,]|[.,]($|[^0-9]))') or contains(text, 'the pump') then 1 else 0 end) + (case when regexp_matches(text, '(^|[^0-9.])44%') then 1 else 0 end)
  + (case when regexp_matches(text, '(^|[^0-9.])12°c') then 1 else 0 end) + (case when regexp_matches(text, 't-[12]($|[^0-9.,]|[.,]($|[^0-9]))') then 1 else 0 end)) / 4.0 as coverage from phrased)"""


def covered(spark, sf):
    facts = F.array(F.array(F.concat(F.lit("P-"), (F.col("doc_id") % 900 + 100).cast("string")), F.lit("the pump")), F.array(F.lit("44%")), F.array(F.lit("12°C"), F.lit("12 degrees celsius")), F.array(F.lit("T-1"), F.lit("T-2")))
    a = answers(spark, sf)
    return a.withColumns({"coverage": ev.fact_coverage(F.col("answer"), facts), "refused": ev.refuses(F.col("answer"))})


@query("el06_fact_coverage", sql("reports", rest=f", {_ANSWERS}, {_COVERED} select doc_id, coverage from covered"))
def el06(spark, sf):
    return covered(spark, sf).select("doc_id", "coverage")


_OUTCOME = "case when doc_id % 10 in (1, 6, 4) then case when refused then 'correct_refusal' else 'missed_refusal' end when refused and coverage = 0 then 'false_refusal' else 'answered' end"


@query("el05_refusal_outcomes", sql("reports", rest=f", {_ANSWERS}, {_COVERED} select doc_id, refused, {_OUTCOME} as outcome from covered"))
def el05(spark, sf):
    c = covered(spark, sf)
    return c.select("doc_id", "refused", ev.outcome(F.col("refused"), (F.col("doc_id") % 10).isin(1, 6, 4), F.col("coverage")).alias("outcome"))


@query("ag23_answer_metrics", sql("reports", rest=f", {_ANSWERS}, {_COVERED}, o as (select *, {_OUTCOME} as outcome from covered) select count(*) as n, avg(coverage) as coverage, count(*) filter (outcome = 'correct_refusal') / nullif(count(*) filter (outcome in ('correct_refusal', 'missed_refusal')), 0)::double as refused_rightly, count(*) filter (outcome = 'false_refusal') / nullif(count(*) filter (outcome in ('false_refusal', 'answered')), 0)::double as refused_wrongly from o"))
def ag23(spark, sf):
    o = covered(spark, sf).select("coverage", ev.outcome(F.col("refused"), (F.col("doc_id") % 10).isin(1, 6, 4), F.col("coverage")).alias("outcome"))
    rate = lambda good, of: F.count_if(F.col("outcome") == good) / F.nullif(F.count_if(F.col("outcome").isin(*of)), F.lit(0))
    wrong = rate("false_refusal", ("false_refusal", "answered")).alias("refused_wrongly")
    return o.agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage"), rate("correct_refusal", ("correct_refusal", "missed_refusal")).alias("refused_rightly"), wrong)


@query("el15_rescored_answers", sql("reports", rest=f", {_ANSWERS}, {_COVERED} select doc_id, 0.25::double as old_coverage, coverage, coverage <> 0.25 as changed from covered"))
def el15(spark, sf):
    """Stored answers scored anew, beside the score they had."""
    return covered(spark, sf).select("doc_id", F.lit(0.25).alias("old_coverage"), "coverage", (F.col("coverage") != 0.25).alias("changed"))


_CODES = """codes as (select distinct filename, unnest(case when regexp_extract(stem, '^([A-Z]{2,4}-[0-9]{3})', 1) <> '' then [regexp_extract(stem, '^([A-Z]{2,4}-[0-9]{3})', 1)] else [stem, replace(stem, '_', ' ')] end) as name
  from (select filename, regexp_replace(filename, '[.][^.]*$', '') as stem from (select filename from reports union all select 'SOP-' || lpad(cast(doc_id as varchar), 3, '0') || '_Start.txt' from reports where doc_id < 40)))"""
_CITED = f"""{_ANSWERS}, {_CODES}, said as (select doc_id, {_normal_sql('answer')} as text from answers), names as (select filename, {_normal_sql('name')} as name from codes),
cited as (select distinct doc_id, n.filename from said join names n on regexp_matches(text, (case when regexp_matches(n.name, '^[0-9]') then '(^|[^0-9.])' else '' end) || regexp_escape(n.name) || (case when regexp_matches(n.name, '[0-9]$') then '($|[^0-9.,]|[.,]($|[^0-9]))' else '' end))),
wanted as (select doc_id, filename from answers where doc_id % 7 <> 0 union select doc_id, 'SOP-' || lpad(cast(doc_id % 40 as varchar), 3, '0') || '_Start.txt' from answers where doc_id % 7 <> 0)"""


@query("el07_citations", sql("reports", rest=f""", {_CITED}, counts as (select a.doc_id, (select count(*) from cited c where c.doc_id = a.doc_id) as n_cited, (select count(*) from wanted w where w.doc_id = a.doc_id) as n_wanted,
  (select count(*) from cited c join wanted w using (doc_id, filename) where doc_id = a.doc_id) as hits from answers a)
select doc_id, n_cited, case when n_wanted > 0 and n_cited > 0 then hits / n_cited::double end as precision, case when n_wanted > 0 then hits / n_wanted::double end as recall from counts"""))
def el07(spark, sf):
    a = answers(spark, sf)
    procedure = lambda n: F.concat(F.lit("SOP-"), F.lpad(n.cast("string"), 3, "0"), F.lit("_Start.txt"))
    files = a.select("filename").union(a.where("doc_id < 40").select(procedure(F.col("doc_id")))).distinct()
    known = a.where("doc_id % 7 <> 0")
    wanted = known.select("doc_id", "filename").union(known.select("doc_id", procedure(F.col("doc_id") % 40)))
    return ev.citations(a, files, wanted, "doc_id")


@query("st05_cited_and_expected", sql("reports", rest=f", {_CITED} select doc_id, filename from cited join wanted using (doc_id, filename)"))
def st05(spark, sf):
    a = answers(spark, sf)
    procedure = lambda n: F.concat(F.lit("SOP-"), F.lpad(n.cast("string"), 3, "0"), F.lit("_Start.txt"))
    files = a.select("filename").union(a.where("doc_id < 40").select(procedure(F.col("doc_id")))).distinct()
    known = a.where("doc_id % 7 <> 0")
    wanted = known.select("doc_id", "filename").union(known.select("doc_id", procedure(F.col("doc_id") % 40))).distinct()
    return ev.cited(a, files, "doc_id").join(wanted.hint("merge"), ["doc_id", "filename"])  # as many rows as answers: never broadcast


@query("el03_passage_recall", sql("reports", "dialogues", rest=""", evidence as (select doc_id, unnest([left(content, 30), 'Valve  V-' || doc_id, 'no such passage']) as snippet from reports),
seen as (select conv_id as doc_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) as text from dialogues where role = 'assistant')
select e.doc_id, avg(case when contains(text, lower(trim(regexp_replace(snippet, '\\s+', ' ', 'g')))) then 1.0 else 0 end)::double as recall from evidence e join seen using (doc_id) group by e.doc_id"""))
def el03(spark, sf):
    """Share of each question's snippets of evidence that are in the passages of their document."""
    snippets = F.array(F.substring("content", 1, 30), F.concat(F.lit("Valve  V-"), F.col("doc_id").cast("string")), F.lit("no such passage"))
    evidence = corpus.reports(spark, sf).select("doc_id", F.explode(snippets).alias("snippet"))
    seen = corpus.dialogues(spark, sf).where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), ev.plain(F.col("content")).alias("text"))
    hit = F.when(F.contains("text", ev.plain(F.col("snippet"))), 1.0).otherwise(0.0)
    return evidence.join(seen, "doc_id").groupBy("doc_id").agg(F.avg(hit).alias("recall"))


@query("el04_follow_up_resolved", sql("reports", rest="select doc_id, contains(lower('Tell me more ' || title), lower(regexp_extract(content, '(T-[0-9]+)', 1))) or contains(lower('Tell me more ' || title), lower(regexp_extract(content, '(P-[0-9]+)', 1))) as resolved from reports"))
def el04(spark, sf):
    targets = F.array(F.regexp_extract("content", "(T-[0-9]+)", 1), F.regexp_extract("content", "(P-[0-9]+)", 1))
    asked = F.lower(F.concat(F.lit("Tell me more "), "title"))
    return corpus.reports(spark, sf).select("doc_id", F.exists(targets, lambda t: F.contains(asked, F.lower(t))).alias("resolved"))


@query("ag31_golden_split", "select kind, n, wanted, n = wanted as as_planned from (select case when item_id % 3 = 0 then 'single' when item_id % 3 = 1 then 'multi' else 'negative' end as kind, count(*) as n from benchmark group by 1) join (values ('single', 14), ('multi', 13), ('negative', 12)) p(kind, wanted) using (kind)")
def ag31(spark, sf):
    kind = F.when(F.col("item_id") % 3 == 0, "single").when(F.col("item_id") % 3 == 1, "multi").otherwise("negative")
    plan = spark.createDataFrame([("single", 14), ("multi", 13), ("negative", 12)], "kind string, wanted int")
    return table(spark, sf, "benchmark").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).join(plan, "kind").select("kind", "n", "wanted", (F.col("n") == F.col("wanted")).alias("as_planned"))


@query("jn24_unknown_documents", "select distinct item_id from benchmark where item_id not in (select doc_id from documents where source <> 'src1')")
def jn24(spark, sf):
    """Golden items that name a document which the manifest lacks."""
    manifest = table(spark, sf, "documents").where("source <> 'src1'").select(F.col("doc_id").alias("item_id"))
    return table(spark, sf, "benchmark").select("item_id").distinct().join(manifest, "item_id", "left_anti")


@query("el12_manifest_drift", sql("chunks", rest=""", prints as (select document, sha256(string_agg(content, chr(30) order by chunk_index)) as print, count(*) as n from chunks group by document),
manifest as (select document, case when document % 9 = 0 then 'old' else print end as print, case when document % 8 = 0 then n + 1 else n end as n from prints where document % 10 <> 3)
select coalesce(p.document, m.document) as document, case when m.document is null then 'unlisted' when p.print <> m.print then 'changed' when p.n <> m.n then 'recounted' else 'same' end as state from prints p full join manifest m using (document)"""))
def el12(spark, sf):
    """Fingerprints of documents against a manifest of them: same, changed, counted anew, or not listed."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"])
    prints = corpus.chunks(spark, sf).groupBy("document").agg(F.sha2(F.array_join(listed, "\x1e"), 256).alias("print"), F.count("*").alias("n"))
    m = prints.where("document % 10 <> 3").select("document", F.when(F.col("document") % 9 == 0, "old").otherwise(F.col("print")).alias("m_print"), F.when(F.col("document") % 8 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("m_n"))
    state = F.when(F.col("m_print").isNull(), "unlisted").when(F.col("print") != F.col("m_print"), "changed").when(F.col("n") != F.col("m_n"), "recounted").otherwise("same")
    return prints.join(m, "document", "full").select("document", state.alias("state"))
