"""Queries of what comes in: languages, files against records, golden sets, answers of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import answers, golden, languages
from docweave.plans.registry import query
from docweave.session import scratch, table
from docweave.sources import files

_LANGUAGES = rf"""sample as (
  select lang, text from (select *, row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) as place from documents where lang is not null and text is not null) where place <= {languages.SAMPLE}
), letters as (
  select lang, w, unnest(range(1, length(w) + 1)) as i from (select lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from sample)
), counts as (
  select substring('_' || w || '_', i, 3) as gram, lang, count(*) as n from letters group by all
), top as (
  select gram from counts group by gram order by sum(n) desc, gram limit {languages.GRAMS}
), sums as (
  select lang, sum(n) as total from counts where gram in (select gram from top) group by lang
), weights as (
  select t.gram, s.lang, ln((coalesce(c.n, 0) + 1) / (s.total + {languages.GRAMS}.0)) as weight from top t cross join sums s left join counts c on c.gram = t.gram and c.lang = s.lang
), said as (
  select doc_id, substring('_' || w || '_', i, 3) as gram from (select doc_id, w, unnest(range(1, length(w) + 1)) as i
    from (select doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from documents where length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= {languages.LEAST_LENGTH}))
), scores as (
  select doc_id, lang, sum(weight) as score from said join weights using (gram) group by all
), best as (
  select doc_id, arg_max(lang, (score, -place)) as code, max(score) as most from (select *, row_number() over (partition by doc_id order by lang) as place from scores) group by doc_id
), detected as (
  select d.doc_id, coalesce(b.code, '{languages.UNKNOWN}') as code, round(1 / s.total, 4) as confidence
  from (select distinct doc_id from documents) d left join best b using (doc_id) left join (select doc_id, sum(exp(score - most)) as total from scores join best using (doc_id) group by doc_id) s using (doc_id)
)"""


def _detected(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return languages.detected(docs, *languages.profiles(docs))


@query("tx08_languages", f"with {_LANGUAGES} select doc_id, code, confidence from detected")
def tx08(spark, sf):
    return _detected(spark, sf)


@query("stg07_language_stage", f"with {_LANGUAGES} select d.doc_id, d.source, t.code as detected, t.confidence from documents d join detected t on t.doc_id = d.doc_id")
def stg07(spark, sf):
    """The stage of the pipeline: the metadata of each document with what was detected added to them as JSON, and read back."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    found = F.struct(F.col("code"), F.col("confidence"))
    staged = docs.join(_detected(spark, sf), "doc_id").select("doc_id", F.to_json(F.struct("source", found.alias("detected_language"))).alias("metadata"))
    read = lambda path: F.get_json_object("metadata", path)
    return staged.select("doc_id", read("$.source").alias("source"), read("$.detected_language.code").alias("detected"), read("$.detected_language.confidence").cast("double").alias("confidence"))


# ── files against records ──


@query("in07_files_and_records", """with placed as (select doc_id % 40 as part, 2 * octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
  there as (select 'part=' || part as path, sum(size) as bytes from placed where part % 7 <> 0 group by part union all select 'part=99', sum(size) from placed where part = 1),
  expected as (select 'part=' || part as path, sum(size) + case when part % 5 = 0 then 5 else 0 end as bytes, part % 11 <> 0 as wanted from placed group by part)
  select coalesce(e.path, t.path) as path, case when e.path is null then 'extra' when t.path is null then case when wanted then 'missing' else 'gone' end when not wanted then 'orphan' when e.bytes <> t.bytes then 'different' else 'valid' end as state,
    cast(e.bytes as bigint) as expected_bytes, cast(t.bytes as bigint) as bytes from expected e full join there t on t.path = e.path""")
def in07(spark, sf):
    """Documents stored as files by part: some parts are missing, one is extra, some are of another size than recorded, some belong to deleted documents. Sizes come from the listing."""
    folder = scratch(spark, "files")
    lines = table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("part"), F.hex(F.coalesce("text", F.lit(""))).alias("line"))
    stored = lines.where("part % 7 <> 0").union(lines.where("part = 1").select(F.lit(99), "line"))
    stored.repartition("part").write.partitionBy("part").text(folder)
    there = files.listed(spark, folder).groupBy(F.regexp_extract("path", "^(part=[0-9]+)/", 1).alias("path")).agg(F.sum("bytes").alias("bytes"))
    sizes = lines.groupBy("part").agg(F.sum(F.length("line") + 1).alias("size"))
    expected = sizes.select(F.concat(F.lit("part="), F.col("part").cast("string")).alias("path"), (F.col("size") + F.when(F.col("part") % 5 == 0, 5).otherwise(0)).alias("bytes"), (F.col("part") % 11 != 0).alias("wanted"))
    return files.compared(expected, there)


# ── answers of models ──

#: Answers by the last digit of a document's id, # standing for the id: well-formed, fenced, empty, broken, and with bad items.
_ANSWERS = (
    '```json\n[{"title":"T#","summary":"s","content":"c#","importance":0.75}]\n```', "[]", "", "no answer in JSON", '{"title":"T#"}',
    '[{"title":"T#","summary":"s","content":"c"}, {"title":5,"summary":"s","content":"c"}, 7, null]',
    '[{"should_remember":false,"title":"x"},{"title":"a","summary":"b","content":"c","importance":1.5},{"title":"a","summary":"b","content":"c","confidence":"0.25","category":"fact","entities":[{"name":"E"}]}]',
    '```\n[{"title":"T","summary":"s","content":"``` inside","entities":["x"]},{"title":"T#","summary":"s","content":"``` inside"}]\n``` and more', '[{"title":"T#"', '  [ {"title":"é#","summary":"","content":"c","importance":null} ]  ',
)
_RAW = f"""raws as (select doc_id, replace([{", ".join("'" + a.replace(chr(10), "' || chr(10) || '") + "'" for a in _ANSWERS)}][doc_id % 10 + 1], '#', cast(doc_id as varchar)) as raw from documents),
bare as (select doc_id, trim(case when starts_with(trim(raw), '```') then regexp_replace(regexp_replace(trim(raw), '^[^\\n]*\\n', ''), '(?s)^(.*)```.*$', '\\1') else raw end, ' ' || chr(10)) as b from raws),
parsed as (select doc_id, b, try_cast(case when b = '' then null else b end as json) as j from bare),
items as (select doc_id, i - 1 as place, json_extract(j, '$[' || (i - 1) || ']') as item from (select doc_id, j, unnest(range(1, json_array_length(j)::bigint + 1)) as i from parsed where json_type(j) = 'ARRAY')),
fields as (select *, json_type(item) as kind, json_type(item, '$.should_remember') as remember, json_type(item, '$.title') = 'VARCHAR' and json_type(item, '$.summary') = 'VARCHAR' and json_type(item, '$.content') = 'VARCHAR' as strings,
  case when json_type(item, '$.importance') is null then 0.5 when json_type(item, '$.importance') <> 'NULL' then try_cast(json_extract_string(item, '$.importance') as double) end as importance,
  case when json_type(item, '$.confidence') is null then 0.5 when json_type(item, '$.confidence') <> 'NULL' then try_cast(json_extract_string(item, '$.confidence') as double) end as confidence,
  json_type(item, '$.entities') is null or coalesce(json_type(item, '$.entities[0]'), 'OBJECT') = 'OBJECT' as objects from items),
judged as (select *, case when kind <> 'OBJECT' then 'bad' when json_extract_string(item, '$.should_remember') = 'false' then 'skipped' when coalesce(strings, false) and objects and importance between 0 and 1 and confidence between 0 and 1 then 'kept' else 'bad' end as state from fields)"""


def _answers(spark, sf):
    given = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("doc_id") % 10 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.replace(given, F.lit("#"), F.col("doc_id").cast("string")).alias("raw"))


@query("me09_memories_of_answers", f"""with {_RAW} select doc_id, cast(place as int) as place, state, case when state = 'kept' then item->>'$.title' end as title, case when state = 'kept' then item->>'$.summary' end as summary, case when state = 'kept' then item->>'$.content' end as content,
  case when state = 'kept' then importance end as importance, case when state = 'kept' then confidence end as confidence, case when state = 'kept' then coalesce(item->>'$.category', 'general') end as category from judged""")
def me09(spark, sf):
    return answers.memory_items(_answers(spark, sf), "doc_id")


@query("me09_counted_answers", f"""with {_RAW} select p.doc_id, case when b = '' then 'empty' when j is null then 'not json' when json_type(j) <> 'ARRAY' then 'not a list' else 'parsed' end as state,
  coalesce(kept, 0) as kept, coalesce(skipped, 0) as skipped, coalesce(bad, 0) as bad from parsed p left join (select doc_id, count(*) filter (state = 'kept') as kept, count(*) filter (state = 'skipped') as skipped, count(*) filter (state = 'bad') as bad from judged group by doc_id) c on c.doc_id = p.doc_id""")
def me09_counts(spark, sf):
    return answers.counted(_answers(spark, sf), "doc_id")


# ── golden sets ──

#: An item for each row of the benchmark, by its number: of all kinds, some with faults, some unreadable.
_GOLDEN = """select item_id as line, case when item_id % 11 = 10 then '{"id": "S01"' else
  '{"id":"' || substring('SMFN', (item_id % 4 + 1)::int, 1) || lpad(cast(item_id % 90 as varchar), 2, '0') || '","type":"' || case item_id % 4 when 0 then 'single_hop' when 1 then 'multi_hop' when 2 then 'follow_up' else case when item_id % 3 = 0 then 'single_hop' else 'negative' end end
  || '","source":"b","question":"' || case when item_id % 7 = 0 then 'Why' else 'What does passage ' || cast(item_id as varchar) || ' say' end || '","must_refuse":' || case when item_id % 4 = 3 then 'true' else 'false' end
  || ',"expected_docs":["d' || cast(item_id % 9 as varchar) || '","d' || cast(item_id % 5 as varchar) || '"],"expected_evidence":[{"doc":"d' || cast(item_id % 9 as varchar) || '","contains":"word"},{"doc":"d7","contains":"w"}]'
  || ',"expected_facts":[{"fact":"f","any_of":["p"],"in_source":true}],"tags":["compound","' || case when item_id % 2 = 0 then 'long_doc' else 'odd' end || '"],"review":{"status":"' || case when item_id % 6 = 0 then 'needs_review' else 'approved' end || '","reviewed_by":"r","reviewed_on":"d"}}' end as raw from benchmark"""


@query("src22_golden_issues", f"""with raws as ({_GOLDEN}), parsed as (select line, raw, case when json_valid(raw) then raw::json end as j from raws),
  it as (select line, j, j->>'$.id' as id, j->>'$.type' as type, j->>'$.question' as question, (j->>'$.must_refuse') = 'true' as refuse, j->>'$.expected_docs[0]' as d0, j->>'$.expected_docs[1]' as d1, j->>'$.tags[1]' as tag, j->>'$.review.status' as status from parsed),
  good as (select * from it where j is not null)
  select line, id, path, problem from (
    select line, null as id, '' as path, 'not an item' as problem from it where j is null
    union all select line, id, 'id', 'doesn''t go with the type' from good where id[1] <> case type when 'single_hop' then 'S' when 'multi_hop' then 'M' when 'follow_up' then 'F' else 'N' end
    union all select line, id, 'question', 'too short' from good where length(question) < 5
    union all select line, id, 'must_refuse', 'true for negative items only' from good where (type = 'negative') <> refuse
    union all select line, id, 'expected_docs', 'a negative item expects nothing' from good where type = 'negative'
    union all select line, id, 'history', 'a follow-up has history and resolution' from good where type = 'follow_up'
    union all select line, id, 'expected_docs', 'two documents at least' from good where type = 'multi_hop' and d0 = d1
    union all select line, id, 'expected_docs', 'repeated' from good where d0 = d1
    union all select line, id, 'expected_evidence[1]', 'of a document that isn''t expected' from good where d0 <> 'd7' and d1 <> 'd7'
    union all select line, id, 'expected_evidence[1]', 'too short' from good
    union all select line, id, 'tags[1]', 'unknown' from good where tag = 'odd'
    union all select line, id, 'review.status', 'not reviewed' from good where status = 'needs_review'
    union all select line, id, 'expected_docs[0]', 'not in the manifest' from good where d0 = 'd8'
    union all select line, id, 'expected_docs[1]', 'not in the manifest' from good where d1 = 'd8'
    union all select line, id, 'id', 'repeated' from good where id in (select id from good group by id having count(*) > 1))""")
def src22(spark, sf):
    """Problems of a golden set made of the benchmark's rows, against a manifest of eight documents."""
    table(spark, sf, "benchmark").createOrReplaceTempView("benchmark")
    raws = spark.sql(_GOLDEN.replace("as varchar", "as string").replace("::int", ""))
    spark.catalog.dropTempView("benchmark")
    manifest = spark.range(8).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("filename"))
    return golden.issues(golden.items(raws, keep=("line",)), manifest, keep=("line",)).select("line", "id", "path", "problem")
