"""Queries over texts: terms, headings, tags, classes, chunks, screens and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.config import EVIDENCE
from docweave.functions import text as tx
from docweave.operators import chunking, evidence
from docweave.plans import chunk_sql
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql, table


_SHAPE = r"""regexp_matches(b, '^#{1,6}\s+.') or regexp_matches(b, '^[0-9]+(\.[0-9]+)*[.)]?\s+.') or regexp_matches(b, '(?i)^[IVXLCDM]+[.)]\s+.') or regexp_matches(b, '(?i)^(section|chapter|part|appendix)\s+[0-9IVXLCDMA]+[\s:].')"""
_HEADINGS = f"""lined as (select doc_id, unnest(range(len(p))) as n, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from structured)),
placed as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as off, lead(line) over (partition by doc_id order by n) as after, trim(line) as b from lined),
titles as (select doc_id, cast(off as bigint) as "offset", b as title from placed where b <> '' and ((length(b) <= 200 and not regexp_matches(b, '[.!?;:]$') and ({_SHAPE} or (upper(b) = b and lower(b) <> b and length(b) > 3))) or coalesce(regexp_matches(after, '^[=-]+\\s*$'), false)))"""


@query("tx03_headings", sql("reports", "structured", rest=f", {_HEADINGS} select * from titles"))
def tx03(spark, sf):
    return chunking.headings(chunking.lines(corpus.structured(spark, sf)))


@query("wn05_section_titles", sql("reports", "structured", rest=f", {_HEADINGS}, asked as (select doc_id, unnest([0, 50, 200, 400, 900]) as off from structured) select a.doc_id, a.off as \"offset\", arg_max(title, t.\"offset\") as title from asked a left join titles t on t.doc_id = a.doc_id and t.\"offset\" <= a.off group by all"))
def wn05(spark, sf):
    asked = corpus.structured(spark, sf).select("doc_id", F.explode(F.array(*[F.lit(n) for n in (0, 50, 200, 400, 900)])).alias("offset"))
    return chunking.section_of(asked, chunking.headings(chunking.lines(corpus.structured(spark, sf)))).select("doc_id", "offset", "title")


#: Whole documents and marked reports (with negative ids) as the chunker's texts.
_TEXTS = "texts as (select doc_id, text from documents union all select -doc_id - 1, text from structured)"


def _chunked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").unionByName(corpus.structured(spark, sf).withColumn("doc_id", -F.col("doc_id") - 1))


@query("tx04_regions", sql("reports", "structured", rest=f', {chunk_sql.lines("structured")} select doc_id, region, type, content, off as "offset" from regions'))
def tx04(spark, sf):
    return chunking.regions_of(corpus.structured(spark, sf))


@query("tx05_paragraph_pieces", f"""with recursive whole_texts as (select doc_id as key, text as content from documents where text <> ''), {chunk_sql.pieces("part", "whole_texts")} select key as doc_id, cast(piece as int) as piece, cast(start as int) as start, content from part""")
def tx05(spark, sf):
    """Pieces of whole documents, as paragraphs that are too long are cut."""
    return table(spark, sf, "documents").where("text <> ''").select("doc_id", F.posexplode(chunking.pieces(F.col("text"))).alias("piece", "p")).select("doc_id", "piece", "p.start", "p.content")


@query("wn07_packed_passages", sql("reports", "structured", rest=f', {chunk_sql.lines("structured")}, {chunk_sql.passages()} select doc_id, cast(place as int) as place, off as "offset", content from packed'))
def wn07(spark, sf):
    return chunking.packed_lists(chunking.parted(chunking.outlined(corpus.structured(spark, sf))))


@query("wn08_merged_passages", sql("reports", "structured", rest=f', {chunk_sql.lines("structured")}, {chunk_sql.passages()} select doc_id, cast(chunk_index as int) as chunk_index, off as "offset", content from chunks_'))
def wn08(spark, sf):
    return chunking.merged(wn07(spark, sf))


#: Pages of 3,000 characters.
_PAGES = "pages_ as (select doc_id, unnest(range(1, (length(coalesce(text, '')) + 2999) // 3000 + 1)) as page from texts)"


@query("tx06_chunks", sql("reports", "structured", rest=f""", {_TEXTS}, {chunk_sql.lines("texts")}, {chunk_sql.passages()}, {_PAGES},
  sections as (select c.doc_id, c.chunk_index, arg_max(t.title, t.off) as section from chunks_ c left join titles t on t.doc_id = c.doc_id and t.off <= c.off group by all),
  paged as (select c.doc_id, c.chunk_index, max(p.page) as page from chunks_ c left join pages_ p on p.doc_id = c.doc_id and (p.page - 1) * 3000 <= c.off group by all)
  select c.doc_id, c.chunk_index, c.total, s.section, p.page, c.off as start, c.tokens, c.content from chunks_ c join sections s using (doc_id, chunk_index) join paged p using (doc_id, chunk_index)"""))
def tx06(spark, sf):
    """Passages with their sections and pages."""
    texts = _chunked(spark, sf)
    n = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 3000).cast("int")
    pages = texts.select("doc_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("page")).withColumn("offset", (F.col("page") - 1) * 3000)
    return chunking.chunks(texts, pages=pages)


@query("tx07_chunks_with_language", f"""with recursive {chunk_sql.lines("documents")}, {chunk_sql.passages()} select c.doc_id, c.chunk_index, d.lang, c.tokens from chunks_ c join documents d on d.doc_id = c.doc_id""")
def tx07(spark, sf):
    """Passages with their documents' language."""
    lang = table(spark, sf, "documents").select("doc_id", "lang")
    return chunking.chunks(table(spark, sf, "documents")).join(lang, "doc_id").select("doc_id", "chunk_index", "lang", "tokens")


@query("el14_other_chunks", f"""with recursive {chunk_sql.lines("documents")}, {chunk_sql.passages(128, 16)} select substring(sha256(doc_id || ':' || chunk_index || ':' || content), 1, 32) as id, doc_id, chunk_index, tokens from chunks_""")
def el14(spark, sf):
    """Another collection of passages, of half the size, with ids that rest on what they hold."""
    rows = chunking.chunks(table(spark, sf, "documents"), size=128, least=16)
    return rows.select(F.substring(F.sha2(F.concat_ws(":", "doc_id", "chunk_index", "content"), 256), 1, 32).alias("id"), "doc_id", "chunk_index", "tokens")


@query("tx10_tags", """select doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Z]{1,3}[- ]?[0-9]{2,5}'), lambda x: upper(replace(x, ' ', '')))).len() as n_tags from documents""")
def tx10(spark, sf):
    found = F.regexp_extract_all("text", F.lit(r"[A-Z]{1,3}[- ]?[0-9]{2,5}"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", F.size(F.array_distinct(F.transform(found, lambda t: F.upper(F.replace(t, F.lit(" "), F.lit("")))))).cast("long").alias("n_tags"))


@query("tx11_normal_tags", "select p_partkey, upper(regexp_replace(regexp_replace(regexp_replace(p_brand, '\\s+', '', 'g'), '[-–—/]+', '-', 'g'), '([A-Za-z])([0-9])', '\\1-\\2', 'g')) as tag from part")
def tx11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.normal_tag(F.col("p_brand")).alias("tag"))


@query("tx12_entity_ids", sql("nodes", rest="select id, substring(sha256(type || ':' || lower(name)), 1, 16) as entity from nodes"))
def tx12(spark, sf):
    return corpus.nodes(spark, sf).select("id", tx.entity_id(F.col("type"), F.col("name")).alias("entity"))


@query("tx28_unique_texts", "select sha256(text) as key, count(*) as n, min(doc_id) as doc_id from documents where text is not null group by text")
def tx28(spark, sf):
    return table(spark, sf, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


_ABBREVIATED = "|".join(a.replace(".", "[.]") for a in tx.ABBREVIATIONS)


def sentences_sql(text: str) -> str:
    """The list of statements of a text in DuckDB: dots of abbreviations are hidden while ends are marked."""
    line = "trim(regexp_replace(trim(s), '^[*\\-+#> ]+', ''))"
    hidden = f"regexp_replace({line}, '\\b({_ABBREVIATED})[.]', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({hidden}, '([.!?])\\s+([A-Z(\\[*\\-#])', '\\1' || chr(2) || '\\2', 'g')"
    parts = f"flatten(list_transform(list_filter(string_split({text}, chr(10)), lambda s: {line} <> ''), lambda s: string_split({marked}, chr(2))))"
    return f"list_filter(list_transform({parts}, lambda p: trim(replace(p, chr(1), '.'))), lambda p: p <> '')"


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOP = _listed([*tx.EVIDENCE_STOPWORDS, *tx.BOILERPLATE])


def tokens_sql(text: str) -> str:
    bare = f"list_filter(list_transform(regexp_extract_all(lower({text}), '{tx.EVIDENCE_TOKEN}'), lambda t: trim(t, '{tx.TOKEN_EDGE}')), lambda t: length(t) >= 2 and not list_contains({_STOP}, t))"
    return f"list_transform([{bare}], lambda a: list_filter(a, lambda t, i: list_position(a, t) = i))[1]"


_SAID = """said as (select doc_id, filename, content, split_part(content, chr(10), 1) || ' It may fail again, e.g. P-7. ' || chr(10) || '- ' || split_part(content, chr(10), 2) || ' Nothing else was tested elsewhere! Maybe (not) approx. 5 times? Yes.' || chr(10) || chr(10)
  || '## ' || split_part(content, chr(10), 3) as answer from reports)"""


def said(spark, sf):
    """Answers that mix a report's statements with guesses and with what it doesn't say."""
    part = lambda n: F.get(F.split("content", "\n"), n)
    text = F.concat(part(0), F.lit(" It may fail again, e.g. P-7. \n- "), part(1), F.lit(" Nothing else was tested elsewhere! Maybe (not) approx. 5 times? Yes.\n\n## "), part(2))
    return corpus.reports(spark, sf).select("doc_id", "filename", "content", text.alias("answer"))


@query("ev01_sentences", sql("reports", rest=f", {_SAID}, s as (select doc_id, {sentences_sql('answer')} as s from said) select doc_id, unnest(range(len(s)))::int as n, unnest(s) as sentence from s"))
def ev01(spark, sf):
    return said(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("answer"))).alias("n", "sentence"))


@query("ev02_content_tokens", f"select doc_id, {tokens_sql('text')} as tokens from documents where text is not null")
def ev02(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", tx.content_tokens(F.col("text")).alias("tokens"))


_HEDGED = f"len(list_filter({_listed(tx.HEDGES)}, lambda h: contains(lower(sentence), h))) > 0"
_CLASSES = f"""{_SAID}, parted as (select doc_id, {sentences_sql('answer')} as s from said), stated as (select doc_id, unnest(range(len(s)))::int as n, unnest(s) as sentence from parted), toks as (select *, {tokens_sql('sentence')} as tokens from stated),
known as (select doc_id, filename as source, {tokens_sql('content')} as k from said), shared as (select t.doc_id, n, source, sentence, len(tokens) as size, len(list_intersect(tokens, k)) as overlap from toks t join known using (doc_id)),
good as (select doc_id, n, list(source order by -overlap / size::double, source)[1:3] as found from shared where overlap >= 3 and size >= 3 and overlap / size::double >= 0.4 group by doc_id, n),
classes as (select cast(t.doc_id as varchar) as answer, t.n, sentence, case when {_HEDGED} then 'HYPOTHESIS' when found is not null then 'FACT' else 'UNKNOWN' end as verdict, case when not ({_HEDGED}) and found is not null then found else [] end as sources from toks t left join good g on g.doc_id = t.doc_id and g.n = t.n)"""


@query("ev03_evidence_classes", sql("reports", rest=f", {_CLASSES} select * from classes"))
def ev03(spark, sf):
    """Sentences of answers against the documents that they cite."""
    rows = said(spark, sf)
    answers = rows.select(F.col("doc_id").cast("string").alias("answer"), "doc_id", F.col("answer").alias("answer_text"))
    sources = rows.select("doc_id", F.col("filename").alias("source"), F.col("content").alias("source_text"))
    return evidence.classified(answers, sources, "doc_id", EVIDENCE)


@query("ev04_grounding_guard", sql("reports", rest=f", {_CLASSES} select answer, case when count(*) filter (verdict <> 'UNKNOWN') > 0 then string_agg(sentence, ' ' order by n) filter (verdict <> 'UNKNOWN') else 'The sources do not answer this.' end as text, count(*) filter (verdict = 'UNKNOWN') as dropped from classes group by answer"))
def ev04(spark, sf):
    return evidence.guarded(ev03(spark, sf))


@query("ag24_evidence_counts", sql("reports", rest=f", {_CLASSES} select verdict, count(*) as n from classes group by verdict"))
def ag24(spark, sf):
    return ev03(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query("ag25_grounding_ranking", sql("reports", rest=f", {_CLASSES} select source, count(*) as n from (select unnest(sources) as source from classes where verdict = 'FACT') group by source"))
def ag25(spark, sf):
    return ev03(spark, sf).where("verdict = 'FACT'").select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("el08_grounding_summary", sql("reports", rest=f", {_CLASSES} select answer, count(*) filter (verdict = 'FACT') as grounded, count(*) filter (verdict = 'HYPOTHESIS') as hedged, count(*) filter (verdict = 'UNKNOWN') as unsupported, count(*) filter (verdict = 'FACT') / count(*)::double as share from classes group by answer"))
def el08(spark, sf):
    n = lambda v: F.count_if(F.col("verdict") == v)
    return ev03(spark, sf).groupBy("answer").agg(n("FACT").alias("grounded"), n("HYPOTHESIS").alias("hedged"), n("UNKNOWN").alias("unsupported"), (n("FACT") / F.count("*")).alias("share"))


@query("jn23_evidence_in_documents", "select item_id, count(d.doc_id) as n_documents from benchmark b left join documents d on contains(d.text, b.text) group by item_id")
def jn23(spark, sf):
    """Whole benchmark passages inside documents: matched by their first line's hash, then confirmed on whole texts."""
    return evidence.contained(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
