"""Queries of dialogues: mentions, earlier context, rewritten questions, and what users say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import understanding as un
from docweave.plans.registry import query
from docweave.sources import corpus
from docweave.sources.corpus import sql, table

_PREFIXES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in un.PREFIX_TYPES.items()) + "}"


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def mentions_sql(text: str) -> str:
    """The list of mentions of a text in DuckDB."""
    canon = lambda t: f"case when contains(upper(regexp_replace(regexp_replace({t}, '\\s+', '', 'g'), '[–—/]', '-', 'g')), '-') then upper(regexp_replace(regexp_replace({t}, '\\s+', '', 'g'), '[–—/]', '-', 'g')) else regexp_replace(upper(regexp_replace({t}, '\\s+', '', 'g')), '^([A-Z]+)([0-9]+)$', '\\1-\\2') end"
    prefix = "regexp_replace(n, '[-0-9]+$', '')"
    look = lambda k: f"{_PREFIXES}[{k}]"
    part = "coalesce(" + ", ".join(look(f"left({prefix}, {n})") for n in (4, 3, 2, 1)) + ")"
    tag = f"lambda x: list_transform([{canon('x[1]')}], lambda n: {{'name': n, 'type': coalesce({look(prefix)}, {part}, 'Equipment'), 'original': x[2], 'confidence': case when {look(prefix)} is not null then 0.9 when {part} is not null then 0.85 else 0.6 end::double}})[1]"
    tags = lambda p, g: f"list_transform(list_zip(regexp_extract_all({text}, '{p}', {g}), regexp_extract_all({text}, '{p}', 0)), {tag})"
    low = lambda words: ", ".join(f"'{w.lower()}'" for w in words)
    paper = f"lambda x: {{'name': upper(x[1]) || '-' || x[2], 'type': case when lower(x[1]) in ({low(un.PROCEDURE_WORDS)}) then 'Procedure' when lower(x[1]) in ({low(un.INCIDENT_WORDS)}) then 'Failure' else 'Document' end, 'original': x[3], 'confidence': 0.9::double}}"
    papers = f"list_transform(list_zip(regexp_extract_all({text}, '{un.NUMBERED}', 1), regexp_extract_all({text}, '{un.NUMBERED}', 2), regexp_extract_all({text}, '{un.NUMBERED}', 0)), {paper})"
    return f"list_concat({tags(un.TAGGED, 2)}, {papers}, {tags(un.BARE, 1)})"


_FIRSTS = "list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: y.{k}), x.{k}) = i)"
_RANK = "case when regexp_matches(t, '[0-9]') and regexp_matches(t, '[-.]') then 0 when regexp_matches(t, '[0-9]') then 1 else 2 end"


def terms_sql(text: str) -> str:
    """Query terms of a text in DuckDB."""
    stop = _listed(tx.QUERY_STOPWORDS)
    kept = f"list_filter(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*'), lambda t: length(t) >= 2 and not list_contains({stop}, lower(t)))"
    first = f"list_transform([{kept}], lambda a: list_filter(a, lambda t, i: list_position(list_transform(a, lambda u: lower(u)), lower(t)) = i))[1]"
    return f"list_transform(list_sort(list_transform({first}, lambda t, i: {{'rank': {_RANK}, 'size': -length(t), 'place': i, 'term': t}})), lambda s: s.term)[1:12]"


@query("tx01_query_terms", f"select item_id, {terms_sql('text')} as terms from benchmark")
def tx01(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.query_terms(F.col("text")).alias("terms"))


_OWN = f"""said as (select *, {mentions_sql('content')} as all_mentions, {terms_sql('content')} as terms from dialogues),
owned as (select * exclude (all_mentions), {_FIRSTS.format(a='all_mentions', k='name')} as own from said)"""


@query("tx23_entity_mentions", sql("reports", "dialogues", rest=f", {_OWN}, one as (select conv_id, turn, unnest(own) as m from owned) select conv_id, turn, m.name as name, m.type as type, m.original as original, m.confidence as confidence from one"))
def tx23(spark, sf):
    return corpus.dialogues(spark, sf).select("conv_id", "turn", F.explode(un.mentions(F.col("content"))).alias("m")).select("conv_id", "turn", "m.*")


_MARKED = "|".join(un.MARKERS).replace("'", "''")
_BARE_QUESTION = "ltrim(lower(content), '\"''( ')"
_LEANS = f"""leaning as (select *, case when len(own) > 0 and len(terms) >= 3 then false else (regexp_matches(lower(content), '\\b({_MARKED})\\b') and len(own) = 0)
  or len(list_filter({_listed(un.OPENERS)}, lambda o: {_BARE_QUESTION} = o or starts_with({_BARE_QUESTION}, o || ' '))) > 0 or (len(own) = 0 and len(terms) < 3) end as leans from owned)"""


@query("qu01_context_dependent", sql("reports", "dialogues", rest=f", {_OWN}, {_LEANS} select conv_id, turn, leans from leaning where role = 'user'"))
def qu01(spark, sf):
    d = corpus.dialogues(spark, sf).where("role = 'user'")
    return d.select("conv_id", "turn", un.leans_back(F.col("content"), un.mentions(F.col("content")), tx.query_terms(F.col("content"))).alias("leans"))


#: Earlier messages are at most six turns back; what lies nearer to the question counts first.
_PRIOR = f"""{_LEANS},
earlier as (select q.conv_id, q.turn, q.turn - p.turn as back, p.role, p.own as p_own, p.terms as p_terms, q.own as q_own, q.terms as q_terms
  from leaning q join leaning p on p.conv_id = q.conv_id and p.turn < q.turn and p.turn >= q.turn - {un.LOOK_BACK} where q.role = 'user'),
named as (select conv_id, turn, back, e.name as word, lower(e.name) as key, i from (select conv_id, turn, back, q_own, unnest(p_own) as e, unnest(range(len(p_own))) as i from earlier)
  where not list_contains(list_transform(q_own, lambda x: lower(x.name)), lower(e.name)) qualify row_number() over (partition by conv_id, turn, lower(e.name) order by back, i) = 1),
asked as (select conv_id, turn, back, t as word, lower(t) as key, i from (select conv_id, turn, back, q_own, q_terms, unnest(p_terms) as t, unnest(range(len(p_terms))) as i from earlier where role = 'user' and len(q_terms) < {un.OWN_TOPIC})
  where not list_contains(list_transform(q_terms, lambda x: lower(x)), lower(t)) and not list_contains(list_transform(q_own, lambda x: lower(x.name)), lower(t))),
fresh as (select * from asked a where not exists (select 1 from named n where n.conv_id = a.conv_id and n.turn = a.turn and n.key = a.key and n.back <= a.back)
  qualify row_number() over (partition by conv_id, turn, key order by back, i) = 1),
carried as (select q.conv_id, q.turn, q.content, q.leans, coalesce((select list(word order by back, i) from named n where n.conv_id = q.conv_id and n.turn = q.turn), [])[1:{un.ENTITIES}] as entities,
  coalesce((select list(word order by back, i) from fresh f where f.conv_id = q.conv_id and f.turn = q.turn), [])[1:{un.TERMS}] as terms, exists (select 1 from earlier e where e.conv_id = q.conv_id and e.turn = q.turn) as later
  from leaning q where q.role = 'user')"""


def _carried(spark, sf):
    """Users' messages with the entities and terms that earlier ones lend them."""
    rows = un.with_history(corpus.dialogues(spark, sf)).where("role = 'user'")
    entities, terms = un.prior(F.col("content"), F.col("history"), un.mentions(F.col("content")), tx.query_terms(F.col("content")))
    return rows.select("conv_id", "turn", "content", entities.alias("entities"), terms.alias("terms"))


@query("qu02_prior_context", sql("reports", "dialogues", rest=f", {_OWN}, {_PRIOR} select conv_id, turn, entities, terms from carried"))
def qu02(spark, sf):
    return _carried(spark, sf).drop("content")


_PRONOUNS = "|".join(un.PRONOUNS).replace("'", "''")
_REWRITTEN = f"""swapped as (select *, later and leans as follow_up, case when len(entities) > 0 then regexp_replace(content, '(?i)\\b({_PRONOUNS})\\b', entities[1], 'g') else content end as swap from carried),
done as (select *, trim(swap || case when len(list_filter(list_concat(entities, terms), lambda w: not regexp_matches(swap, '(?i)(^|\\W)' || regexp_escape(w) || '($|\\W)'))) > 0
  then ' ' || array_to_string(list_filter(list_concat(entities, terms), lambda w: not regexp_matches(swap, '(?i)(^|\\W)' || regexp_escape(w) || '($|\\W)')), ' ') else '' end) as rewritten from swapped)"""


@query("qu03_rewritten_question", sql("reports", "dialogues", rest=f", {_OWN}, {_PRIOR}, {_REWRITTEN} select conv_id, turn, rewritten from done"))
def qu03(spark, sf):
    return _carried(spark, sf).select("conv_id", "turn", un.rewritten(F.col("content"), F.col("entities"), F.col("terms")).alias("rewritten"))


@query("qu04_resolved_question", sql("reports", "dialogues", rest=f""", {_OWN}, {_PRIOR}, {_REWRITTEN} select conv_id, turn, content as question, case when follow_up then rewritten else content end as search_query, follow_up,
  case when follow_up then entities else [] end as entities, case when follow_up then terms else [] end as terms, case when follow_up and rewritten <> content then 'Read in context as: ' || rewritten else '' end as note from done"""))
def qu04(spark, sf):
    return un.resolved(corpus.dialogues(spark, sf))


_STATEMENT = """case c_custkey % 4 when 0 then 'My name is Anna Berg. I manage the Pump P' || (c_custkey + 100) || '.' when 1 then 'I work at the ' || c_mktsegment || ' plant' when 2 then 'I am a reliability engineer, and I manage spare parts!' else 'Where is it?' end"""


@query("tx24_user_statements", f"""with said as (select c_custkey, {_STATEMENT} as s from customer), found as (
  select c_custkey, unnest([{{'relation': 'HAS_NAME', 'object': regexp_extract(s, '(?i)\\b(?:my name is|i am called) (\\pL+(?: \\pL+)*)', 1)}}, {{'relation': 'OWNS', 'object': regexp_extract(s, '(?i)\\bi manage (?:the |a |an )?([^.!?\\n]+)', 1)}},
    {{'relation': 'WORKS_AT', 'object': regexp_extract(s, '(?i)\\bi work (?:for|at|in) (?:the )?([^.!?\\n]+)', 1)}}, {{'relation': 'HAS_ROLE', 'object': regexp_extract(s, '(?i)\\bi (?:am a|am an|have role) ([^.!?\\n]+)', 1)}}]) as f from said)
  select c_custkey, f.relation as relation, case when starts_with(f.object, 'Pump P') then 'P-' || (c_custkey + 100) else trim(f.object) end as object from found where f.object <> ''""")
def tx24(spark, sf):
    n = F.col("c_custkey")
    said = F.when(n % 4 == 0, F.concat(F.lit("My name is Anna Berg. I manage the Pump P"), (n + 100).cast("string"), F.lit("."))).when(n % 4 == 1, F.concat(F.lit("I work at the "), "c_mktsegment", F.lit(" plant")))
    said = said.when(n % 4 == 2, "I am a reliability engineer, and I manage spare parts!").otherwise("Where is it?")
    return un.statements(table(spark, sf, "customer").select("c_custkey", said.alias("s")), "c_custkey", "s")


@query("tx25_conversation_titles", "select conv_id, left(array_to_string(regexp_split_to_array(trim(string_split(trim(coalesce(first, '')), chr(10))[1]), '\\s+')[1:8], ' '), 80) as title from (select conv_id, arg_min(text, turn) as first from conversations where role = 'user' group by conv_id)")
def tx25(spark, sf):
    return corpus.messages(spark, sf).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first")).select("conv_id", tx.ordinal_title(F.col("first")).alias("title"))


@query("cv03_turn_context", sql("reports", "dialogues", rest=f""", {_OWN}, answers as (select conv_id, max(turn) as turn, arg_max(content, turn) as answer from dialogues where role = 'assistant' group by conv_id),
  first_named as (select conv_id, list_distinct(list(m.name)) as names from (select conv_id, unnest(own) as m from owned) group by conv_id)
  select conv_id, 'Last answer: ' || left(answer, 200) || chr(10) || 'Known: ' || array_to_string(list_sort(names), ', ') as context from answers join first_named using (conv_id)"""))
def cv03(spark, sf):
    """What is laid before a model for the next turn: the last answer's beginning, and the entities that the dialogue named."""
    d = corpus.dialogues(spark, sf).withColumn("names", F.transform(un.mentions(F.col("content")), lambda m: m["name"]))
    told = lambda c: F.when(F.col("role") == "assistant", F.col(c))
    one = d.groupBy("conv_id").agg(F.max_by(told("content"), told("turn")).alias("answer"), F.count_if(F.col("role") == "assistant").alias("answers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    text = F.concat(F.lit("Last answer: "), F.substring("answer", 1, 200), F.lit("\nKnown: "), F.array_join("names", ", "))
    return one.where((F.col("answers") > 0) & (F.size("names") > 0)).select("conv_id", text.alias("context"))
