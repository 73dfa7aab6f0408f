"""The engine's tables as views of the input tables: chunks, points, nodes, edges, and so on.

SQL holds the same views for DuckDB, so that a query and the SQL it is compared with start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import spread, table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as passages: id, document, chunk_index, page, content, tokens."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return lines.where("content <> ''").select(
        F.concat_ws(":", "doc_id", "i").alias("id"), F.col("doc_id").alias("document"), F.col("i").cast("long").alias("chunk_index"), F.floor(F.col("i") / 3 + 1).cast("long").alias("page"), "content", F.ceil(F.length("content") / 4).cast("long").alias("tokens")
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the fields of the application: name, uploader, status, upload time (a minute apart), and deletion of every 13th."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", "text", "lang", F.col("source").alias("uploaded_by"), "n_chars", F.concat(F.lit("DOC-"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".txt")).alias("filename"),
        F.element_at(F.array(F.lit("indexed"), F.lit("review"), F.lit("failed"), F.lit("pending")), (F.col("doc_id") % 4 + 1).cast("int")).alias("status"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"), (F.col("doc_id") % 13 == 0).alias("deleted"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("document"), F.col("embedding").alias("vector"))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    """One row's vector: the query's."""
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The star schema as a property graph: regions, nations, customers and suppliers; id, type, name, document."""
    one = lambda t, p, key, name, kind: table(spark, sf, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"))
    out = one("region", "R", "r_regionkey", "r_name", "Region")
    for args in (("nation", "N", "n_nationkey", "n_name", "Nation"), ("customer", "C", "c_custkey", "c_name", "Customer"), ("supplier", "S", "s_suppkey", "s_name", "Supplier")):
        out = out.unionByName(one(*args))
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, type, confidence: PART_OF from nations, LOCATED_IN from customers and suppliers."""
    link = lambda t, p, key, q, to, kind, sure: table(spark, sf, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("src"), F.concat(F.lit(q), F.col(to).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(sure).alias("confidence"))
    out = link("nation", "N", "n_nationkey", "R", "n_regionkey", "PART_OF", 0.9)
    out = out.unionByName(link("customer", "C", "c_custkey", "N", "c_nationkey", "LOCATED_IN", 0.75))
    return out.unionByName(link("supplier", "S", "s_suppkey", "N", "s_nationkey", "LOCATED_IN", 0.85))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts about documents, one for each label; entity, relationship, target, confidence, document name in capitals."""
    return table(spark, sf, "labels").select(F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("entity"), F.lit("HAS_LABEL").alias("relationship"), F.concat(F.lit("T"), F.col("toxic").cast("string")).alias("target"), (F.lit(0.5) + F.col("quality") * 0.25 + F.col("toxic") * 0.125).alias("confidence"), F.concat(F.lit("Doc-"), (F.col("doc_id") % 23).cast("string")).alias("document"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """An inspection report for each part: doc_id, filename, title, doc_type, content with tags, events and references."""
    n = F.col("p_partkey")
    tag = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    pump, tank, valve, sop = tag("P-", n % 900 + 100), tag("T-", F.col("p_size") + 100), tag("V-", F.col("p_size") + 200), F.concat(F.lit("SOP-"), F.lpad((n % 40).cast("string"), 3, "0"))
    event = F.when(n % 4 == 0, "Bearing failure caused vibration.").when(n % 4 == 1, "Seal leakage led to shutdown.").otherwise("No defects were noted.")
    content = F.concat(
        F.lit("Pump "), pump, F.lit(" feeds tank "), tank, F.lit(". Operator of "), pump, F.lit(" is "), F.col("p_brand"), F.lit(".\nValve "), valve, F.lit(" is connected to "), tank, F.lit(". "), event,
        F.lit("\nInspection was performed by Engineer "), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 4), F.lit(". See "), sop, F.lit(" and INC-2024-"), F.lpad((n % 97).cast("string"), 3, "0"), F.lit("."),
    )
    kind = F.element_at(F.array(F.lit("Inspection_Report"), F.lit("Incident"), F.lit("Equipment_Register"), F.lit("Notes")), (n % 4 + 1).cast("int"))
    return spread(table(spark, sf, "part"), "p_partkey").select(
        n.alias("doc_id"), F.concat(kind, F.lit("_"), pump, F.lit(".txt")).alias("filename"), F.concat(F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" "), pump).alias("title"), F.lower(kind).alias("doc_type"), content.alias("content")
    )


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Reports with marks: doc_id, text with headings, fenced code, a table, a list, a break and long paragraphs."""
    r = reports(spark, sf)
    text = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), "content", F.lit("\n\n1.2 Readings\n```\n# no heading\n\n- no item\n```\n| tag | value |\n| a | "), F.col("doc_id").cast("string"),
        F.lit(" |\n- first item\n- second item\n\nOVERVIEW\n"), F.repeat(F.concat("content", F.lit(" ")), F.col("doc_id") % 13 + 1), F.lit("\n\n---\nShort.\n\nUnderlined\n======\n~~~\nopen code\n"), "content",
    )
    return r.select("doc_id", text.alias("text"))


def placed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with confidence, document and source_document; regions and nations belong to no document."""
    n = F.substring("id", 2, 20).cast("long")
    own = F.col("type").isin("Customer", "Supplier")
    doc = F.when(own, F.concat(F.lit("doc-"), (n % 5).cast("string")))
    return nodes(spark, sf).select("id", "type", "name", (F.lit(0.5) + n % 5 / 10).alias("confidence"), doc.alias("document"), F.when(own & (n % 3 == 0), F.concat(doc, F.lit(".txt"))).alias("source"))


def placed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with document and source_document, which for some differ from those of their ends."""
    n = F.substring("src", 2, 20).cast("long")
    doc = F.when(F.col("type") == "LOCATED_IN", F.concat(F.lit("doc-"), F.when(n % 7 == 0, n % 4).otherwise(n % 5).cast("string")))
    return edges(spark, sf).select("src", "dst", "type", "confidence", doc.alias("document"), F.when(n % 2 == 0, F.concat(doc, F.lit(".txt"))).alias("source"))


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """Four turns about each report: a question, an answer, a question that may lean on the first, and a last one; conv_id, turn, role, content."""
    r = reports(spark, sf).select("doc_id", "content", F.regexp_extract("content", "(P-[0-9]+)", 1).alias("pump"), F.regexp_extract("content", "(V-[0-9]+)", 1).alias("valve"))
    third = F.when(F.col("doc_id") % 4 == 0, "What about the bearings?").when(F.col("doc_id") % 4 == 1, "Why did it fail, and were its seals checked by them?").when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("Who inspected valve "), F.col("valve"), F.lit(" last year?"))
    ).otherwise("Next steps?")
    said = [("user", F.concat(F.lit("What is the vibration status of pump "), F.col("pump"), F.lit("?"))), ("assistant", F.col("content")), ("user", third), ("user", F.lit("Tell me more"))]
    return r.select(F.col("doc_id").alias("conv_id"), F.posexplode(F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in said])).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content"
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """Memories of users: labelled documents that have a vector; the whole text as content, its beginning as title; importance by quality, confidence by toxicity."""
    d, e, l = table(spark, sf, "documents"), table(spark, sf, "embeddings"), table(spark, sf, "labels")
    return d.join(e, d["doc_id"] == e["vec_id"]).join(l, "doc_id").select(
        "doc_id", F.col("source").alias("user"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), F.col("embedding").alias("vector"),
        (F.col("quality") * 0.5 + 0.25).alias("importance"), (1 - F.col("toxic") * 0.5).alias("confidence"), F.when(F.col("doc_id") % 7 == 0, "archived").otherwise("active").alias("status"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("expires_at"),
    )


SQL = {
    "chunks": """chunks as (select doc_id || ':' || i as id, doc_id as document, i as chunk_index, cast(floor(i / 3 + 1) as bigint) as page, content, cast(ceil(length(content) / 4) as bigint) as tokens
  from (select doc_id, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as content from documents) where content <> '')""",
    "docs": """docs as (select doc_id, text, lang, source as uploaded_by, n_chars, 'DOC-' || lpad(cast(doc_id as varchar), 6, '0') || '.txt' as filename,
  ['indexed', 'review', 'failed', 'pending'][doc_id % 4 + 1] as status, timestamp '2024-01-01' + to_minutes(cast(doc_id as int)) as created_at, doc_id % 13 = 0 as deleted from documents)""",
    "reports": """reports as (select doc_id, kind || '_' || pump || '.txt' as filename, replace(kind, '_', ' ') || ' ' || pump as title, lower(kind) as doc_type,
  'Pump ' || pump || ' feeds tank ' || tank || '. Operator of ' || pump || ' is ' || p_brand || '.' || chr(10) || 'Valve ' || valve || ' is connected to ' || tank || '. '
  || case when doc_id % 4 = 0 then 'Bearing failure caused vibration.' when doc_id % 4 = 1 then 'Seal leakage led to shutdown.' else 'No defects were noted.' end
  || chr(10) || 'Inspection was performed by Engineer ' || upper(substring(p_name, 1, 1)) || substring(p_name, 2, 4) || '. See SOP-' || lpad(cast(doc_id % 40 as varchar), 3, '0') || ' and INC-2024-' || lpad(cast(doc_id % 97 as varchar), 3, '0') || '.' as content
  from (select p_partkey as doc_id, p_brand, p_name, 'P-' || (p_partkey % 900 + 100) as pump, 'T-' || (p_size + 100) as tank, 'V-' || (p_size + 200) as valve,
    ['Inspection_Report', 'Incident', 'Equipment_Register', 'Notes'][p_partkey % 4 + 1] as kind from part))""",
    "structured": """structured as (select doc_id, '# ' || title || chr(10) || chr(10) || content || chr(10) || chr(10) || '1.2 Readings' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || chr(10) || '- no item' || chr(10) || '```' || chr(10)
  || '| tag | value |' || chr(10) || '| a | ' || doc_id || ' |' || chr(10) || '- first item' || chr(10) || '- second item' || chr(10) || chr(10) || 'OVERVIEW' || chr(10) || repeat(content || ' ', doc_id % 13 + 1) || chr(10) || chr(10)
  || '---' || chr(10) || 'Short.' || chr(10) || chr(10) || 'Underlined' || chr(10) || '======' || chr(10) || '~~~' || chr(10) || 'open code' || chr(10) || content as text from reports)""",
    "pnodes": """pnodes as (select id, type, name, 0.5 + n % 5 / 10 as confidence, doc as document, case when n % 3 = 0 then doc || '.txt' end as source from (
  select *, cast(substring(id, 2) as bigint) as n, case when type in ('Customer', 'Supplier') then 'doc-' || (cast(substring(id, 2) as bigint) % 5) end as doc from nodes))""",
    "pedges": """pedges as (select src, dst, type, confidence, doc as document, case when n % 2 = 0 then doc || '.txt' end as source from (
  select *, cast(substring(src, 2) as bigint) as n, case when type = 'LOCATED_IN' then 'doc-' || case when cast(substring(src, 2) as bigint) % 7 = 0 then cast(substring(src, 2) as bigint) % 4 else cast(substring(src, 2) as bigint) % 5 end end as doc from edges))""",
    "dialogues": """dialogues as (select doc_id as conv_id, unnest([0, 1, 2, 3])::bigint as turn, unnest(['user', 'assistant', 'user', 'user']) as role,
  unnest(['What is the vibration status of pump ' || pump || '?', content, case when doc_id % 4 = 0 then 'What about the bearings?' when doc_id % 4 = 1 then 'Why did it fail, and were its seals checked by them?'
    when doc_id % 4 = 2 then 'Who inspected valve ' || valve || ' last year?' else 'Next steps?' end, 'Tell me more']) as content
  from (select *, regexp_extract(content, '(P-[0-9]+)', 1) as pump, regexp_extract(content, '(V-[0-9]+)', 1) as valve from reports))""",
    "points": "points as (select vec_id as id, label as document, embedding as vector from embeddings)",
    "nodes": """nodes as (select 'R' || r_regionkey as id, 'Region' as type, r_name as name from region union all select 'N' || n_nationkey, 'Nation', n_name from nation
  union all select 'C' || c_custkey, 'Customer', c_name from customer union all select 'S' || s_suppkey, 'Supplier', s_name from supplier)""",
    "edges": """edges as (select 'N' || n_nationkey as src, 'R' || n_regionkey as dst, 'PART_OF' as type, cast(0.9 as double) as confidence from nation
  union all select 'C' || c_custkey, 'N' || c_nationkey, 'LOCATED_IN', 0.75 from customer union all select 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN', 0.85 from supplier)""",
    "facts": """facts as (select 'Q' || quality as entity, 'HAS_LABEL' as relationship, 'T' || toxic as target, cast(0.5 + quality * 0.25 + toxic * 0.125 as double) as confidence, 'Doc-' || (doc_id % 23) as document from labels)""",
    "memories": """memories as (select d.doc_id, source as user_name, substring(text, 1, 40) as title, text as content, embedding as vector, cast(quality * 0.5 + 0.25 as double) as importance,
  cast(1 - toxic * 0.5 as double) as confidence, case when d.doc_id % 7 = 0 then 'archived' else 'active' end as status, timestamp '2024-01-01' + to_hours(cast(d.doc_id as int)) as expires_at
  from documents d join embeddings e on d.doc_id = e.vec_id join labels l on d.doc_id = l.doc_id)""",
}


def sql(*views: str, rest: str) -> str:
    """DuckDB SQL over the named views."""
    return "with recursive " + ",\n".join(SQL[v] for v in views) + ("" if rest.lstrip().startswith(",") else "\n") + rest
