"""Golden sets and manifests from JSON text: each record read by itself, each problem named by its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of items with the letter that their ids begin with, states of a review, tags.
PREFIX = {"single_hop": "S", "multi_hop": "M", "follow_up": "F", "negative": "N"}
REVIEWS = ("approved", "revised", "rejected", "needs_review")
TAGS = ("compound", "table_row", "no_lexical_overlap", "entity_resolution", "ocr_source", "false_premise", "distractor_doc", "long_doc")

ITEM = """id string, type string, source string, question string, history array<struct<role: string, content: string>>, expected_resolution array<string>, expected_docs array<string>,
    expected_evidence array<struct<doc: string, contains: string>>, expected_facts array<struct<fact: string, any_of: array<string>, in_source: boolean>>, must_refuse boolean, tags array<string>,
    review struct<status: string, reviewed_by: string, reviewed_on: string, notes: string>, _corrupt_record string"""


def items(lines: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` and item of each line of JSON; one that is no JSON object has it in item._corrupt_record."""
    return lines.select(*keep, F.from_json(raw, ITEM, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("item"))


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _at(name: str, bad: Column, problem: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.lit(name).alias("path"), F.lit(problem).alias("problem")))).otherwise(F.array().cast("array<struct<path:string,problem:string>>"))


def _each(name: str, parts: Column, bad, problem: str) -> Column:
    """Problems of the parts of an array, named by their places."""
    listed = F.transform(parts, lambda x, i: F.when(F.coalesce(bad(x), F.lit(True)), F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")).alias("path"), F.lit(problem).alias("problem"))))
    return F.coalesce(F.filter(listed, lambda p: p.isNotNull()), F.array().cast("array<struct<path:string,problem:string>>"))


def issues(rows: DataFrame, manifest: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep`, id, path, problem of items (item; see `items`) against a manifest (filename): what is missing or of a wrong form, what doesn't go with the item's kind, documents that the manifest doesn't have, and ids that come twice."""
    i = lambda f: F.col(f"item.{f}")
    docs, negative, follow = i("expected_docs"), i("type") == "negative", i("type") == "follow_up"
    nothing = _none(docs) & _none(i("expected_evidence")) & _none(i("expected_facts"))
    all_there = ~_none(docs) & ~_none(i("expected_evidence")) & ~_none(i("expected_facts"))
    prefix = F.create_map(*[F.lit(x) for pair in PREFIX.items() for x in pair])
    turns = F.transform(i("history"), lambda t: t["role"])
    alternate = (F.get(turns, 0) == "user") & (F.element_at(turns, -1) == "assistant") & ~F.exists(F.zip_with(F.slice(turns, 1, F.size(turns) - 1), F.slice(turns, 2, F.size(turns) - 1), lambda a, b: a == b), lambda same: same)
    found = [
        _at("", i("_corrupt_record").isNotNull() | F.col("item").isNull(), "not an item"),
        _at("id", i("id").isNull() | ~i("id").rlike("^[SMFN][0-9]{2}$"), "of another form"),
        _at("id", i("id").isNotNull() & i("type").isin(*PREFIX) & ~i("id").startswith(F.element_at(prefix, i("type"))), "doesn't go with the type"),
        _at("type", i("type").isNull() | ~i("type").isin(*PREFIX), "unknown"),
        _at("question", i("question").isNull() | (F.length(i("question")) < 5), "too short"),
        _at("must_refuse", negative != F.coalesce(i("must_refuse"), F.lit(False)), "true for negative items only"),
        _at("expected_docs", negative & ~nothing, "a negative item expects nothing"),
        _at("expected_docs", i("type").isin("single_hop", "multi_hop", "follow_up") & ~all_there, "an answerable item expects documents, evidence and facts"),
        _at("history", follow & (_none(i("history")) | _none(i("expected_resolution"))), "a follow-up has history and resolution"),
        _at("history", ~follow & ~(_none(i("history")) & _none(i("expected_resolution"))), "of follow-ups only"),
        _at("history", ~_none(i("history")) & ~F.coalesce(alternate, F.lit(False)), "user and assistant take turns"),
        _at("expected_docs", (i("type") == "multi_hop") & (F.size(F.array_distinct(docs)) < 2), "two documents at least"),
        _at("expected_docs", F.size(F.array_distinct(docs)) < F.size(docs), "repeated"),
        _each("expected_evidence", i("expected_evidence"), lambda e: ~F.array_contains(docs, e["doc"]), "of a document that isn't expected"),
        _each("expected_evidence", i("expected_evidence"), lambda e: F.length(e["contains"]) < 3, "too short"),
        _each("expected_facts", i("expected_facts"), lambda f: (F.length(f["fact"]) < 1) | _none(f["any_of"]), "without a fact or a phrasing"),
        _each("tags", i("tags"), lambda t: ~t.isin(*TAGS), "unknown"),
        _at("review.status", i("review.status").isNull() | ~i("review.status").isin(*REVIEWS), "unknown"),
        _at("review.status", i("review.status") == "needs_review", "not reviewed"),
        _at("review", i("review.status").isin("approved", "revised", "rejected") & (F.coalesce(i("review.reviewed_by"), F.lit("")).eqNullSafe("") | F.coalesce(i("review.reviewed_on"), F.lit("")).eqNullSafe("")), "without reviewer or day"),
    ]
    # an item that couldn't be read has that problem only
    listed = F.when(F.size(found[0]) > 0, found[0]).otherwise(F.concat(*found[1:]))
    own = rows.select(*keep, i("id").alias("id"), F.explode(listed).alias("p")).select(*keep, "id", "p.path", "p.problem")
    asked = rows.select(*keep, i("id").alias("id"), F.posexplode(docs).alias("k", "filename"))
    unknown = asked.join(manifest.select("filename").distinct(), "filename", "left_anti").select(*keep, "id", F.concat(F.lit("expected_docs["), F.col("k").cast("string"), F.lit("]")).alias("path"), F.lit("not in the manifest").alias("problem"))
    twice = rows.where(i("id").isNotNull()).groupBy(i("id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
    repeated = rows.select(*keep, i("id").alias("id")).join(twice, "id", "left_semi").select(*keep, "id", F.lit("id").alias("path"), F.lit("repeated").alias("problem"))
    return own.union(unknown).union(repeated)
