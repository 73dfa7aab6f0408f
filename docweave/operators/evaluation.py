"""Scores of retrieval and answers: recall, ranks, coverage of facts, citations, refusals, and their means by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.matching import bounded
from docweave.operators import dictionary
from docweave.session import cut

# How an answer says that the sources hold nothing.
REFUSALS = (
    r"could not find (this|that|the|any)? ?information",
    r"(do|does) not (contain|include|provide|mention|specify|record|report)",
    r"no supporting evidence",
    r"not (mentioned|found|recorded|documented|specified|available|provided|included|stated|listed|given) (in|within|anywhere in) (the |any of the )?(provided |uploaded |retrieved |available |supplied )?(documents?|context|records?|sources?|excerpts?|material)",
    r"there (is|are|was|were) no (record|records|information|mention|data|details|evidence|documentation|entry)",
    r"no (record|records|information|mention|data|details|documentation|entry) (of|about|on|regarding|for|exists)",
    r"(cannot|can't|unable to|could not|couldn't) (find|locate|determine|answer|confirm|identify|provide)",
    r"(don't|do not|does not|doesn't) have (any )?(information|details|data|records?)",
    r"(isn't|is not|wasn't|was not|aren't|are not) (mentioned|recorded|documented|specified|available|provided|stated|listed)",
    r"insufficient (context|information|evidence)",
    r"no (such|matching) (record|incident|event|document|information)",
    r"\bno\b[^.]{0,60}\b(findings|results|readings|values|details|data|records?)\b[^.]{0,40}\b(were|was|are|is|have been|has been|had been) (recorded|found|documented|reported|made|given|available|provided|listed)",
    r"\b(documents?|context|records?|sources?|excerpts?|materials?|files?)\b[^.]{0,40}\b(contains?|includes?|provides?|mentions?|records?|reports?|lists?|shows?)\s+no\b[^.]{0,40}\b(findings|results|readings|values|details|data|records?|information|documentation|entry|entries)\b",
)


def distinct_in_order(ranked: DataFrame, key: str, item: str = "document", place: str = "rank") -> DataFrame:
    """key, item and place: each item once for each key, numbered anew by its first place."""
    first = ranked.groupBy(key, item).agg(F.min(place).alias("first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("first"))).drop("first")


def retrieval_scores(ranked: DataFrame, expected: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key, recall and reciprocal: the share of expected documents among the k first distinct ones, and one over the place of the first of them; null without expected documents. ranked: key, document, rank."""
    wanted = expected.select(key, "document").distinct()
    hits = distinct_in_order(ranked, key).join(wanted, [key, "document"])
    found = hits.groupBy(key).agg(F.count_if(F.col("place") <= k).alias("n"), F.min("place").alias("first"))
    total = wanted.groupBy(key).agg(F.count("*").alias("total"))
    keys = ranked.select(key).union(wanted.select(key)).distinct()
    out = keys.join(total, key, "left").join(found, key, "left")
    value = lambda x: F.when(F.col("total").isNotNull(), F.coalesce(x, F.lit(0.0)))
    return out.select(key, value(F.col("n") / F.col("total")).alias("recall"), value(1 / F.col("first")).alias("reciprocal"))


def plain(text: Column) -> Column:
    """A text as evidence is compared: lower case, white space as one space. Compatibility forms are folded for the characters that texts of this kind use."""
    return F.trim(F.regexp_replace(F.lower(folded(text)), r"[\s\x{A0}]+", " "))


# Compatibility characters and their plain forms.
FOLDED_FROM, FOLDED_TO = "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉ＡＢＣＤＥＦ０１２３４５６７８９", "2310456789" + "0123456789" + "ABCDEF" + "0123456789"


def folded(text: Column) -> Column:
    out = F.translate(text, FOLDED_FROM, FOLDED_TO)
    for raw, flat in (("ﬁ", "fi"), ("ﬂ", "fl"), ("…", "..."), ("℃", "°C"), ("Ω", "Ω")):
        out = F.replace(out, F.lit(raw), F.lit(flat))
    return out


#: What an answer may write in several ways, and the one way it is compared in.
SPELLINGS = ((r"[*`]", ""), ("[‐-―−]", "-"), (r"\bper\s*cent\b|\bpercent\b", "%"), (r"\b(?:degrees?|deg)\.?\s*(?:celsius|c)\b|°\s*c\b", "°c"), (r"m\^3", "m3"), (r"\s+", " "), ("([0-9]) +(%|°c|ω)", "$1$2"))


def normal(text: Column) -> Column:
    """A text as answers are compared: `plain`, and spellings of dashes, per cent, degrees and units as one."""
    out = F.lower(folded(text))
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, bounded(pattern), new)
    return F.trim(out)


def says(text: Column, phrase: Column) -> Column:
    """Whether a normal text has a phrase; a phrase that begins or ends in a digit isn't part of a longer number."""
    return says_normal(text, normal(phrase))


def says_normal(text: Column, p: Column) -> Column:
    before = F.when(p.rlike("^[0-9]"), r"(^|[^0-9.])").otherwise("")
    after = F.when(p.rlike("[0-9]$"), r"($|[^0-9.,]|[.,]($|[^0-9]))").otherwise("")
    return (p != "") & F.contains(text, p) & F.regexp_like(text, F.concat(before, F.lit(r"\Q"), p, F.lit(r"\E"), after))


def refuses(answer: Column) -> Column:
    return normal(answer).rlike(bounded("|".join(f"(?:{p})" for p in REFUSALS)))


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Share of the facts (arrays of phrasings) that the answer states; null without facts."""
    text = F.array(normal(answer))
    hits = F.transform(text, lambda t: F.size(F.filter(facts, lambda f: F.exists(f, lambda p: says(t, p)))))[0]
    return F.when(F.size(facts) > 0, hits / F.size(facts))


def outcome(refused: Column, must_refuse: Column, coverage: Column) -> Column:
    """What a refusal, or its absence, means."""
    wrong = refused & (F.coalesce(coverage, F.lit(0.0)) == 0)
    return F.when(must_refuse, F.when(refused, "correct_refusal").otherwise("missed_refusal")).when(wrong, "false_refusal").otherwise("answered")


def document_codes(filename: Column) -> Column:
    """What an answer may call a document: its leading code, or its stem with and without underscores."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    code = F.regexp_extract(stem, "^([A-Z]{2,4}-[0-9]{3})", 1)
    return F.when(code != "", F.array(code)).otherwise(F.array(stem, F.replace(stem, F.lit("_"), F.lit(" "))))


#: Runs of letters and runs of digits: what stands inside a name is such a run of the text too.
RUN = "[a-z]+|[0-9]+"


def _whole_runs(name: Column) -> Column:
    """Runs of a normal name that are whole runs of every text that says it: all but letters at its ends, which a word of the text may go on from."""
    runs = F.regexp_extract_all(name, F.lit(RUN), F.lit(0))
    low = F.when(name.rlike("^[a-z]"), 2).otherwise(1)
    high = F.size(runs) - F.when(name.rlike("[a-z]$"), 1).otherwise(0)
    return F.array_distinct(F.slice(runs, low, F.greatest(high - low + 1, F.lit(0))))


def cited(answers: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, filename) of the documents that an answer names. answers: key, answer; files: filename, a corpus of known documents.

    Answers and documents meet by the run of letters or digits that the fewest names hold, so that no answer is held against all files; names without a whole run by their rarest letters."""
    names = files.select("filename").distinct().select("filename", F.explode(document_codes(F.col("filename"))).alias("name"))
    names = cut(names.select("filename", normal(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("runs", _whole_runs(F.col("name"))))
    runs = names.select("filename", "name", F.explode("runs").alias("run"))
    common = runs.groupBy("run").agg(F.count("*").alias("n"))
    asked = cut(runs.join(common, "run").groupBy("filename", "name").agg(F.min_by("run", F.struct("n", -F.length("run"), "run")).alias("run")))
    said = answers.select(key, normal(F.col("answer")).alias("text"))
    spoken = said.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))))
    found = spoken.join(asked, "run").where(says_normal(F.col("text"), F.col("name"))).select(key, "filename")
    rest = names.where("size(runs) = 0").select("filename", "name")
    if not rest.isEmpty():
        texts = said.distinct()
        may = dictionary.named_in(rest.select(F.col("name").alias("id"), "name"), texts.select(F.struct(key, "text").alias("passage"), F.col("text").alias("content")))
        may = may.select(f"passage.{key}", "passage.text", F.col("id").alias("name")).join(rest, "name")
        found = found.union(may.where(says_normal(F.col("text"), F.col("name"))).select(key, "filename"))
    return found.distinct()


def citations(answers: DataFrame, files: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n_cited, precision and recall of the documents that an answer names. expected: key, filename."""
    one = lambda rows, found, wanted: rows.select(key, "filename", F.lit(found).alias("found"), F.lit(wanted).alias("wanted"))
    each = one(cited(answers, files, key), 1, 0).union(one(expected, 0, 1)).groupBy(key, "filename").agg(F.max("found").alias("found"), F.max("wanted").alias("wanted"))
    sums = each.groupBy(key).agg(F.sum("found").alias("n_cited"), F.sum("wanted").alias("n_wanted"), F.sum(F.col("found") * F.col("wanted")).alias("hits"))
    out = answers.select(key).join(sums.hint("merge"), key, "left").na.fill(0, ["n_cited", "n_wanted", "hits"])  # as many sums as answers: never broadcast
    known = F.col("n_wanted") > 0
    precision = F.when(known & (F.col("n_cited") > 0), F.col("hits") / F.col("n_cited"))
    return out.select(key, "n_cited", precision.alias("precision"), F.when(known, F.col("hits") / F.col("n_wanted")).alias("recall"))


def slices(rows: DataFrame, metrics: list[str], by: str, tags: str | None = None) -> DataFrame:
    """kind, slice, n and the mean of each metric, nulls left out: over all rows, by one column, and by each tag of a row."""
    one = [F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("slice")), F.struct(F.lit("type").alias("kind"), F.col(by).cast("string").alias("slice"))]
    keys = F.array(*one)
    if tags is not None:
        keys = F.concat(keys, F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("slice"))))
    spread = rows.select(F.explode(keys).alias("key"), *metrics)
    return spread.groupBy("key").agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics]).select("key.kind", "key.slice", "n", *metrics)


def deltas(runs: DataFrame, key: list[str], metric: str, baseline: str) -> DataFrame:
    """`runs` (config, key, metric) with how each differs from the baseline's run."""
    base = runs.where(F.col("config") == baseline).select(*key, F.col(metric).alias("base"))
    return runs.join(base, key, "left").withColumn("delta", F.round(F.col(metric) - F.col("base"), 9)).drop("base")
