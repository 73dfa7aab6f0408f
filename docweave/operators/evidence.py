"""Whether what an answer says rests on its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import Evidence
from docweave.functions import text as tx
from docweave.operators import dictionary

FALLBACK = "The sources do not answer this."
#: Words of the head by which a passage is looked up.
HEAD = 6


def classified(answers: DataFrame, sources: DataFrame, key: str, limits: Evidence) -> DataFrame:
    """answer, n, sentence, verdict and sources of each statement.

    A statement meets the sources of its own key only, each source with the tokens of all its passages.
    FACT: enough of its tokens are in one source; HYPOTHESIS: it hedges; UNKNOWN: the rest.
    """
    said = answers.select("answer", key, F.posexplode(tx.sentences(F.col("answer_text"))).alias("n", "sentence")).withColumn("tokens", tx.content_tokens(F.col("sentence")))
    known = sources.select(key, "source", tx.content_tokens(F.col("source_text")).alias("held")).groupBy(key, "source").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    pairs = said.join(known.hint("merge"), key, "left").withColumns({"overlap": F.size(F.array_intersect("tokens", "held")), "size": F.size("tokens")})  # sources are as many as answers: never broadcast
    good = (F.col("overlap") >= limits.overlap) & (F.col("overlap") / F.col("size") >= limits.coverage) & (F.col("size") >= limits.least_tokens)
    one = F.when(good, F.struct((-F.col("overlap") / F.col("size")).alias("less"), "source"))
    out = pairs.select("answer", key, "n", "sentence", one.alias("one")).groupBy("answer", key, "n", "sentence").agg(F.array_sort(F.collect_list("one")).alias("found"))  # of one conversation
    verdict = F.when(tx.hedged(F.col("sentence")), "HYPOTHESIS").when(F.size("found") > 0, "FACT").otherwise("UNKNOWN")
    refs = F.when(verdict == "FACT", F.transform(F.slice("found", 1, limits.references), lambda s: s["source"])).otherwise(F.array().cast("array<string>"))
    return out.select("answer", "n", "sentence", verdict.alias("verdict"), refs.alias("sources"))


def guarded(statements: DataFrame) -> DataFrame:
    """Answers of their supported statements alone; a fallback where there are none."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") != "UNKNOWN", F.struct("n", "sentence")))), lambda s: s["sentence"])
    out = statements.groupBy("answer").agg(kept.alias("kept"), F.count_if(F.col("verdict") == "UNKNOWN").alias("dropped"))
    return out.select("answer", F.when(F.size("kept") > 0, F.array_join("kept", " ")).otherwise(FALLBACK).alias("text"), "dropped")


#: Most passages of which the keys are broadcast.
KEYS = 200_000


def contained(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, n_documents: in how many documents each passage occurs word for word.

    The first and last word of a passage may be parts of a document's words; those between are whole. Documents are
    looked up by their windows of HEAD words, or of as many whole words as a short passage has, so that no passage
    meets a document it can't be in. Keys of a moderate number of passages are broadcast. Passages without a whole word
    are looked up by their rarest letters; an empty passage is in every text.
    """
    words = lambda c: F.split(c, r"\s+")
    named = passages.select("item_id", F.col("text").alias("passage"), words(F.trim("text")).alias("w"))
    named = named.withColumn("m", F.greatest(F.least(F.size("w") - 2, F.lit(HEAD)), F.lit(0)))
    sizes = {r.m: r.n for r in named.groupBy("m").agg(F.count("*").alias("n")).collect()}  # HEAD + 1 rows at most
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = None
    for m, n in sorted(sizes.items()):
        own = named.where(F.col("m") == m)
        if m == 0:
            may = dictionary.named_in(own.select(F.col("item_id").alias("id"), F.col("passage").alias("name")), docs.select(F.col("doc_id").alias("passage"), F.col("text").alias("content")))
            may = may.select(F.col("id").alias("item_id"), F.col("passage").alias("doc_id"))
            hits = may.join(own.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
        else:
            asked = own.select("item_id", F.xxhash64(F.array_join(F.slice("w", 2, m), " ")).alias("key"))
            keys = split.where(F.size("w") >= m).select("doc_id", F.explode(F.array_distinct(_windows(m))).alias("key"))
            pairs = keys.join(F.broadcast(asked) if n <= KEYS else asked, "key").select("item_id", "doc_id").distinct()
            hits = pairs.join(own.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
        found = hits if found is None else found.union(hits)
    if found is None:
        return passages.select("item_id", F.lit(0).cast("long").alias("n_documents"))
    everywhere = passages.where("text = ''").select("item_id").crossJoin(docs.where("text is not null").agg(F.count("*").alias("n_documents")))  # with one row
    number = found.groupBy("item_id").agg(F.count("*").alias("n_documents")).union(everywhere)
    return passages.select("item_id").join(number, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))


def _windows(m: int) -> Column:
    """Hashes of the windows of m words of w."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - (m - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, m), " ")))
