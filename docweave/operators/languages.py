"""The language of a text, from how often groups of three letters stand in it.

Profiles are fitted on a bounded sample of texts whose language is known: up to SAMPLE texts of a language, of LANGUAGES
languages at most, those of the least MD5 of their ids. The GRAMS most frequent groups make a table of fixed size, which
is broadcast; each holds the logarithm of its share in each language, with one added to every count. A text's score in a
language is the sum over all its groups that the table has; confidences are the scores' shares after exponentiation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts of a language that a profile is fitted on, languages, and groups of letters that are kept.
SAMPLE, LANGUAGES, GRAMS = 200, 64, 2000
#: Shorter texts, trimmed, have no language that can be told; the code they get.
LEAST_LENGTH, UNKNOWN = 20, "unknown"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def grams(text: Column) -> Column:
    """Groups of three letters of each word in lower case, an underscore standing before and after the word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("_"), w, F.lit("_")), i, F.lit(3)))
    return F.flatten(F.transform(words, of_word))


def profiles(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> tuple[DataFrame, list[str]]:
    """(gram, weights) and the languages that the weights are of, in order. Rows without a language or a text teach nothing."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    frequent = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    languages = sorted(r.lang for r in frequent.collect())
    if not languages:
        return known.select(F.col("text").alias("gram"), F.array().cast("array<double>").alias("weights")), languages
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.md5(F.col("key").cast("string")), "key"))
    chosen = known.select("key", "lang").where(F.col("lang").isin(languages)).withColumn("place", place).where(F.col("place") <= SAMPLE).select("key", "lang")
    sample = known.join(F.broadcast(chosen), ["key", "lang"])  # LANGUAGES * SAMPLE rows at most
    counts = sample.select("lang", F.explode(grams(F.col("text"))).alias("gram")).groupBy("gram", "lang").agg(F.count("*").alias("n"))
    wide = counts.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, name in enumerate(languages)])
    some = [F.col(f"n{i}") for i in range(len(languages))]
    top = wide.orderBy(F.desc(reduce(lambda a, b: a + b, some)), "gram").limit(GRAMS)
    sums = top.agg(*[F.sum(n).alias(f"sum{i}") for i, n in enumerate(some)])
    weights = F.array(*[F.ln((n + 1) / (F.col(f"sum{i}") + GRAMS)) for i, n in enumerate(some)])
    return top.crossJoin(sums).select("gram", weights.alias("weights")), languages  # with one row


def detected(docs: DataFrame, profile: DataFrame, languages: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, code, confidence (4 digits) of each key; texts of a repeated key count together. Null, short and wordless texts are unknown, without a confidence; of equal scores the first language is taken."""
    long = F.length(trimmed(F.col(text))) >= LEAST_LENGTH
    said = docs.select(key, F.explode_outer(F.when(long, grams(F.col(text)))).alias("gram"))
    sums = [F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(languages))]
    if not sums:
        return docs.select(key).distinct().select(key, F.lit(UNKNOWN).alias("code"), F.lit(None).cast("double").alias("confidence"))
    scores = said.join(F.broadcast(profile), "gram", "left").groupBy(key).agg(*sums)  # GRAMS rows at most
    listed = F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("lang")) for i, name in enumerate(languages)])
    best = F.array_max(listed)
    share = 1 / reduce(lambda a, b: a + b, [F.exp(F.col(f"s{i}") - best["score"]) for i in range(len(languages))])
    return scores.select(key, F.when(best["score"].isNotNull(), best["lang"]).otherwise(UNKNOWN).alias("code"), F.round(share, 4).alias("confidence"))
