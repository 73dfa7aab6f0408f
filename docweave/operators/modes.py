"""Search in four modes for many questions at once, with the entities a question names, and retrieval with a fallback.

Each question says how it is to be answered; the arms are computed once for all questions, and each takes what its mode
asks of them. All is one plan over (question, ...) rows: no question is planned by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.operators import search
from docweave.operators.dictionary import named_in

#: Weights of the parts of a ranked search; entities of a question that hits are looked through for.
WEIGHTS = {"semantic": 0.35, "keyword": 0.30, "metadata": 0.20, "freshness": 0.15}
ENTITIES = 5
MODES = ("semantic", "keyword", "hybrid", "ranked")


def _numbered(rows: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank of the k best hits of each question."""
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("question", "id", "score", "rank")


def by_mode(questions: DataFrame, semantic: DataFrame, keyword: DataFrame, fields: DataFrame, k: int) -> DataFrame:
    """question, mode, id, score, rank: hits of each question (question, mode) in its mode.

    semantic, keyword: arms (question, id, score, rank) of 2k hits a question; fields: id, metadata, freshness of the
    texts. A question of an unknown or null mode is answered as a hybrid one.
    """
    mode = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("hybrid")
    asked = questions.select("question", mode.alias("mode"))
    of = lambda name, arm: arm.join(asked.where(F.col("mode") == name), "question", "left_semi")
    fused = search.fused_batch([of("hybrid", semantic), of("hybrid", keyword)], k).select("question", "id", "score", "rank")
    a = of("ranked", semantic).select("question", "id", F.col("score").alias("semantic"))
    b = of("ranked", keyword).select("question", "id", F.col("score").alias("keyword"))
    parts = a.join(b, ["question", "id"], "full").join(fields, "id", "left")
    score = sum((F.coalesce(part, F.lit(0.0)) * w for part, w in WEIGHTS.items()), F.lit(0.0))
    ranked = _numbered(parts.select("question", "id", F.round(score, search.DIGITS).alias("score")), k)
    found = _numbered(of("semantic", semantic), k).unionByName(_numbered(of("keyword", keyword), k)).unionByName(fused).unionByName(ranked)
    return found.join(asked, "question").select("question", "mode", "id", "score", "rank")


def asked_entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """question, name, type, place: up to ENTITIES entities (name, type) that a question (question, text, words) names: those whose name it is, then those that hold most of its words, then by name."""
    words = questions.select("question", F.explode(F.array_distinct("words")).alias("word"))
    terms = words.select("word").distinct().select(F.col("word").alias("id"), F.col("word").alias("name"))
    names = nodes.select("name", "type").distinct()
    held = named_in(terms, names.select(F.struct("name", "type").alias("passage"), F.col("name").alias("content")))
    hits = words.join(held, F.col("word") == F.col("id")).groupBy("question", "passage").agg(F.count("*").alias("n"))
    exact = questions.join(names.withColumn("low", F.lower("name")), F.lower(F.trim("text")) == F.col("low")).select("question", F.struct("name", "type").alias("passage"), F.lit(1).alias("exact"))
    both = hits.join(exact, ["question", "passage"], "full").select("question", "passage.*", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("n", F.lit(0)).alias("n"))
    place = F.row_number().over(W.partitionBy("question").orderBy(F.desc("exact"), F.desc("n"), "name", "type"))
    return both.withColumn("place", place).where(F.col("place") <= ENTITIES).select("question", "name", "type", "place")


def with_entities(hits: DataFrame, entities: DataFrame, texts: DataFrame) -> DataFrame:
    """`hits` with entities: names, in order, of the question's entities that stand in the hit's text (id, content). A hit has ENTITIES of them at most."""
    pairs = hits.select("question", "id").join(entities, "question").join(texts, "id").where(F.contains(F.lower("content"), F.lower("name")))
    listed = pairs.groupBy("question", "id").agg(F.sort_array(F.collect_list("name")).alias("entities"))  # ENTITIES at most
    return hits.join(listed, ["question", "id"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def with_fallback(questions: DataFrame, hybrid: DataFrame, semantic: DataFrame, facts: DataFrame, k: int, threshold: float) -> DataFrame:
    """question, source, id, score, rank, n_facts: what a graph-aware answer is made of.

    A question for which the graph gave facts (question, n_facts) takes its hybrid hits; any other takes its semantic hits
    of at least `threshold`. A question without hits has one row, of the source "insufficient".
    """
    asked = questions.select("question").join(facts.where("n_facts > 0"), "question", "left").withColumn("source", F.when(F.col("n_facts").isNotNull(), "hybrid").otherwise("semantic_fallback"))
    one = hybrid.where(F.col("rank") <= k).select("question", "id", "score", "rank").withColumn("source", F.lit("hybrid"))
    two = semantic.where((F.col("rank") <= k) & (F.col("score") >= threshold)).select("question", "id", "score", "rank").withColumn("source", F.lit("semantic_fallback"))
    rows = asked.join(one.unionByName(two), ["question", "source"], "left")
    return rows.select("question", F.when(F.col("id").isNull(), "insufficient").otherwise(F.col("source")).alias("source"), "id", "score", "rank", F.coalesce("n_facts", F.lit(0)).alias("n_facts"))
