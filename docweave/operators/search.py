"""Search: vector and keyword arms, rank fusion, weighted ranking, deduplication by document, context merge.

An arm is ranked by a top-k first, so that a rank window sees k rows, not the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.config import CONTEXT, SEARCH
from docweave.functions import text as tx
from docweave.functions import vectors as vx

DIGITS = 9


def top(df: DataFrame, k: int, offset: int = 0, score: str = "score", key: str = "id") -> DataFrame:
    """Rows offset+1 to offset+k by falling score, then key."""
    out = df.orderBy(F.col(score).desc_nulls_last(), F.col(key)).limit(k + offset)
    return out.offset(offset) if offset else out


def ranked(df: DataFrame, score: str = "score", key: str = "id", name: str = "rank") -> DataFrame:
    """1-based ranks of a bounded frame (a top-k)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(F.col(score).desc_nulls_last(), F.col(key))))


def semantic(points: DataFrame, query: Column, k: int, offset: int = 0) -> DataFrame:
    """The k points (id, vector, …) of highest cosine with the query vector, exactly."""
    return top(points.withColumn("score", F.round(vx.cosine(F.col("vector"), query), DIGITS)).drop("vector"), k, offset)


def keyword(chunks: DataFrame, terms: Column, k: int, offset: int = 0) -> DataFrame:
    """The k chunks (id, content, …) that hold the greatest share of the terms; those with none aren't hits."""
    scored = chunks.withColumn("score", F.round(tx.coverage(terms, F.col("content")), DIGITS)).where("score > 0")
    return top(scored, k, offset)


def top_of_each(df: DataFrame, key: str, k: int, score: str = "score", item: str = "id") -> DataFrame:
    """The k best rows of each key with their rank; Spark cuts each task's rows to k of a key before they are shuffled."""
    own = W.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), F.col(item))
    return df.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def keyword_batch(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank: for each of many questions (question, words) the k chunks (id, content) that hold the greatest share of its words. Chunks are taken to words once, and only those that some question asks for are kept."""
    asked = questions.select("question", F.explode(F.array_distinct("words")).alias("word"), F.size(F.array_distinct("words")).alias("n"))
    said = chunks.select("id", F.explode(F.array_distinct(tx.words_of(F.col("content")))).alias("word")).join(asked, "word")
    scored = said.groupBy("question", "id").agg(F.count("*").alias("hits"), F.max("n").alias("n")).select("question", "id", F.round(F.col("hits") / F.col("n"), DIGITS).alias("score"))
    return top_of_each(scored, "question", k)


def fused_batch(arms: list[DataFrame], k: int, constant: int = SEARCH.rrf_constant) -> DataFrame:
    """question, id, score, rank: reciprocal rank fusion of arms (question, id, score, rank), question by question; with one arm empty for it, the other's own scores stand."""
    hits = None
    for i, arm in enumerate(arms):
        one = arm.select("question", "id", "score", "rank", F.lit(i).alias("arm"))
        hits = one if hits is None else hits.union(one)
    arms_of = hits.groupBy("question").agg(F.count_distinct("arm").alias("arms"))
    summed = hits.join(arms_of, "question").groupBy("question", "id").agg(F.round(F.when(F.max("arms") > 1, F.sum(1.0 / (constant + F.col("rank")))).otherwise(F.max("score")), DIGITS).alias("score"))
    return top_of_each(summed, "question", k)


def fused(arms: list[DataFrame], k: int, constant: int = SEARCH.rrf_constant) -> DataFrame:
    """Reciprocal rank fusion of arms (id, score). With one arm empty, the other's own scores stand."""
    marked = [ranked(a.select("id", "score")).select("id", "score", "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    hits = marked[0]
    for m in marked[1:]:
        hits = hits.unionByName(m)
    everywhere = W.partitionBy()
    counted = hits.withColumn("arms", F.size(F.collect_set("arm").over(everywhere)))
    summed = counted.groupBy("id").agg(
        F.round(F.when(F.max("arms") > 1, F.sum(1.0 / (constant + F.col("rank")))).otherwise(F.max("score")), DIGITS).alias("score"),
        F.count("*").cast("int").alias("n_arms"),
    )
    return top(summed, k)


def hybrid(points: DataFrame, query: Column, chunks: DataFrame, terms: Column, k: int) -> DataFrame:
    wide = SEARCH.arm_factor * k
    return fused([semantic(points, query, wide), keyword(chunks, terms, wide)], k)


def weighted(candidates: DataFrame, now: Column, k: int, weights: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Ranked search over candidates (id, semantic, keyword, metadata, uploaded): weights are made to sum to one."""
    given = weights or (SEARCH.semantic, SEARCH.keyword, SEARCH.metadata, SEARCH.freshness)
    parts = (F.coalesce("semantic", F.lit(0.0)), F.coalesce("keyword", F.lit(0.0)), F.coalesce("metadata", F.lit(0.0)), vx.freshness(F.col("uploaded"), now, SEARCH.freshness_days))
    total = sum(given)
    score = sum((p * F.lit(w / total) for p, w in zip(parts[1:], given[1:], strict=True)), parts[0] * F.lit(given[0] / total))
    return top(candidates.withColumn("score", F.round(score, DIGITS)), k)


def union_arms(vector: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of both arms, once each: semantic and keyword scores, null where an arm lacks the id."""
    return vector.select("id", F.col("score").alias("semantic")).join(words.select("id", F.col("score").alias("keyword")), "id", "full")


def by_document(hits: DataFrame, per_document: int, documents: int) -> DataFrame:
    """At most `per_document` passages of each document and `documents` documents, those of the best passages; hits: id, document, score."""
    own = W.partitionBy("document").orderBy(F.col("score").desc(), F.col("id"))
    kept = hits.withColumn("passage", F.row_number().over(own)).where(F.col("passage") <= per_document)
    best = kept.where("passage = 1").select("document", F.col("score").alias("best"), F.col("id").alias("best_id"))
    chosen = best.orderBy(F.col("best").desc(), "best_id").limit(documents).select("document", "best")
    return kept.join(chosen, "document").select("id", "document", "score", "passage")


# Words of questions that ask for several sections of a document.
OVERVIEW_WORDS = ("resume", "cv", "education", "experience", "project", "projects", "qualifications", "background", "summarise", "summarize", "overview")


def passage_budget(query: Column, configured: int = SEARCH.passages) -> Column:
    """Passages of one document: more for questions about its whole."""
    overview = F.arrays_overlap(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), tx.strings(list(OVERVIEW_WORDS)))
    return F.when(overview, F.greatest(F.lit(SEARCH.overview_passages), F.lit(configured))).otherwise(F.lit(max(configured, 1)))


def candidates_of(k: int) -> int:
    return min(max(SEARCH.candidates_factor * k, k), SEARCH.candidates_most)


def reranked(hits: DataFrame, logit: Column, k: int) -> DataFrame:
    """Hits by the sigmoid of another scorer's logit."""
    return top(hits.withColumn("score", F.round(vx.sigmoid(logit), DIGITS)), k)


def with_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Each hit (id, document, score) with the number of facts (document, …) of its document, in any case, and the capped boost they give."""
    counted = facts.groupBy(F.lower("document").alias("__doc")).agg(F.count("*").alias("n_facts"))
    joined = hits.join(counted, F.lower("document") == F.col("__doc"), "left").drop("__doc")
    boost = F.least(F.coalesce("n_facts", F.lit(0)) * F.lit(CONTEXT.boost_each), F.lit(CONTEXT.boost_most))
    return joined.withColumn("n_facts", F.coalesce("n_facts", F.lit(0))).withColumn("score", F.round(F.least(F.col("score") + boost, F.lit(1.0)), DIGITS))


def graph_only(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """An item for each document with facts that no hit covers; its score comes from the surest fact."""
    rest = facts.join(hits.select(F.lower("document").alias("__doc")).distinct(), F.lower("document") == F.col("__doc"), "left_anti")
    surest = F.coalesce(F.max("confidence"), F.lit(CONTEXT.graph_default))
    score = F.least(F.greatest(F.lit(CONTEXT.graph_least), surest * CONTEXT.graph_factor), F.lit(1.0))
    return rest.groupBy("document").agg(F.round(score, DIGITS).alias("score"), F.count("*").alias("n_facts"))


def without_repeats(hits: DataFrame, overlap: float = CONTEXT.duplicate_overlap) -> DataFrame:
    """Hits (id, document, page, content, score; a bounded top-k) without those whose words overlap by `overlap` (Jaccard) or more with a better one that is kept, of the same document and page.

    Words are runs without white space, in lower case; a hit without words repeats none."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("content", F.lit(""))), r"[\s\x1c-\x1f\x85\p{Z}]+")), lambda w: w != "")
    one = F.struct((-F.col("score")).alias("back"), "id", "score", words.alias("words"))
    placed = hits.groupBy("document", "page").agg(F.array_sort(F.collect_list(one)).alias("hits"))

    def near(a: Column, b: Column) -> Column:
        return (F.size(b["words"]) > 0) & (F.size(F.array_intersect(a["words"], b["words"])) / F.size(F.array_union(a["words"], b["words"])) >= overlap)

    kept = F.aggregate("hits", F.filter("hits", lambda h: F.lit(False)), lambda acc, h: F.when(F.exists(acc, lambda a: near(a, h)), acc).otherwise(F.concat(acc, F.array(h))))
    return placed.select("document", "page", F.explode(kept).alias("hit")).select("hit.id", "document", "page", "hit.score")


def context(hits: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """The merged context: hits that repeat no better one, boosted, and graph-only items, the k best; hits: id, document, page, content, score.

    Facts come by document, so the hit that is kept has those of its repeats already."""
    own = with_facts(without_repeats(hits), facts).select(F.col("id").cast("string").alias("id"), "document", "score", "n_facts", F.lit("vector").alias("origin"))
    other = graph_only(facts, hits).select(F.concat(F.lit("graph:"), "document").alias("id"), "document", "score", "n_facts", F.lit("graph").alias("origin"))
    return top(own.unionByName(other), k)


def near_passages(chunks: DataFrame, overlap: float = CONTEXT.duplicate_overlap) -> DataFrame:
    """Pairs of passages of one document and page whose word sets overlap by `overlap` (Jaccard) or more; chunks: id, document, page, content.

    Passages meet through the words they share, counted before they are compared, not as all pairs."""
    words = chunks.select("id", "document", "page", F.explode(F.array_distinct(tx.words_of(F.col("content")))).alias("word"))
    sizes = words.groupBy("id").agg(F.count("*").alias("n"))
    a, b = words.alias("a"), words.alias("b")
    same = (F.col("a.document") == F.col("b.document")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id"))
    shared = a.join(b, same).groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count("*").alias("both"))
    sized = shared.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
    jaccard = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return sized.withColumn("jaccard", F.round(jaccard, 6)).where(F.col("jaccard") >= overlap).select("a", "b", "jaccard")
