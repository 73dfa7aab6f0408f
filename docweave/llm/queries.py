"""Registered queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, extraction, middles, mixing, nearcopies, neighbours, periods, pieces, pii, rules, scoring, secrets, sql, telephony
from docweave.session import table


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")
    return telephony.store_and_read(docs, outputs=digests).drop("text")


def op2_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    done = neighbours.vote(docs, labels, learn=~held_out())
    return done.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


def op5_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, table(spark, sf_dir, "labels")).drop("text")


def op6_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op7_slot_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    return scoring.score(docs, learn=~F.col("held_out"))


def op9_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["rank"] < len(pii.PATTERNS))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return done.drop("text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    return periods.find_runs(docs, outputs=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")).drop("text")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return middles.fill_in_middle(docs, outputs=("n", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


def op13_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def columns_of(query, *names: str):
    """A query's columns that SQL can express, so that they can be compared with it."""
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


def unigram_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_gru_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_neighbour_votes": op2_neighbour_votes,
    "op3_entropy_secrets": op3_entropy_secrets,
    "op4_setsketch": op4_setsketch,
    "op5_isolation_rules": op5_isolation_rules,
    "op6_text_density": op6_text_density,
    "op7_slot_mixing": op7_slot_mixing,
    "op8_gru_scores": op8_gru_scores,
    "op9_crf_pii": op9_crf_pii,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merge_pieces": op13_merge_pieces,
    "columns1_payloads": columns_of(op1_telephony, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"),
    "columns5_rules": columns_of(op5_isolation_rules, "doc_id", *rules.BASE, "base_failed"),
    "columns8_unigrams": unigram_columns,
    "columns9_patterns": columns_of(op9_crf_pii, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"),
}

ORACLES: dict[str, str] = {
    "op3_entropy_secrets": sql.SECRETS,
    "op4_setsketch": sql.NEAR_COPIES,
    "op7_slot_mixing": sql.MIXING,
    "op12_fill_in_middle": sql.MIDDLES,
    "columns1_payloads": sql.PAYLOADS,
    "columns5_rules": sql.RULES,
    "columns8_unigrams": sql.UNIGRAMS,
    "columns9_patterns": sql.PERSONAL,
}
