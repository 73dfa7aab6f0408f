"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Null and empty texts, having no words, are rejected by the first stage; very long ones go through whole. Rows with
a null doc_id are near copies of nothing and stay; in the fourth stage those of one source and size share their number of
copies. Of repeated rows of one doc_id one stays whole: that of the least text, null last, and of equal texts
that of the least other columns as JSON. Ties end as each operator says.
Columns beside those of documents are carried through the first four stages untouched, whatever their names: while an
operator works they are packed away. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, mixing, nearcopies, rules, secrets
from docweave.session import scratch, table

#: Holds all columns that an operator doesn't read, so that its own columns clash with none.
_CARRIED = "__docweave_carried"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias(_CARRIED), *rest).alias(_CARRIED))


def unpacked(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of `docs` from packed rows, some of them anew."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(_CARRIED)[c]
    return rows.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    return unpacked(rules.judge(packed(docs), table(spark, sf_dir, "labels")).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the least doc_id."""
    dropped = nearcopies.near_copies(docs).where("not kept").select("doc_id")
    left = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return left
    rows = packed(left.join(repeated, "doc_id", "left_semi").select(docs.columns)).withColumn("__row", F.struct(F.col("text").isNull(), "text", F.to_json(_CARRIED)))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", _CARRIED), "__row").alias("__one")).select("doc_id", "__one.*")
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).union(unpacked(one, docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked, and n_chars of what is left."""
    found = secrets.scan(packed(docs))
    some = F.size("spans") > 0
    masked = F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", masked)
    n_chars = F.when(some, F.length("text").cast("long")).otherwise(F.col(_CARRIED)["n_chars"]) if "n_chars" in docs.columns else F.lit(0)
    return unpacked(found, docs, n_chars=n_chars)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the schedule takes of its words; a source's last document, taken in part, counts from one half on."""
    mixed, _ = mixing.mix(docs.select("doc_id", "source", "text"))
    share = F.round(F.sum("taken") / F.sum("size")).cast("int")
    keys = ("doc_id", "source", "size")
    copies = mixed.where("size > 0").groupBy(*keys).agg(share.alias("__copies")).where("__copies > 0").select("__copies", *[F.col(k).alias(f"__key_{k}") for k in keys])
    own = packed(docs).withColumn("__size", mixing.n_words(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__key_doc_id")) & F.col(_CARRIED)["source"].eqNullSafe(F.col("__key_source")) & (F.col("__size") == F.col("__key_size"))
    return unpacked(own.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))), docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, with digests of the ids and of the bytes they decode to."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    return done.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", bpe_tokens),
]

#: The isolation forest's random splits can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
