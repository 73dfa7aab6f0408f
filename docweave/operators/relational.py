"""Filters, projections, sorts and pages of the application's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.session import cut

#: Ranges of values of each key in which places are counted apart.
CHUNKS = 256


def documents_where(docs: DataFrame, search: str | None = None, status: str | None = None, language: str | None = None, uploaded_by: str | None = None) -> DataFrame:
    """Documents that aren't deleted, by optional conditions; `search` is found in the name or the text, in any case."""
    out = docs.where(~F.col("deleted"))
    if search is not None:
        out = out.where(F.col("filename").ilike(f"%{search}%") | F.col("text").ilike(f"%{search}%"))
    for column, value in (("status", status), ("lang", language), ("uploaded_by", uploaded_by)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in a total order."""
    out = df.orderBy(*order).limit(number * size)
    return out.offset((number - 1) * size) if number > 1 else out


def page_facts(total: Column, number: int, size: int) -> list[Column]:
    """total, total_pages, has_next, has_previous."""
    pages = F.ceil(total / size).cast("long")
    return [total.alias("total"), F.greatest(pages, F.lit(1)).alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous")]


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def one_document(parts: list[Column]) -> Column:
    """Whether the non-empty values among the parts name one document at most."""
    return F.size(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))) <= 1


def next_attempt(retries: Column, most: int = 3) -> Column:
    """Seconds until the next attempt; null after the last."""
    return F.when(retries < most, F.least(F.lit(300.0), F.pow(F.lit(2.0), retries)))


def page_of_offset(pages: DataFrame, offsets: DataFrame, gap: int = 2) -> DataFrame:
    """The page each offset lies in; pages (document, page, text) are joined by `gap` characters, and what lies beyond belongs to the last."""
    own = W.partitionBy("document").orderBy("page")
    ends = pages.withColumn("end", F.sum(F.length("text") + gap).over(own)).withColumn("start", F.col("end") - F.length("text") - gap)
    last = W.partitionBy("document").orderBy(F.col("page").desc())
    ends = ends.withColumn("end", F.when(F.row_number().over(last) == 1, F.lit(2**62)).otherwise(F.col("end")))
    hit = (offsets["document"] == ends["document"]) & (offsets["offset"] >= ends["start"]) & (offsets["offset"] < ends["end"])
    return offsets.join(ends, hit).select(offsets["document"], offsets["offset"], "page")


def values_at(df: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each key (of few kinds), the values at 0-based places of its values in order, nulls first; a place is given the number of the key's rows.

    Equal values are counted first, and counts run within ranges of values and over the ranges' sums, so that no task holds a key's values."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("__n"))
    bounds = counts.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(value, [i / CHUNKS for i in range(1, CHUNKS)]).alias("__bounds"))
    chunk = F.size(F.filter(F.coalesce("__bounds", F.array()), lambda b: b < F.col(value)))
    rows = cut(counts.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("__key"))).select(F.col(key), F.col(value), "__n", chunk.alias("__chunk")))
    sums = rows.groupBy(F.col(key).alias("__key"), F.col("__chunk").alias("__range")).agg(F.sum("__n").alias("__sum"))
    own = W.partitionBy("__key")
    before = sums.select("__key", "__range", F.sum("__sum").over(own).alias("__total"), (F.sum("__sum").over(own.orderBy("__range")) - F.col("__sum")).alias("__before"))
    run = F.sum("__n").over(W.partitionBy(key, "__chunk").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ended = rows.withColumn("__run", run).join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__chunk") == F.col("__range")))
    end = F.col("__before") + F.col("__run")
    at = lambda place: (place >= end - F.col("__n")) & (place < end)
    return ended.groupBy(key).agg(*[F.max(F.when(at(place(F.col("__total"))), F.col(value))).alias(name) for name, place in places.items()])


def percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each key, exact percentiles of its values that aren't null, between the two values around a share's place."""
    places = {}
    for name, p in shares.items():
        places |= {f"__low_{name}": lambda n, p=p: F.floor((n - 1) * p), f"__high_{name}": lambda n, p=p: F.ceil((n - 1) * p)}
    known = df.where(F.col(value).isNotNull())
    number = known.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows"))
    got = values_at(known, key, value, places).join(F.broadcast(number), F.col(key).eqNullSafe(F.col("__key")))

    def between(name: str, p: float) -> Column:
        place, low, high = (F.col("__rows") - 1) * p, F.col(f"__low_{name}").cast("double"), F.col(f"__high_{name}").cast("double")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return got.select(key, *[between(name, p).alias(name) for name, p in shares.items()])


def with_columns_of(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left's rows with the other columns of right's row of the same key, null keys included; right has few rows."""
    return left.join(F.broadcast(right.withColumnRenamed(key, "__other")), F.col(key).eqNullSafe(F.col("__other")), "left").drop("__other")


def not_in(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the others', as SQL's NOT IN has it: none if the others hold a null, and none of a null key unless the others are empty."""
    facts = others.agg(F.coalesce(F.max(F.col(key).isNull()), F.lit(False)).alias("__null"), F.count("*").alias("__n"))
    marked = rows.join(F.broadcast(facts)).where("__n = 0 or (not __null and " + key + " is not null)")  # with one row
    return marked.drop("__null", "__n").join(others.select(key), key, "left_anti")
