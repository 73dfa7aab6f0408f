"""Which of many names stand in which of many passages.

A name stands in a passage if its letters do, in any case and also inside a word. Each name is looked up by one group of
GRAM letters of its own, the one that the fewest passages hold (a shorter name by the whole of it); passages meet names
over equal groups, and each meeting is confirmed on the whole name. Pairs thus grow with what is found, and neither all
names nor all passages come together in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import cut

#: Letters of a group, and characters of the windows that a long passage is cut into first.
GRAM, WINDOW = 4, 512


def _grams(text: Column, size: Column) -> Column:
    """Distinct groups of so many characters."""
    n = F.length(text) - size + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def _grams_of(text: Column, n: int) -> Column:
    """All groups of one size, repeated ones too: found by one pattern, since a substring is looked for from the text's beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _windows(text: Column) -> Column:
    """Pieces of a text that overlap so that each group of GRAM characters is whole in one of them."""
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / WINDOW).cast("int"))
    return F.transform(starts, lambda k: F.substring(text, k * WINDOW + 1, F.lit(WINDOW + GRAM - 1)))


def named_in(names: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, passage) of every name (id, name) in every passage (passage, content) that holds it. passage: any column that can be joined on, a struct too. Null and empty names and contents are found nowhere; an id of several names is found once."""
    name = names.select("id", F.lower("name").alias("name")).where("name <> ''").distinct()
    size = F.least(F.length("name"), F.lit(GRAM))
    keys = cut(name.select("id", "name", size.alias("size"), F.explode(_grams(F.col("name"), size)).alias("gram")))  # read four times below
    asked = keys.select("gram").distinct()
    sizes = sorted(r.size for r in keys.select("size").distinct().collect())  # GRAM values at most
    if not sizes:
        return names.select("id").join(passages.select("passage"), F.lit(False))
    low = passages.select("passage", F.lower("content").alias("content")).where("content <> ''")
    pieces = low.select("passage", F.explode(_windows(F.col("content"))).alias("piece"))
    all_sizes = F.concat(*[_grams_of(F.col("piece"), n) for n in sizes])
    held = cut(pieces.select("passage", F.explode(all_sizes).alias("gram")).join(asked, "gram", "left_semi").distinct())
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(counts, "gram").groupBy("id", "name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("found"), F.max(F.size(_grams(F.col("name"), F.col("size")))).alias("all"))
    rarest = rarest.where(F.col("found") == F.col("all")).select("id", "name", "gram")  # a group that no passage holds rules the name out
    meetings = rarest.join(held, "gram").select("id", "name", "passage")
    return meetings.join(low, "passage").where(F.contains("content", "name")).select("id", "passage").distinct()


def owners(pairs: DataFrame, names: DataFrame, passages: DataFrame) -> DataFrame:
    """id, document, owner of pairs (id, document): the first of the document's passages (document, chunk_index, content) that holds the name (id, name), else the first of all; null where the document has none."""
    first = passages.groupBy("document").agg(F.min("chunk_index").alias("first"))
    wanted = names.join(pairs.select("id").distinct(), "id", "left_semi")
    found = named_in(wanted, passages.select(F.struct("document", "chunk_index").alias("passage"), "content"))
    named = found.groupBy("id", F.col("passage.document").alias("document")).agg(F.min("passage.chunk_index").alias("named"))
    return pairs.join(first, "document", "left").join(named, ["id", "document"], "left").select("id", "document", F.coalesce("named", "first").alias("owner"))
