"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots. Slot t gets the van der Corput point of t (its binary digits behind the point, the
other way round), and that point picks a source from the cumulative shares; so every stretch of slots holds the
sources in about their shares. The slots of a source are ranked. The source's documents, shuffled by a hash and
repeated as often as needed, make a stream of words, of which the target's worth is cut into as many equal
blocks as the source has slots; block r fills slot r. A source too small for any slot gets one at the end.

Running positions are sums over chunks of the hash or of the slots and then sums inside a chunk, so no source,
however large, is gathered or sorted in one task. Sums are whole numbers: reruns agree.

Null texts have no words. A null source is a source of its own, the last one. Documents without words are in no
block; a null doc_id is shuffled like an empty one. Repeated rows are documents of their own. An empty table
gives empty results. Only doc_id, source and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.session import cut

#: Weights of the sources in order, repeating; most copies of a document; words of a slot, about.
WEIGHTS, COPIES, SLOT = (5, 2, 1), 3, 512
#: Chunks of a source's stream (hexadecimal digits of the hash), chunks of the slots, cells of the cumulative shares.
DIGITS, CHUNKS, CELLS = 3, 4096, 1024


def n_words(text: Column) -> Column:
    """Words of a text, 0 of a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """row, doc_id, source, size: a number for each row, and its words."""
    return docs.select("doc_id", "source", n_words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> DataFrame:
    """sid, source, source_size, weight, target of each source.

    Targets share the sum of all sizes by weight; those above `copies` times their source's size stop there, and
    the rest is shared anew among the others. One row for each source: as many rows as there are names.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(order) - 1)
    sums = cut(sums.withColumn("weight", F.element_at(cycle, F.col("sid") % len(weights) + 1)))
    share, open_ = 0.0, (0, 0)
    while True:  # each round caps one source more, at least
        capped = F.col("weight") * share > copies * F.col("source_size")
        got = sums.agg(F.sum("source_size"), F.sum(F.when(capped, copies * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        total, stopped, weight, n = (x or 0 for x in got)
        if (weight, n) == open_:
            break
        open_ = weight, n
        share = (total - stopped) / weight if weight else 0.0
    target = F.least(F.col("weight") * F.lit(share), (copies * F.col("source_size")).cast("double"))
    return sums.withColumn("target", target)


def running(rows: DataFrame, keys: list[str], chunk: str, value: str, order: list[str], name: str) -> DataFrame:
    """`rows` with the sum of `value` over earlier rows of the same keys, by (chunk, order)."""
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("__sum")).select(*keys, chunk, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    summed = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(whole, [*keys, chunk]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def van_der_corput(t: Column, bits: int = 48) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(t), bits, "0")), 2, 10).cast("double") / float(2**bits)


def slots(sources: DataFrame, slot: int = SLOT) -> DataFrame:
    """slot, sid, rank: whose turn each slot is, and the how manieth of its source."""
    spark = sources.sparkSession
    whole = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    shares = cut(sources.select("sid", "target", F.sum("target").over(whole).alias("high")))
    total = shares.agg(F.max("high")).first()[0] or 0.0
    n = int(-(-total // slot))
    part = shares.where("target > 0").select("sid", ((F.col("high") - F.col("target")) / total).alias("low"), (F.col("high") / total).alias("high")) if total else shares.select("sid", F.col("target").alias("low"), "high").limit(0)
    cell = lambda c: F.floor(c * CELLS)
    part = part.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    turns = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point")).withColumn("cell", cell(F.col("point")))
    picked = turns.join(part, "cell").where("point >= low and point < high").select("slot", "sid", F.floor(F.col("slot") / max(1, n // CHUNKS)).alias("chunk"), F.lit(1).alias("one"))
    ranked = cut(running(picked, ["sid"], "chunk", "one", ["slot"], "rank").select("slot", "sid", "rank"))
    late = sources.where("target >= 0.5").join(ranked.select("sid").distinct(), "sid", "left_anti").select((F.col("sid") + n).cast("long").alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    return ranked.union(late)


def blocks(rows: DataFrame, sources: DataFrame, turns: DataFrame, copies: int = COPIES) -> DataFrame:
    """sid, rank, row, first_word, n_words: which words of which document make up each block.

    A document may be in several blocks, and up to `copies` times in all."""
    number = turns.groupBy("sid").agg(F.count("*").alias("n_slots"))
    facts = sources.join(number, "sid").select("source", "sid", "source_size", F.round("target").cast("long").alias("take"), "n_slots")
    known = rows.where("size > 0").join(facts, rows["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    known = known.withColumn("mark", mark).withColumn("chunk", F.substring("mark", 1, DIGITS))
    placed = running(known, ["sid"], "chunk", "size", ["mark", "size", "row"], "at")
    again = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    low = F.col("copy") * F.col("source_size") + F.col("at")
    spans = again.withColumn("low", low).withColumn("high", F.least(low + F.col("size"), F.col("take"))).where("low < high")
    of = lambda x: F.expr(f"(cast({x} + 1 as decimal(19, 0)) * cast(n_slots as decimal(18, 0)) - 1) div take")  # noqa: E731  the block of the word at x
    edge = lambda r: F.expr(f"(cast({r} as decimal(19, 0)) * cast(take as decimal(18, 0))) div n_slots")  # noqa: E731  the first word of block r
    cutup = spans.withColumn("rank", F.explode(F.sequence(of("low"), of("high - 1"))))
    start, stop = F.greatest("low", edge("rank")), F.least("high", edge("(rank + 1)"))
    return cutup.select("sid", "rank", "row", (start - F.col("low")).alias("first_word"), (stop - start).alias("n_words"))


def mix(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, source, size, source_size, target, taken), and the schedule: slot, source, doc_id, first_word, n_words."""
    rows = cut(sized(docs, text_col))
    sources = cut(targets(rows))
    turns = cut(slots(sources))
    schedule = cut(blocks(rows, sources, turns).join(turns, ["sid", "rank"]).select("slot", "sid", "row", "first_word", "n_words"))
    taken = schedule.groupBy("row").agg(F.sum("n_words").alias("taken"))
    named = sources.select(F.col("source").alias("__source"), "source_size", "target")
    out = rows.join(named, rows["source"].eqNullSafe(named["__source"])).drop("__source").join(taken, "row", "left")
    named = schedule.join(rows.select("row", "doc_id", "source"), "row").select("slot", "source", "doc_id", "first_word", "n_words")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), named
