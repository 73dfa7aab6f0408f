"""Near-copies by SetSketch registers: band, estimate, verify, join into components.

A document's set holds its distinct k-word shingles (A-Z lower-cased; with fewer words, all of them as one).
1. Rows of equal sets become one class, so that exact copies cost no pairs.
2. Bands of registers put classes into buckets. In a bucket every class is paired only with the hub, the class
   that shares most buckets with others: the original among its copies. So pairs grow with the rows, not with
   the square of a bucket.
3. A pair's similarity is estimated from both sketches by likelihood; what may pass is verified on full sets.
4. Pairs that no hub decides are looked at in two ways. Classes that are strangers to their hub meet the rest of
   a small bucket inside a join whose condition, on sizes and register parities, no linked pair breaks; in large
   buckets they meet, under the same condition, over their rarest shingles: linked sets share one of the rarest
   n - ceil(0.8 n) + 1 in any order that all sets use, here that of approximate frequency, so what many documents
   share brings none together. Classes that are near each other through hubs make up a family. Of a family of several
   components, only those classes go on that share a rarest shingle with a class of another component; of these, what
   isn't in the largest component is multiplied with the others, block by block, as 0/1 matrices over their shared
   shingles, and only links come out. Pairs inside a component need no look.
5. Components of the links, least doc_id first.

With 32 bands of 4 registers, a pair at the threshold of 0.8 shares no bucket with probability 5e-8. Rows of a hot bucket,
hub or component are dealt to several tasks. Very long texts are sketched whole, each as a block of its own; of hubs
of equal weight the least doc_id leads.

Null or empty texts, and those of white space, have empty sets and are linked with nothing; nor are rows
without doc_id. A doc_id names one text: its repeated rows get the same component, and all are `kept` if the id is.
An empty table gives an empty one. Only doc_id and the text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import setsketch
from docweave.llm.blocks import add_columns, hash_spans, lower, mix, raw, shingles, word_bounds
from docweave.llm.components import components
from docweave.llm.skew import star_join
from docweave.session import counted, cut

BAND = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Pairs of a lower estimate aren't verified: six standard deviations below the threshold.
DOUBT = 0.59
#: Linked pairs differ in at most this many of 128 parities: 13 are expected, six standard deviations are 20.
PARITIES = 34
#: Classes of a small bucket; cells of approximate shingle frequencies; shingles of a block of a family.
SMALL, CELLS, BLOCK = 256, 1 << 16, 200_000


def distinct_shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    data, at = raw(texts)
    data = lower(data)
    start, end, row = word_bounds(data, at)
    h, r = shingles(hash_spans(data, start, end), row, k, len(texts))
    edge = np.searchsorted(r, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def sketch(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """`docs` with n_shingles, two digests of the set and its registers (null for empty sets) in place of the text."""
    added = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("registers", T.BinaryType())])

    def make():
        def work(texts: pa.Array) -> dict:
            sets = distinct_shingles(texts, k)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            n = len(sets)
            a, b, packed = np.zeros(n, np.uint64), np.zeros(n, np.uint64), [None] * n
            if len(full):
                h, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(size[full])[:-1]])
                a[full], b[full] = np.add.reduceat(mix(h), first), np.bitwise_xor.reduceat(mix(h + np.uint64(1)), first)
                for i, r in zip(full, setsketch.registers(h, first), strict=True):
                    packed[i] = r.tobytes()
            return {"n_shingles": size, "set_a": a.view(np.int64), "set_b": b.view(np.int64), "registers": packed}

        return work

    return add_columns(docs, text_col, make, added, drop=(text_col,), limit=1 << 18)


def whole_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """`docs` with the set, as packed 64-bit hashes in order, in place of the text."""

    def make():
        return lambda texts: {"shingles": [s.tobytes() for s in distinct_shingles(texts, k)]}

    return add_columns(docs, text_col, make, T.StructType([T.StructField("shingles", T.BinaryType())]), drop=(text_col,))


def verify(pairs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The n pairs (a, b; written) that are near by their sketches, and whether they are linked. members: rep, registers, shingles."""
    side = lambda c: members.select(F.col("rep").alias(c), F.col("registers").alias(f"registers_{c}"), F.col("shingles").alias(f"shingles_{c}"))
    number = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    rows = star_join(star_join(pairs, side("a"), "a", "b", number("a"), n), side("b"), "b", "a", number("b"), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
                sets = [[np.frombuffer(x, np.uint64) for x in col[f"shingles_{c}"].to_pylist()] for c in "ab"]
                size = [np.array([len(s) for s in x]) for x in sets]
                marks = [np.frombuffer(b"".join(col[f"registers_{c}"].to_pylist()), "<u2").reshape(-1, setsketch.REGISTERS) for c in "ab"]
                near = np.flatnonzero(setsketch.similarity(*marks, *size) >= DOUBT)
                linked = np.zeros(len(near), bool)
                for k, i in enumerate(near):
                    if 100 * min(size[0][i], size[1][i]) >= PERCENT * max(size[0][i], size[1][i]):
                        both = len(np.intersect1d(sets[0][i], sets[1][i], assume_unique=True))
                        linked[k] = 100 * both >= PERCENT * (size[0][i] + size[1][i] - both)
                at = pa.array(near)
                yield pa.RecordBatch.from_arrays([col["a"].take(at), col["b"].take(at), pa.array(linked)], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def near_copies(docs: DataFrame, text_col: str = "text", k: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`."""
    docs = docs.select("doc_id", F.col(text_col).alias("text"))
    rows, n_rows = counted(sketch(docs, "text", k))
    rows = rows.withColumn("set", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.struct("n_shingles", "set_a", "set_b"))).drop("set_a", "set_b")
    classed = rows.where("set is not null")
    classes = cut(classed.groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("registers").alias("registers"), F.count("*").alias("n"))).withColumn("n_shingles", F.col("set.n_shingles"))

    # buckets of two classes or more
    width = 2 * BAND
    band = F.posexplode(F.array(*[F.substring("registers", 1 + width * i, width) for i in range(setsketch.REGISTERS // BAND)])).alias("band", "part")
    bands = classes.select("rep", band).select("rep", F.xxhash64("band", "part").alias("bucket"))
    filled = cut(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    placed, n_placed = counted(star_join(bands, filled, "bucket", "rep", filled))

    # each class with the hub of its bucket
    weight = cut(placed.groupBy("rep").agg(F.sum("n").alias("weight")))
    hubs = placed.join(weight, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    led = cut(star_join(placed, hubs, "bucket", "rep", filled, n_placed).where("rep <> hub").select("bucket", "rep", "hub", "n"))
    pairs, n_pairs = counted(led.select(*ordered("rep", "hub")).distinct())

    texts = docs.join(weight.select("rep"), F.col("doc_id") == F.col("rep")).groupBy("rep").agg(F.max("text").alias("text"))
    members = cut(whole_sets(texts, "text", k).join(classes.select("rep", "n_shingles", "registers"), "rep"))
    near = cut(verify(pairs, members, n_pairs))
    roots = components(near.where("linked").select("a", "b"))
    more = strangers(led, near, members, roots)
    if not near.where("not linked").isEmpty():
        more = more.union(families(near, members, roots))
    more = cut(more)
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("root", "rep").alias("component_id"))
    inside = star_join(classed.select("doc_id", "n_shingles", "set"), named, "set", "doc_id", classes.select("set", "n"), n_rows)
    apart = rows.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = inside.select("doc_id", "n_shingles", "component_id").union(apart)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def parts_of(reps: DataFrame, roots: DataFrame) -> DataFrame:
    return reps.join(roots, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("root", "rep")).drop("node", "root")


def strangers(led: DataFrame, near: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (a, b) between classes that their bucket's hub isn't near to and others in the bucket."""
    several = led.where("n > 2")
    unlike = several.select("bucket", "rep", "n", *ordered("rep", "hub")).join(near.select("a", "b"), ["a", "b"], "left_anti").select("bucket", "rep", "n")
    unlike = cut(unlike)
    facts = cut(parts_of(members.select("rep", "n_shingles", "registers").mapInArrow(_parities, "rep long, n_shingles long, p0 long, p1 long"), roots))
    # small buckets: at most SMALL rows meet one
    x = unlike.where(F.col("n") <= SMALL).select("bucket", "rep").join(facts, "rep").alias("x")
    y = several.where(F.col("n") <= SMALL).select("bucket", "rep").join(facts, "rep").alias("y")
    found = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & may("x", "y")).select(*ordered("x.rep", "y.rep"))
    found, n = counted(found.union(over_rare_shingles(several, unlike, members, facts)).distinct())
    return verify(found, members, n).where("linked").select("a", "b")


def may(x: str, y: str) -> Column:
    """Whether two classes of different components can be linked, by their sizes and parities."""
    apart = F.bit_count(F.col(f"{x}.p0").bitwiseXOR(F.col(f"{y}.p0"))) + F.bit_count(F.col(f"{x}.p1").bitwiseXOR(F.col(f"{y}.p1")))
    sizes = 100 * F.least(f"{x}.n_shingles", f"{y}.n_shingles") >= PERCENT * F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return (F.col(f"{x}.part") != F.col(f"{y}.part")) & sizes & (apart <= PARITIES)


def over_rare_shingles(several: DataFrame, unlike: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) of strangers of large buckets and other classes of such buckets that may be linked and share one of their rarest shingles."""
    large = F.col("n") > SMALL
    strange = cut(unlike.where(large).select("rep").distinct())
    if strange.isEmpty():
        return unlike.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
    busy = unlike.where(large).groupBy("bucket").agg(F.count("*").alias("strangers"))
    sizes = several.where(large).groupBy("bucket").agg(F.count("*").alias("n"))
    inside = star_join(several.where(large).select("bucket", "rep"), busy, "bucket", "rep", sizes)
    sets = cut(inside.select("rep").distinct().join(members.select("rep", "shingles"), "rep"))
    keys, n = counted(rarest(sets))
    asked = keys.join(strange, "rep", "left_semi")
    number = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").join(asked.select("key").distinct(), "key")
    rows = cut(star_join(keys, number.select("key"), "key", "rep", number, n).join(facts, "rep"))
    side = lambda of, name: of.select("key", F.struct("rep", "n_shingles", "p0", "p1", "part").alias(name))
    met = star_join(side(rows.join(strange, "rep", "left_semi"), "x"), side(rows, "y"), "key", "x.rep", number, n)
    return met.where(may("x", "y")).select(*ordered("x.rep", "y.rep"))


def rarest(sets: DataFrame) -> DataFrame:
    """(rep, key) of the rarest shingles of each set (rep, shingles; written), one of which any two linked sets share."""
    often = sets.select("shingles").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    level = np.zeros(CELLS, np.int64)
    level[often["cell"].to_numpy(np.int64)] = often["n"].to_numpy(np.int64)
    held = sets.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(packed, np.uint64)
                own = h[np.lexsort((h, held.value[_cell(h)]))][: prefix(len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rep)), pa.array(own.view(np.int64))], names=["rep", "key"])

    return sets.select("rep", "shingles").mapInArrow(run, "rep long, key long")


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def meeting(kin: DataFrame, members: DataFrame) -> DataFrame:
    """rep of those of `kin` (family, rep, part, over; written) that share a rarest shingle with one of another part of the family, where a class left over holds it too."""
    sets = cut(kin.select("rep").join(members.select("rep", "shingles"), "rep"))
    placed, n = counted(rarest(sets).join(kin, "rep").select("rep", "part", "over", F.xxhash64("family", "key").alias("key")))
    shared = placed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.bool_or("over").alias("some"), F.count("*").alias("n")).where("a <> b and some").select("key", "n")
    return star_join(placed.select("key", "rep"), shared.select("key"), "key", "rep", shared, n).select("rep").distinct()


def families(near: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between components of one family: of each class left over, to the least class of every component it is linked with in a block."""
    named = components(near.select("a", "b"))
    kin = named.select(F.col("node").alias("rep"), F.col("root").alias("family")).union(named.select("root", "root").distinct())
    kin, n = counted(parts_of(kin, roots))
    sizes = kin.groupBy("family", "part").agg(F.count("*").alias("n"))
    major = sizes.groupBy("family").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("family", "major")
    of_family = sizes.groupBy("family").agg(F.sum("n").alias("n"))
    kin, n = counted(star_join(kin, major, "family", "rep", of_family, n).select("family", "rep", "part", (F.col("part") != F.col("major")).alias("over")))
    if not n:
        return kin.select(F.col("rep").alias("a"), F.col("part").alias("b"))
    kin = cut(kin.join(meeting(kin, members), "rep").join(members.select("rep", "n_shingles"), "rep"))
    load = lambda what: F.greatest(F.ceil(F.sum(what) / F.lit(BLOCK)), F.lit(1)).cast("int")
    sums = kin.groupBy("family").agg(F.count("*").alias("n"), load("n_shingles").alias("n_all"), load(F.when(F.col("over"), F.col("n_shingles")).otherwise(0)).alias("n_left"))
    rows = star_join(kin.drop("n_shingles"), sums.drop("n"), "family", "rep", sums.select("family", "n"), n).join(members.select("rep", "shingles"), "rep")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = rows.where("over").select("family", "rep", "part", "shingles", own("n_left").alias("i"), spread("n_all").alias("j"), F.lit(True).alias("over"))
    whole = rows.select("family", "rep", "part", "shingles", spread("n_left").alias("i"), own("n_all").alias("j"), F.lit(False).alias("over"))
    return left.union(whole).groupBy("family", "i", "j").applyInArrow(_multiplied, "a long, b long")


def _multiplied(group: pa.Table) -> pa.Table:
    """Links of the classes left over with the others of the group, by exact intersection sizes."""
    group = group.combine_chunks()
    over = group["over"].to_numpy()
    rep, part = group["rep"].to_numpy(), group["part"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
    x, y = np.flatnonzero(over), np.flatnonzero(~over)
    links: list[tuple[int, int]] = []
    if len(x) and len(y):
        size = np.array([len(s) for s in sets])
        shared = np.intersect1d(np.concatenate([sets[i] for i in x]), np.concatenate([sets[i] for i in y]))
        for low in range(0, len(x), 256):
            for start in range(0, len(y), 1024):
                u, v = x[low : low + 256], y[start : start + 1024]
                both = np.zeros((len(u), len(v)), np.float32)
                for c in range(0, len(shared), 2048):
                    both += _present(sets, u, shared[c : c + 2048]) @ _present(sets, v, shared[c : c + 2048]).T
                yes = (100 * both >= PERCENT * (size[u][:, None] + size[v][None, :] - both)) & (part[u][:, None] != part[v][None, :])
                for i in np.flatnonzero(yes.any(1)):
                    ends = v[yes[i]]
                    _, first = np.unique(part[ends], return_index=True)
                    links += [(rep[u[i]], r) for r in rep[ends[first]]]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _present(sets: list[np.ndarray], rows: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """0/1 matrix: which of the shared shingles each row has."""
    out = np.zeros((len(rows), len(shared)), np.float32)
    for k, i in enumerate(rows):
        at = np.minimum(np.searchsorted(sets[i], shared), len(sets[i]) - 1)
        out[k] = sets[i][at] == shared
    return out


def prefix(n: int) -> int:
    """How many of a set's n shingles hold one of any linked set's, in an order that all sets use."""
    return n - -(-PERCENT * n // 100) + 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each cell, summed in the task."""
    n = np.zeros(CELLS, np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            np.add.at(n, _cell(np.frombuffer(packed, np.uint64)), 1)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["cell", "n"])


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, setsketch.REGISTERS)
        halves = np.packbits(marks & 1, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["rep", "n_shingles", "p0", "p1"])
