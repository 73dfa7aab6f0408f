"""Documents to passages: lines, headings, regions, packing by a token budget, and merging of small passages.

All of it is functions of a document's lines, folds over its regions and windows over its passages; a document is as large as one row may be.
Tokens are counted by `tokens`, a quarter of the characters.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.functions.matching import gathered
from docweave.session import spread

#: Tokens of a passage, tokens that pieces of a long paragraph share, tokens under which a passage joins its neighbour.
SIZE, OVERLAP, LEAST = 256, 40, 32
#: Documents of a task: whole texts are more work than the rows of a compact table.
TASK_DOCS = 4096
# What a list item and a fence begin with; the shapes of headings, breaks, tables and underlines.
ITEM = r"^\s*(?:[-*+]\s|[-*+]\[[ x]\]\s|[0-9]+[.)]\s)"
FENCE = r"^(`{3,}|~{3,})"
UNDER = r"^[=\-]+\s*$"
BREAK, TABLE = r"^(-{3,}|\*{3,}|_{3,})\s*$", r"^\|.+\|$"
SHAPE = r"^#{1,6}\s+.|^[0-9]+(\.[0-9]+)*[.)]?\s+.|(?i:^[IVXLCDM]+[.)]\s+.)|(?i:^(section|chapter|part|appendix)\s+[0-9IVXLCDMA]+[\s:].)"
KINDS = ["paragraph", "heading", "list", "table", "break", "blank", "code"]


def tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, n, line, offset of each line."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    before = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def heading(bare: Column) -> Column:
    """Marked, numbered (in digits or Roman), named or upper-case lines of at most 200 characters that don't end like a sentence; without the spaces at both ends."""
    shape = bare.rlike(f"(?d){SHAPE}")
    upper = (F.length(bare) > 3) & (F.upper(bare) == bare) & (F.lower(bare) != bare)
    return (bare != "") & (F.length(bare) <= 200) & ~F.right(bare, F.lit(1)).isin(*".!?;:") & (shape | upper)


def headings(rows: DataFrame) -> DataFrame:
    """doc_id, offset, title of the headings among lines: those of `heading`, and lines that are underlined."""
    bare = F.col("bare")
    after = F.lead("line").over(W.partitionBy("doc_id").orderBy("n"))
    rows = rows.select("doc_id", "n", "offset", F.trim("line").alias("bare"), after.alias("after"))
    under = F.coalesce(F.col("after").rlike(f"(?d){UNDER}"), F.lit(False)) & (bare != "")
    return rows.where(heading(bare) | under).select("doc_id", "offset", bare.alias("title"))


def fenced(bare: pa.Array, doc: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """First and last line (of all) of the fenced stretches. A fence is closed by one of the same sign that is no shorter; an open one goes to the end of its document."""
    found, opened, sign, size = [], -1, "", 0
    for i in np.flatnonzero(pc.match_substring_regex(bare, FENCE).to_numpy(zero_copy_only=False)).tolist():
        line = bare[i].as_py()
        if opened >= 0 and doc[opened] != doc[i]:
            found.append((opened, int(end[doc[opened]]) - 1))
            opened = -1
        if opened < 0:
            opened, sign, size = i, line[0], len(line) - len(line.lstrip(line[0]))
        elif line[0] == sign and len(line) >= size:
            found.append((opened, i))
            opened = -1
    return found if opened < 0 else [*found, (opened, int(end[doc[opened]]) - 1)]


def outline(texts: pa.Array) -> pa.Array:
    """The regions and headings of a batch of texts: places among their lines, which are judged all at once."""
    parts = pc.split_pattern(texts, "\n")
    at, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    size = pc.utf8_length(flat).to_numpy().astype(np.int64) + 1
    begin = np.cumsum(size) - size
    begin -= begin[at[:-1]][doc]
    bare = pc.utf8_trim(flat, characters=" ")
    width = pc.utf8_length(bare).to_numpy()
    has = lambda lines, pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)

    head = (width > 0) & (width <= 200)
    short = bare.filter(pa.array(head))
    upper = has(short, "^.{4,}") & pc.equal(pc.utf8_upper(short), short).to_numpy(zero_copy_only=False) & pc.not_equal(pc.utf8_lower(short), short).to_numpy(zero_copy_only=False)
    head[head] = (upper | has(short, SHAPE)) & ~has(short, "[.!?;:]$")
    under = np.append(has(flat, UNDER), False)[1:]
    under[at[1:] - 1] = False  # the next line is another document's
    title = np.flatnonzero(head | (under & (width > 0)))

    kind = np.zeros(len(flat), np.int8)
    for code, where in ((1, head), (2, has(bare, ITEM)), (3, has(bare, TABLE)), (4, has(bare, BREAK)), (5, width == 0)):
        kind[where] = code
    starts = np.zeros(len(flat), bool)
    starts[at[:-1]] = True
    for first, last in fenced(bare, doc, at[1:]):
        kind[first : last + 1] = 6
        starts[first] = True
    starts[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(starts | (kind == 1) | (kind == 4))
    number = np.arange(len(starts)) - np.searchsorted(starts, at[:-1])[doc[starts]] + 1
    length = np.diff(np.append(starts, len(flat)))
    kept = kind[starts] != 5
    first = starts[kept]

    def listed(places: np.ndarray, **columns: pa.Array) -> pa.Array:
        each = np.append(0, np.cumsum(np.bincount(doc[places], minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    n = lambda places: pa.array(places - at[doc[places]], pa.int32())
    regions_ = listed(first, region=pa.array(number[kept], pa.int64()), type=pa.array(KINDS).take(pa.array(kind[first])), n=n(first), size=pa.array(length[kept], pa.int32()), offset=pa.array(begin[first], pa.int64()))
    return pa.StructArray.from_arrays([regions_, listed(title, n=n(title), offset=pa.array(begin[title], pa.int64()))], ["regions", "titles"])


def outlined(docs: DataFrame) -> DataFrame:
    """doc_id, parts and found: the lines of each document, and where its regions (n: the first line, size: how many) and headings are."""

    @F.arrow_udf("struct<regions:array<struct<region:bigint,type:string,n:int,size:int,offset:bigint>>,titles:array<struct<n:int,offset:bigint>>>")
    def found(texts: pa.Array) -> pa.Array:
        return outline(texts)

    texts = docs.select("doc_id", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.select("doc_id", "text", found("text").alias("found")).select("doc_id", F.split("text", "\n").alias("parts"), "found")


def titles(outlines: DataFrame) -> DataFrame:
    """doc_id, offset, title of the headings of documents, as `headings` finds them."""
    each = lambda parts: F.transform("found.titles", lambda t: F.struct(t["offset"].alias("offset"), F.trim(F.get(parts, t["n"])).alias("title")))
    return outlines.select("doc_id", F.explode(F.transform(F.array("parts"), each)[0]).alias("t")).select("doc_id", "t.offset", "t.title")


def parted(outlines: DataFrame) -> DataFrame:
    """doc_id and r: (region, type, tokens, offset, content) of the regions of documents."""

    def one(parts: Column, r: Column) -> Column:
        joined = F.array_join(F.slice(parts, r["n"] + 1, r["size"]), "\n")
        content = F.when(r["type"].isin("heading", "break"), F.trim(joined)).otherwise(joined)
        fields = [r[c].alias(c) for c in ("region", "type", "offset")]
        return F.transform(F.array(content), lambda c: F.struct(fields[0], fields[1], tokens(c).alias("tokens"), fields[2], c.alias("content")))[0]

    every = F.transform(F.array("parts"), lambda parts: F.transform("found.regions", lambda r: one(parts, r)))[0]  # a text is split once, not for each region
    return outlines.select("doc_id", every.alias("r"))


def regions(rows: DataFrame) -> DataFrame:
    """doc_id, region, type, content, offset: stretches of lines of one kind (code, table, list, paragraph), and single headings and breaks; blank lines part all but code."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])  # lines of one document
    return regions_of(rows.groupBy("doc_id").agg(F.array_join(listed, "\n").alias("text")))


def regions_of(docs: DataFrame) -> DataFrame:
    """The regions of documents (doc_id, text)."""
    return parted(outlined(docs)).select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.region", "r.type", "r.content", "r.offset")


def cut_up(text: str, most: int, share: int) -> list[tuple[int, str]]:
    """(start, content) of the pieces of one paragraph, found by search among the places where its units begin."""
    units, sep = text.split("\n"), "\n"
    if any(len(line) > most for line in units):
        words, sep = text.replace("\n", " ").split(" "), " "
        units = [part for w in words for part in ([w] if len(w) <= most else [w[i : i + most] for i in range(0, len(w), most)])]
    at = list(accumulate((len(u) + 1 for u in units), initial=0))  # where each unit begins, and the end and one more
    after = lambda i: next((k for k in range(i, len(units)) if units[k]), len(units))  # noqa: E731  empty units that a piece begins with do not fill it
    out, first, base = [], 0, after(0)
    while True:
        over = bisect_right(at, at[base] + most + 1) - 1 if base < len(units) else len(units)
        content = sep.join(units[first:over])
        if content.strip(" "):
            out.append((at[first], content))
        if over >= len(units):
            return out
        first = bisect_left(at, at[over] - min(share + 1, most - len(units[over])), first + 1, over)
        base = first if first < over else after(over)


def pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """(start, content) of a long paragraph's pieces of at most `size` tokens: of whole lines if each fits, else of words; a word too long is cut. A piece begins with as much of the one before as `overlap` tokens hold. Without a text, none."""

    @F.arrow_udf("array<struct<start:int,content:string>>")
    def found(texts: pa.Array) -> pa.Array:
        all_ = [[] if t is None else cut_up(t, 4 * size, 4 * overlap) for t in texts.to_pylist()]
        flat = pa.StructArray.from_arrays([pa.array([p[k] for one in all_ for p in one], kind) for k, kind in enumerate((pa.int32(), pa.string()))], ["start", "content"])
        return pa.ListArray.from_arrays(pa.array(accumulate(map(len, all_), initial=0), pa.int32()), flat)

    return found(F.make_valid_utf8(text))


def packed(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, place, offset, content of passages: regions in order as long as they fit; a heading or a break begins a new one; a long paragraph that comes first in one is cut."""
    each = F.struct("region", "type", tokens(F.col("content")).alias("tokens"), F.col("offset").cast("bigint").alias("offset"), "content")
    return packed_lists(parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("r")), size)  # regions of one document


def packed_lists(listed: DataFrame, size: int = SIZE) -> DataFrame:
    """`packed` for documents (doc_id, r), r as `parted` gives it."""
    kind = "struct<region:bigint,no:int,cut:boolean,offset:bigint,content:string>"
    state = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("open"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        after = s["no"] + F.when(s["open"], 1).otherwise(0)
        made = lambda no, held, open_: F.struct(no.alias("no"), held.cast("long").alias("held"), F.lit(open_).alias("open"))
        fits = s["held"] + r["tokens"] <= size
        alone = ~s["open"] & ~fits
        new = (
            F.when(r["type"] == "break", made(after, F.lit(0), False)).when(r["type"] == "heading", made(after, r["tokens"], True)).when(fits, made(s["no"], s["held"] + r["tokens"], True))
            .when(alone, made(s["no"] + 1, F.lit(0), False)).otherwise(made(s["no"] + 1, r["tokens"], True))
        )
        no = F.when(r["type"] == "heading", after).when(fits | alone, s["no"]).otherwise(s["no"] + 1)
        one = F.array(F.struct(r["region"].alias("region"), no.alias("no"), (alone & (r["type"] == "paragraph")).alias("cut"), r["offset"].alias("offset"), r["content"].alias("content")))
        return new, F.when(r["type"] == "break", F.array().cast(f"array<{kind}>")).otherwise(one)

    numbered = listed.select("doc_id", F.explode(gathered(F.col("r"), state, kind, step)).alias("x")).select("doc_id", "x.*")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("region", "content"))), lambda s: s["content"])
    rows = numbered.groupBy("doc_id", "no").agg(F.max("cut").alias("cut"), F.min("offset").alias("offset"), F.array_join(whole, "\n\n").alias("content"))  # what is cut is alone
    rows = rows.withColumn("pieces", pieces(F.when(F.col("cut"), F.col("content")), size))
    one = F.array(F.struct(F.lit(0).alias("start"), F.col("content").alias("content")))
    rows = rows.select("doc_id", "no", "offset", F.posexplode(F.when(F.col("cut"), F.col("pieces")).otherwise(one)).alias("piece", "p"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("no", "piece")) - 1
    return rows.select("doc_id", place.alias("place"), (F.col("offset") + F.col("p.start")).alias("offset"), "p.content")


def merged(rows: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """Passages after those of fewer than `least` tokens have joined the one before them, as long as both fit; a small first one joins the next."""
    each = F.struct("place", F.length("content").alias("length"), F.col("offset").cast("bigint").alias("offset"), "content")
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("r"))  # passages of one document
    kind = "struct<place:int,into:int,offset:bigint,content:string>"
    count = lambda n: F.ceil(n / 4)
    state = F.struct(F.lit(-1).alias("into"), F.lit(0).alias("length"))

    def step(s: Column, r: Column) -> tuple[Column, Column]:
        joins = (s["into"] >= 0) & (count(r["length"]) < least) & (count(s["length"]) + count(r["length"]) <= size)
        into = F.when(joins, s["into"]).otherwise(r["place"])
        return F.struct(into.alias("into"), F.when(joins, s["length"] + 1 + r["length"]).otherwise(r["length"]).alias("length")), F.array(F.struct(r["place"].alias("place"), into.alias("into"), r["offset"].alias("offset"), r["content"].alias("content")))

    groups = listed.select("doc_id", F.explode(gathered(F.col("r"), state, kind, step)).alias("x")).select("doc_id", "x.*")
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda s: s["content"]), "\n")
    once = groups.groupBy("doc_id", "into").agg(F.min("offset").alias("offset"), content.alias("content"))
    own = W.partitionBy("doc_id").orderBy("into")
    first = once.withColumns({"no": F.row_number().over(own), "next": F.lead("content").over(own)})
    joins = (F.col("no") == 1) & F.col("next").isNotNull() & (tokens(F.col("content")) < least) & (tokens(F.col("content")) + tokens(F.col("next")) <= size)
    marked = first.withColumn("joins", joins).withColumn("after", F.lag("joins").over(own))
    kept = marked.where("not coalesce(after, false)").select("doc_id", "offset", F.when(F.col("joins"), F.concat_ws("\n", "content", "next")).otherwise(F.col("content")).alias("content"))
    return kept.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("offset")) - 1).alias("chunk_index"), "offset", "content")


def chunks(docs: DataFrame, size: int = SIZE, least: int = LEAST, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_index, total, section, page, start, tokens, content. section: the last heading at or before the passage's
    beginning; total: passages of the document; page: the page (doc_id, page, offset: where it begins) that the beginning is
    on, the last one for what lies beyond, null without pages."""
    own = outlined(spread(docs, "doc_id", TASK_DOCS))
    marks = {"title": titles(own)}
    if pages is not None:
        marks["page"] = pages.select("doc_id", "offset", F.col("page").cast("bigint").alias("page"))
    out = at_or_before(merged(packed_lists(parted(own), size), size, least), marks)
    page = F.lit(None).cast("bigint") if pages is None else F.col("page")
    total = F.count("*").over(W.partitionBy("doc_id"))
    return out.select("doc_id", "chunk_index", total.alias("total"), F.col("title").alias("section"), page.alias("page"), F.col("offset").alias("start"), tokens(F.col("content")).alias("tokens"), "content")


def at_or_before(rows: DataFrame, marks: dict[str, DataFrame]) -> DataFrame:
    """Rows (doc_id, offset, ...) with the values of the last marks (doc_id, offset, value, by the value's name) of the document at or before the offset: one walk over all in order."""
    at = F.col("offset").cast("bigint").alias("offset")
    own = [c for c in rows.columns if c != "doc_id"]  # the document stays a column: its rows lie together
    kinds = {value: dict(m.dtypes)[value] for value, m in marks.items()}
    both = rows.select("doc_id", at, F.lit(1).alias("__pos"), *[F.lit(None).cast(kind).alias(value) for value, kind in kinds.items()], F.struct(*own).alias("__row"))
    for value, m in marks.items():
        both = both.unionByName(m.select("doc_id", at, F.lit(0).alias("__pos"), value), allowMissingColumns=True)
    upto = W.partitionBy("doc_id").orderBy("offset", "__pos").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumns({value: F.last(value, ignorenulls=True).over(upto) for value in marks}).where("__pos = 1").select(*[c if c == "doc_id" else F.col("__row")[c].alias(c) for c in rows.columns], *marks)


def section_of(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (doc_id, offset, ...) with title: the last heading (doc_id, offset, title) of the document at or before the offset."""
    return at_or_before(rows, {"title": titles})
