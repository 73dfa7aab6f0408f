"""Fill-in-middle: a text is cut at two seeded places, and its middle is put last.

The cuts fall between units, which are words of the letters A-Z and a-z, or single other characters. Where the units end
depends on the text alone, so it is found once for each distinct text: documents are grouped by the SHA-256 digest of
their text, copies being combined before the shuffle; the texts of a digest must agree in length and in a second hash too.
Documents, without their texts, are joined back by digest. Those of one text come to a task one after the other: its list of
boundaries (bytes) is made once, in Elias-Fano form, two to three bits a unit, and each document selects the boundaries
of its two cuts from the list and cuts there.

A text shared by many documents would bring all of these to one task. Digests whose documents hold many bytes, more than
a quarter of an average partition and more than a megabyte, are dealt to several tasks: fewer than four digests a
partition can be so large, which bounds the broadcast list of them.

Null and empty texts, having no units, stay as they are (form "plain", no lengths), like texts that hold one of the three
marks. A null doc_id counts as empty in its seed. Repeated rows give repeated results, an empty table an empty one;
columns of the result replace columns of the same name. A very long text is a block of its own in each step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.blocks import add_columns, raw
from docweave.session import cut

#: The marks of a document in parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bits of the high part between two counts of ones.
STEP = 512
#: Share of an average partition, and bytes, over which the documents of one text are dealt to several tasks.
SHARE, LEAST_BYTES, ROW_BYTES = 0.25, 1 << 20, 256

#: What an output column holds.
OUTPUTS = {
    "n": T.LongType(),
    "prefix_chars": T.LongType(),
    "middle_chars": T.LongType(),
    "output": T.StringType(),
    "output_sha256": T.StringType(),
    "restored": T.StringType(),
    "restored_sha256": T.StringType(),
}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte places where the units of a UTF-8 text begin."""
    letter = _LETTER[data]
    first = (data & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def packed_list(values: np.ndarray, above: int) -> dict:
    """Elias-Fano form of increasing values under `above`: low bits side by side, high parts as gaps in unary, and the ones before each STEP bits."""
    n = len(values)
    width = max(0, (above // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
    high = np.zeros(-(-((above >> width) + n + 1) // STEP) * STEP, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    ones = np.concatenate([[0], np.cumsum(high.reshape(-1, STEP).sum(1, dtype=np.int64))[:-1]])
    return {"n": n, "width": width, "low": np.packbits(bits.ravel(), bitorder="little").tobytes(), "high": np.packbits(high, bitorder="little").tobytes(), "ones": ones.astype("<i8").tobytes()}


def select(packed: dict, k: int) -> int:
    """The k-th value of a list in Elias-Fano form, from 0: one search among the counts, one step of the high part."""
    ones = np.frombuffer(packed["ones"], "<i8")
    step = int(np.searchsorted(ones, k, "right")) - 1
    bits = np.unpackbits(np.frombuffer(packed["high"], np.uint8, STEP // 8, step * STEP // 8), bitorder="little")
    place = step * STEP + int(np.flatnonzero(bits)[k - int(ones[step])])
    width = packed["width"]
    first = k * width
    window = int.from_bytes(packed["low"][first // 8 : (first + width + 7) // 8], "little")
    return (place - k) << width | (window >> first % 8) & ((1 << width) - 1)


def rebuilt(output: bytes, form: str) -> bytes:
    """The text from a document in parts."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        prefix, _, rest = output[len(p) :].partition(s)
        suffix, _, middle = rest.partition(m)
    elif form == "spm":
        suffix, _, rest = output[len(s) :].partition(p)
        prefix, _, middle = rest.partition(m)
    else:
        return output
    return prefix + middle + suffix


def _chars(part: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))


def _boundaries(text: np.ndarray) -> dict:
    return packed_list(unit_starts(text), len(text))


def _cut_texts(outputs: tuple[str, ...]):
    """The function that cuts a block of texts, given their digests, seeds and forms."""
    asked, p, s, m = set(outputs), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    lists: dict[bytes, dict] = {}  # those of a block; the last one stays for the next

    def work(block: pa.RecordBatch) -> dict:
        made: dict = {c: [] for c in outputs}
        data, at = raw(block.column("__text"))
        digest = None
        for i, (digest, h, form) in enumerate(zip(*(block.column(c).to_pylist() for c in ("__digest", "__seeds", "form")))):
            units = lists.get(digest)
            if units is None:
                units = lists[digest] = _boundaries(data[at[i] : at[i + 1]])
            text, n = data[at[i] : at[i + 1]].tobytes(), units["n"]
            output, chars = text, (None, None)
            if form != "plain":
                first, last = (select(units, k) if k < n else len(text) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                prefix, middle, suffix = text[:first], text[first:last], text[last:]
                output = b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])
                chars = _chars(prefix), _chars(middle)
            back = rebuilt(output, form) if asked & {"restored", "restored_sha256"} else b""
            for c in outputs:
                if c == "n":
                    made[c].append(n)
                elif c.endswith("_chars"):
                    made[c].append(chars[c == "middle_chars"])
                else:
                    part = output if c.startswith("output") else back
                    made[c].append(hashlib.sha256(part).hexdigest() if c.endswith("_sha256") else part.decode())
        for other in [d for d in lists if d != digest]:
            del lists[other]
        return made

    return work


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _index(texts: DataFrame) -> DataFrame:
    """(__digest, __text) of the distinct texts of `texts` (__digest, __text)."""
    check = F.struct(F.octet_length("__text"), F.xxhash64("__text"))
    one = texts.withColumn("__check", check).groupBy("__digest").agg(F.min("__text").alias("__text"), F.min("__check").alias("__least"), F.max("__check").alias("__most"))
    verified = F.when(F.col("__least") == F.col("__most"), F.col("__text")).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("string"))
    return one.select("__digest", verified.alias("__text"))


def _large(texts: DataFrame) -> DataFrame | None:
    """(__digest, __deals) of the texts whose documents are dealt to several tasks; None if there aren't any."""
    size = F.max(F.octet_length("__text")) + ROW_BYTES
    sizes = cut(texts.groupBy("__digest").agg((F.count(F.lit(1)) * size).alias("n")))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max(LEAST_BYTES, int((total or 0) * SHARE / int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= limit:
        return None
    return sizes.where(F.col("n") > limit).select("__digest", F.ceil(F.col("n") / limit).cast("int").alias("__deals"))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("output",), seed: int = 1) -> DataFrame:
    """`docs` without their texts, with form ("plain", "psm" or "spm") and the asked-for OUTPUTS; n is the number of units.

    With h1 to h4 the first four 8-digit groups of the sha256 of `seed:doc_id`, the cuts are after h1 % (n + 1) and
    h2 % (n + 1) units; the form is plain if h3 % 100 is among the last PLAIN, and spm if h4 % 100 is among the first
    SUFFIX_FIRST.
    """
    names = {c.lower() for c in ("form", text_col, *OUTPUTS)}
    kept = [c for c in docs.columns if c.lower() not in names]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(_digest(text).alias("__digest"), text.alias("__text"))
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in kept])
    light = docs.select(own.alias("__own"), F.col(f"`{doc_id}`").cast("string").alias("__doc"), _digest(text).alias("__digest"))
    large = _large(texts)
    if large is None:
        joined = light.join(_index(texts), "__digest")
    else:
        large = F.broadcast(large)
        few = _index(texts.join(large, "__digest", "left_semi")).join(large, "__digest")
        few = few.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
        dealt = light.join(large, "__digest").withColumn("__deal", F.pmod(F.xxhash64("__doc"), F.col("__deals")).cast("int")).drop("__deals")
        rest = light.join(large, "__digest", "left_anti").join(_index(texts.join(large, "__digest", "left_anti")), "__digest")
        joined = rest.unionByName(dealt.join(few, ["__digest", "__deal"]).drop("__deal"))
    h = [F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("__doc", F.lit(""))), 256), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.col("__text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    ready = joined.select("__own", "__text", "__digest", F.array(h[0], h[1]).alias("__seeds"), form.alias("form"))
    added = T.StructType([T.StructField(c, OUTPUTS[c]) for c in outputs])
    done = add_columns(ready, "__text", lambda: _cut_texts(outputs), added, drop=("__text", "__digest", "__seeds"), whole=True)
    return done.select(*[F.col("__own")[c].alias(c) for c in kept], "form", *outputs)
