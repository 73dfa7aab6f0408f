"""Secret scans in DataFrame functions alone.

Four kinds of spans, in code points, end exclusive: `assign` (a secret's name, a sign and its value), `access`
(access key ids), `hex` (long runs of lower-case hexadecimal digits), and `entropy`: candidate strings of 20 or more
key characters of which some window of 20 is random enough for its character class. What the first three kinds
hold, and what the allow-list knows (UUIDs, placeholders, runs along the alphabet or the digits, one character
again and again), is cut out of the text first; candidates are the strings that are left, so a known part
suppresses itself and not what stands beside it. Strings of digits alone, and of letters of one case alone, have no class.

A window's entropy comes from counts that change by one character in and one out at each step. The counts are packed,
twelve to a whole number; sum c * log2 c is kept in millionths, so that the sum stays exact. A step costs the
same however long the candidate is.

A text's matches are found by splitting at a pattern: lengths of pieces and matches give the places. Texts
without a match cost one search for each kind. Null texts count as empty and have no spans; rows with null in
other columns are scanned alike; very long texts are scanned whole; repeated rows give repeated results, an empty
table an empty one. Spans that begin together are in the order of KINDS. The column `spans` replaces one of that
name; all others are kept, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits that a window of each character class has at least: hexadecimal digits of either case, letters and digits, letters of both cases.
BITS = {"hex": 3.0, "mixed": 3.7, "letters": 4.1}
#: Such stretches are known not to be secrets.
ALLOWED = "|".join((
    "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "(?i:example|placeholder|changeme|dummy|redacted|your[_-])",
    "(?i:abcdefgh(?:ijklmnop(?:qrstuvwxyz)?)?|0123456789|9876543210|qwertyui(?:op)?)",
    *(f"{re.escape(c)}{{6,}}" for c in ALPHABET),
))
#: Matches of a text that are placed at a time.
CHUNK = 256


def weight(count: int) -> int:
    """count * log2 count, in millionths."""
    return round(count * math.log2(count) * 1_000_000) if count else 0


def most(bits: float) -> int:
    """The sum of weights of a window that has just so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1_000_000)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, found) of each match of `pattern`; found is the group."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"))
    kind = "struct<start:int,end:int,found:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))[0]

    # by chunks, so that growing the list doesn't cost the square of its length
    chunks = F.transform(F.sequence(F.lit(0), ((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(found, k * CHUNK + 1, CHUNK))
    listed = F.aggregate(chunks, empty, chunk, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast(f"array<{kind}>"))


#: Bits of a packed count, counts in a whole number.
WIDTH, PACK = 5, 12


def lowest_weight(candidate: Column) -> Column:
    """The least sum of weights of the candidate's windows, by counts that change a character at a time."""
    new = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.arrays_zip(new.alias("new"), F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(new, 1, F.greatest(F.size(new) - WINDOW, F.lit(0)))).alias("old"))
    table = F.array(*[F.lit(weight(c)).cast("long") for c in range(WINDOW + 2)])
    of = lambda c: F.element_at(table, c + 1)
    cell = lambda code: F.floor(code / PACK).cast("int")
    shift = lambda code: (code % PACK * WIDTH).cast("int")
    unit = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))
    count = lambda acc, code: F.call_function("shiftright", F.element_at(acc["counts"], cell(code) + 1), shift(code)).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PACK)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(2**62).alias("least"))

    def step(acc: Column, x: Column) -> Column:
        i, come, gone = acc["i"] + 1, x["new"], F.greatest(x["old"], F.lit(0))
        leaves = (x["old"] >= 0) & (x["old"] != come)
        enters = x["old"] != come  # else the counts stay
        n_come, n_gone = count(acc, come), count(acc, gone)
        total = acc["sum"] + F.when(enters, of(n_come + 1) - of(n_come)).otherwise(F.lit(0)) + F.when(leaves, of(F.greatest(n_gone - 1, F.lit(0))) - of(n_gone)).otherwise(F.lit(0))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(enters & (j == cell(come)), unit(come)).otherwise(F.lit(0)) - F.when(leaves & (j == cell(gone)), unit(gone)).otherwise(F.lit(0)))
        least = F.when(i >= WINDOW, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(i.alias("i"), counts.alias("counts"), total.alias("sum"), least.alias("least"))

    return F.aggregate(pairs, start, step, lambda acc: acc["least"])


def random_enough(candidate: Column) -> Column:
    """Whether a window has the bits of the candidate's class; strings of digits alone have no class."""
    digit, letter = candidate.rlike("[0-9]"), candidate.rlike("[A-Za-z]")
    limit = (
        F.when(~letter, F.lit(-1))
        .when(candidate.rlike("^[0-9A-Fa-f]+$"), F.lit(most(BITS["hex"])))
        .when(digit, F.lit(most(BITS["mixed"])))
        .when(candidate.rlike("[a-z]") & candidate.rlike("[A-Z][a-z]*[A-Z]"), F.lit(most(BITS["letters"])))
        .otherwise(F.lit(-1))
    )
    return F.when(limit < 0, F.lit(False)).otherwise(lowest_weight(candidate) <= limit)


def blanked(text: Column, spans: Column) -> Column:
    """The text with spans, sorted by start, made spaces: places stay."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        low = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, low - acc["at"]), F.repeat(F.lit(" "), s["end"] - low))
        return F.when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(acc)

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _kind(name: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("rank"), s["end"].alias("end"), F.lit(name).alias("kind")))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with spans: array of (start, rank, end, kind), by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _kind("assign", F.filter(places(text, ASSIGN, group=1), lambda s: F.length(s["found"]) >= 12)),
        _kind("access", places(text, ACCESS)),
        _kind("hex", places(text, HEX)),
    )
    rest = [c for c in docs.columns if c.lower() != "spans"]
    inner = [F.col(c) for c in rest]
    rows = docs.select(*inner, F.array_sort(base).alias("spans"))
    # texts without a candidate are done; in the others, what is known goes before candidates are sought
    left = F.when(text.rlike(CANDIDATE), blanked(text, F.col("spans"))).otherwise(F.lit(""))
    known = F.when(F.col(_LEFT).rlike(CANDIDATE), blanked(F.col(_LEFT), places(F.col(_LEFT), ALLOWED))).otherwise(F.lit(""))
    rows = rows.withColumn(_LEFT, left).withColumn(_LEFT, known).withColumn(_LEFT, places(F.col(_LEFT), CANDIDATE))
    added = _kind("entropy", F.filter(F.col(_LEFT), lambda s: random_enough(s["found"])))
    return rows.select(*inner, F.when(F.size(_LEFT) > 0, F.array_sort(F.concat("spans", added))).otherwise(F.col("spans")).alias("spans"))


#: A name of its own for what is left of a text.
_LEFT = "__docweave_secrets_left"


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], apart).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
