"""Places of pattern matches in texts, and folds over long arrays, by built-in functions alone."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a fold gathers at a time: growing a list costs the square of this, not of the array's length.
CHUNK = 256


def gathered(array: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], last: Callable[[Column], Column] | None = None) -> Column:
    """The arrays of `kind` that step(state, element) -> (state, array) gives, one after the other; last(state) gives what follows them."""
    empty = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return F.transform(F.array(own), lambda o: F.struct(o["state"].alias("state"), F.concat(acc["out"], o["out"]).alias("out")))[0]

    def folded(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), (F.greatest(F.size(a) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(a, k * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, F.struct(state.alias("state"), empty.alias("out")), chunk, end)

    end = (lambda acc: acc["out"]) if last is None else (lambda acc: F.concat(acc["out"], last(acc["state"])))
    return F.transform(F.array(array), folded)[0]  # the array is computed once, not for its size and each chunk


def bounded(pattern: str) -> str:
    r"""The pattern with \b as the border of \w, as in SQL engines; Java's \b counts letters such as ü that \w leaves out."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", pattern)


PLACE = "struct<start:int,end:int,found:string>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, found) of each match, in characters from 0; found is the group. The text is cut at the pattern, so that lengths give the places."""
    pattern = bounded(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found")
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))
        return end, F.when(x["match"].isNull(), F.array().cast(f"array<{PLACE}>")).otherwise(found)

    return F.when(text.rlike(pattern), gathered(parts, F.lit(0), PLACE, step)).otherwise(F.array().cast(f"array<{PLACE}>"))


def around(text: Column, start: Column, end: Column, margin: int = 40) -> Column:
    """The match with up to `margin` characters on both sides, dots where the text goes on."""
    low, high = F.greatest(start - margin, F.lit(0)), end + margin
    whole = F.substring(text, low + 1, high - low)
    return F.concat(F.when(low > 0, "...").otherwise(""), whole, F.when(high < F.length(text), "...").otherwise(""))
