"""Answers of models that should be a JSON array of memories: fences stripped, items checked one by one, bad ones counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a memory that have to be there, and what the others are without a value.
REQUIRED = ("title", "summary", "content")
DEFAULTS = {"importance": 0.5, "confidence": 0.5}
CATEGORY = "general"
_WHITE = " \t\n\x0b\x0c\r"


def unfenced(raw: Column) -> Column:
    """The answer without the line that opens a code fence and what follows the last fence."""
    bare = F.btrim(raw, F.lit(_WHITE))
    inner = F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")
    return F.btrim(F.when(bare.startswith("```"), inner).otherwise(bare), F.lit(_WHITE))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _field(name: str) -> Column:
    return F.try_variant_get("item", f"$.{name}", "variant")


def _share(name: str) -> Column:
    """A number from 0 to 1, or text that is one; the default where the field isn't there; null where it can't be taken."""
    value = F.try_variant_get("item", f"$.{name}", "double")
    good = _kind(_field(name)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING", "BOOLEAN") & value.between(0, 1)
    return F.when(_field(name).isNull(), F.lit(DEFAULTS[name])).when(good, value)


def _objects(name: str) -> Column:
    """Whether the field is an array of objects, or isn't there."""
    all_objects = ~F.exists(F.try_variant_get("item", f"$.{name}", "array<variant>"), lambda v: F.coalesce(_kind(v) != "OBJECT", F.lit(True)))
    return _field(name).isNull() | F.coalesce((_kind(_field(name)) == "ARRAY") & all_objects, F.lit(False))


def memory_items(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, place, state, title, summary, content, importance, confidence, category of every item of every answer.

    state: kept; skipped, if should_remember says no; bad, if it isn't an object or a field is missing or of a wrong kind.
    An answer that is empty, no JSON or no array has no items (see `counted`).
    """
    parsed = answers.select(key, F.try_parse_json(unfenced(F.col(raw))).alias("v"))
    items = parsed.select(key, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("place", "item"))
    remember = _field("should_remember")
    falsy = F.when(remember.isNull(), F.lit(False)).when(F.is_variant_null(remember), F.lit(True)).otherwise(F.to_json(remember).isin("false", "0", "0.0", '""', "[]", "{}"))
    strings = [F.coalesce(_kind(_field(f)) == "STRING", F.lit(False)) for f in REQUIRED]
    good = strings[0] & strings[1] & strings[2] & (_field("category").isNull() | (_kind(_field("category")) == "STRING")) & _objects("entities") & _objects("relationships")
    shares = {name: _share(name) for name in DEFAULTS}
    state = (
        F.when(F.coalesce(_kind(F.col("item")) != "OBJECT", F.lit(True)), "bad").when(falsy, "skipped")
        .when(good & shares["importance"].isNotNull() & shares["confidence"].isNotNull(), "kept").otherwise("bad")
    )
    rows = items.withColumn("state", state)
    kept = lambda c: F.when(F.col("state") == "kept", c)
    texts = [kept(F.try_variant_get("item", f"$.{f}", "string")).alias(f) for f in REQUIRED]
    category = kept(F.coalesce(F.try_variant_get("item", "$.category", "string"), F.lit(CATEGORY))).alias("category")
    return rows.select(key, "place", "state", *texts, *[kept(c).alias(name) for name, c in shares.items()], category)


def counted(answers: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, state, kept, skipped, bad of each answer. state: empty, not json, not a list, or parsed."""
    bare = unfenced(F.col(raw))
    v = F.try_parse_json(bare)
    state = F.when(F.coalesce(bare, F.lit("")) == "", "empty").when(v.isNull(), "not json").when(F.coalesce(_kind(v) != "ARRAY", F.lit(True)), "not a list").otherwise("parsed")
    per = memory_items(answers, key, raw).groupBy(key).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("kept", "skipped", "bad")])
    return answers.select(key, state.alias("state")).join(per, key, "left").na.fill(0, ["kept", "skipped", "bad"])
