"""Writes as functions from old and new rows to the result, which a sink then stores: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows but those whose keys are among the new, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and those new ones whose keys are not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def updated(rows: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values in those for which the condition holds."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def patched(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those values of the new ones of their keys that aren't null."""
    names = [c for c in new.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in names])
    return old.join(fresh, keys, "left").select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def deleted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def replaced_partition(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Delete and insert again by one column: the new rows' values of it lose all their old rows."""
    return upserted(old, new, [part])
