"""Snapshots of a table after an upsert: files have no row updates, so each returns the new whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def do_update(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of their key (O-11a)."""
    return base.join(new.select(*keys), keys, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def do_nothing(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows only where the key is free (O-11b, O-11e)."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def fill_nulls(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only what is null is filled from the new rows (O-11c)."""
    fresh = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return base.join(fresh, keys, "left").select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in base.columns))


def clear_then_set(base: DataFrame, new: DataFrame, keys: list[str], column: str, stale: Column) -> DataFrame:
    """Stale values are cleared first, then the new ones set (O-11d)."""
    cleared = base.withColumn(column, F.when(~F.coalesce(stale, F.lit(False)), F.col(column)))
    out = cleared.join(new.select(*keys, F.col(column).alias("__new")), keys, "left")
    return out.withColumn(column, F.coalesce("__new", column)).select(base.columns)


def delete_cascade(parent: DataFrame, gone: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without the deleted keys, and every child table without theirs (O-11f)."""
    kept = parent.join(gone.select(key), key, "left_anti").select(parent.columns)
    return kept, [c.join(gone.select(F.col(key).alias(k)), k, "left_anti").select(c.columns) for c, k in children]
