"""Visibility, nested embeds, links and siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def published(df: DataFrame, flag: Column) -> DataFrame:
    """Base rows that may be read; an unknown state is not published (O-12)."""
    return df.filter(F.coalesce(flag, F.lit(False)))


def visible_children(child: DataFrame, parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Children whose every parent is visible (O-13). parents: (visible parents, key in child, key in parent)."""
    for parent, mine, theirs in parents:
        child = child.join(parent.select(F.col(theirs).alias(mine)), mine, "left_semi").select(child.columns)
    return child


def embed_one(df: DataFrame, dim: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """The to-one dimension row as a struct; null where the key finds none (O-32)."""
    packed = dim.select(key, F.struct(*columns).alias(name))
    return df.join(packed, key, "left")


def embed_many(parent: DataFrame, child: DataFrame, key: str, order: list[str], columns: list[str], name: str, total: str | None = None) -> DataFrame:
    """Children as an array of structs in child order, empty where none, with an optional sum (O-33)."""
    aggs = [F.sort_array(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias(name)]
    if total:
        aggs.append(F.sum(total).alias(f"{name}_total"))
    nested = child.groupBy(key).agg(*aggs)
    out = parent.join(nested, key, "left")
    out = out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out.withColumn(f"{name}_total", F.coalesce(f"{name}_total", F.lit(0))) if total else out


def main_link(links: DataFrame, key: str, far: str, is_main: Column, order: list[str]) -> DataFrame:
    """Per key the first main link, else the first link, in a total order (O-34)."""
    return links.groupBy(key).agg(F.min_by(far, F.struct((~is_main).cast("int"), *order)).alias(far))


def through_link(near: DataFrame, links: DataFrame, far: DataFrame, near_key: str, far_key: str) -> DataFrame:
    """Near rows through a link table to the far rows that are left (O-35)."""
    return near.join(links, near_key).join(far, far_key)


def siblings(df: DataFrame, group: str, key: str, order: list[Column], k: int) -> DataFrame:
    """For every row its k first others of the same group (O-36).

    The first k + 1 rows of a group hold the first k others of any of its rows, so both the ranking
    and the join see at most k + 1 candidates per group, whatever its size.
    """
    few = df.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rn") <= k + 1)
    few = few.select(group, F.col(key).alias("sibling"), "__rn")
    own = few.select(group, F.col("sibling").alias(key), F.col("__rn").alias("__own"))
    rows = df.select(group, key).join(own, [group, key], "left").join(few, group).filter(F.col("sibling") != F.col(key))
    place = F.col("__rn") - (F.col("__own").isNotNull() & (F.col("__own") < F.col("__rn"))).cast("int")
    return rows.filter(place <= k).select(group, key, "sibling", place.alias("place"))


def two_refs(rows: DataFrame, first: DataFrame, second: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Rows with two optional references attached (O-37)."""
    return rows.join(first, keys[0], "left").join(second, keys[1], "left")
