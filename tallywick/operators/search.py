"""Projections, lookups, substring search, facets and intervals."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_pattern(text: str) -> str:
    """A LIKE pattern for a literal substring; the metacharacters of the text are escaped."""
    return "%" + "".join("\\" + c if c in "\\%_" else c for c in text) + "%"


def normal_query(text: str | None, longest: int = 60) -> str:
    return (text or "").strip()[:longest].strip()


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns (O-18, O-19)."""
    pattern = like_pattern(text)
    return reduce(or_, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns))


def search(df: DataFrame, columns: list[str], text: str, order: list[Column], limit: int) -> DataFrame:
    """Matching rows in order; an empty query matches nothing (O-19)."""
    text = normal_query(text)
    rows = df.filter(contains_any(columns, text)) if text else df.filter(F.lit(False))
    return rows.orderBy(*order).limit(limit)


def faceted(df: DataFrame, keyword: tuple[list[str], str] | None = None, **facets: object) -> DataFrame:
    """Conjunction of the facets that are set: keyword substring and equality per column (O-21 to O-23)."""
    tests = [F.col(c) == F.lit(v) for c, v in facets.items() if v is not None]
    if keyword and normal_query(keyword[1]):
        tests.append(contains_any(keyword[0], normal_query(keyword[1])))
    return df.filter(reduce(and_, tests)) if tests else df


def summary(df: DataFrame, renames: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Projection with renames and a default for null per column (O-14)."""
    return df.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(n) if c in defaults else F.col(c).alias(n) for c, n in renames.items()))


def image_ref(url: str, credit: str, source: str) -> Column:
    """Nullable triple to a struct that is null without a URL (O-15)."""
    return F.when(F.col(url).isNotNull(), F.struct(F.col(url).alias("url"), F.col(credit).alias("credit"), F.col(source).alias("source")))


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def ordered_fetch(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows in the caller's order of keys with their place; missing keys drop (O-17)."""
    wanted = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, keys))).alias("place", key))
    return df.join(F.broadcast(wanted), key).orderBy("place")


def equal_or_null(column: str, value: object) -> Column:
    """Rows for one group plus those for all (O-24)."""
    return (F.col(column) == F.lit(value)) | F.col(column).isNull()


def active_at(start: str, end: str, now: Column) -> Column:
    """Open-ended interval with both ends inclusive (O-25)."""
    return (F.col(start).isNull() | (F.col(start) <= now)) & (F.col(end).isNull() | (F.col(end) >= now))


def highlights(df: DataFrame, slot: str, key: str, limit: int) -> DataFrame:
    """Rows with a slot, in slot order (O-26)."""
    return df.filter(F.col(slot).isNotNull()).orderBy(slot, key).limit(limit)


def indexable(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Keys with at least one fact (O-28)."""
    return df.select(key).join(facts.select(key).distinct(), key, "left_semi")


def eligible(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that meet every named test; an unknown outcome is a failure (O-31)."""
    return df.filter(reduce(and_, (F.coalesce(t, F.lit(False)) for t in tests.values())))


def reason(tests: dict[str, Column]) -> Column:
    """The first named test that a row fails, or null (O-133)."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(F.coalesce(test, F.lit(False)), out).otherwise(F.lit(name))
    return out
