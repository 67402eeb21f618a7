"""Ordinals of labels that have an order of their own, and reducers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, MISSING = 2**31 - 2, 2**31 - 1


def ladder_ordinal(label: Column, ladder: list[str]) -> Column:
    """Place in the ladder, 0 best; an unknown label is second to last and null is last."""
    places = F.map_from_arrays(F.array(*map(F.lit, ladder)), F.array(*(F.lit(i) for i in range(len(ladder)))))
    return F.when(label.isNull(), F.lit(MISSING)).otherwise(F.coalesce(F.try_element_at(places, label), F.lit(UNKNOWN)))


def best_of(label: Column, year: Column, season: Column, ladder: list[str], seasons: list[str], prefer_year: bool = True, only: Column | None = None) -> Column:
    """Aggregate: the best (result, year, season); equal stages by later year, then earlier season.

    Rows without a label never win; with `only`, just the rows that meet it count.
    """
    counts = label.isNotNull() if only is None else label.isNotNull() & only
    order = F.struct(ladder_ordinal(label, ladder), -year if prefer_year else F.lit(0), ladder_ordinal(season, seasons))
    return F.min_by(F.struct(label.alias("result"), year.alias("year"), season.alias("season")), F.when(counts, order))
