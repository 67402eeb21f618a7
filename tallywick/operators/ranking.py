"""Ranks, pages, picks per group and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.session import Scratch


#: Value ranges in which prefix sums are taken.
VALUE_RANGES = 64


def tied_rank(df: DataFrame, value: str, name: str = "rank", wide: bool = False, cuts: int = 64) -> DataFrame:
    """Competition rank (1, 2, 2, 4) by value, descending (O-69).

    Rows meet only a histogram of the distinct values. That histogram is ranked in one window where
    distinct values are few (counts, years); `wide` is for metrics with as many values as rows:
    the histogram is cut into value ranges, ranked inside them, and offset by the ranges above.
    """
    if wide:  # read by the cuts, the histogram and the join: computed once
        df = Scratch(df.sparkSession, "ranked").save(df, "rows")
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    better = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    if not wide:
        ranks = counts.select(value, (F.coalesce(F.sum("n").over(better), F.lit(0)) + 1).alias(name))
        return df.join(ranks, value)
    edges = sorted(set(df.approxQuantile(value, [i / cuts for i in range(1, cuts)], 0.005)))
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    banded = counts.withColumn("band", band)
    above = banded.groupBy("band").agg(F.sum("n").alias("m"))
    above = above.select("band", F.coalesce(F.sum("m").over(Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = Window.partitionBy("band").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = banded.join(above, "band").select(value, (F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("above") + 1).alias(name))
    return df.join(ranks, value)


def rank_by(df: DataFrame, value: str, qualifies: Column, wide: bool = False) -> DataFrame:
    """Qualifying rows with their tied rank (O-70 to O-72)."""
    return tied_rank(df.filter(qualifies), value, wide=wide)


def page_slice(df: DataFrame, order: list[Column], page: float, per_page: int) -> DataFrame:
    """One page in a total order, with the exact total and number of pages on each row (O-66).

    Pages start at 1; smaller and fractional numbers are brought to a whole page of at least 1.
    """
    page = max(1, int(page // 1))
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("long")
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", pages)


def after_key(df: DataFrame, key: str, last: object, per_page: int) -> DataFrame:
    """The next page after a key: deep paging without skipping rows."""
    return df.filter(F.col(key) > F.lit(last)).orderBy(key).limit(per_page)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The k first rows of every group in a total order; Spark limits groups before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn")


def top_k_then_n(df: DataFrame, group: list[str], order: list[Column], k: int, n: int) -> DataFrame:
    """k per group, then n of all (O-77)."""
    return first_per_group(df, group, order, k).orderBy(*order).limit(n)


def latest_by_group_season(careers: DataFrame, dimension: DataFrame, group: str, entity: str, seasons: dict[str, tuple[str, str]]) -> DataFrame:
    """Per group and season the entity with the latest year, then most appearances, then least key (O-75).

    seasons: name -> (column of the last year, column of the count). Groups without one keep nulls.
    """
    out = dimension
    for name, (year, count) in seasons.items():
        pick = F.max_by(F.struct(F.col(entity).alias("entity"), F.col(year).alias("year")), F.struct(F.col(year), F.col(count), -F.col(entity)))
        out = out.join(careers.filter(F.col(year).isNotNull()).groupBy(group).agg(pick.alias(name)), group, "left")
    return out


def latest_season_slice(games: DataFrame, group: str, season: str, date: str, key: str, limit: int, label: str) -> DataFrame:
    """Rows of the season of each group's newest date, newest first, with totals and labels (O-78)."""
    newest = games.groupBy(group).agg(F.max_by(season, F.struct(date, key)).alias(season))
    rows = games.join(newest, [group, season], "left_semi")
    totals = rows.groupBy(group).agg(F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"))
    return first_per_group(rows, [group], [F.col(date).desc(), F.col(key).desc()], limit).join(totals, group)


def consecutive_runs(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of equal values in the given order (O-79): run number, value, length, first and last key."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = df.withColumn("__new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    numbered = changed.withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(*partition, "run", value).agg(F.count("*").alias("n"), F.min(order[-1]).alias("first_key"), F.max(order[-1]).alias("last_key"))


def recency_key(month: Column, day: Column, order: Column) -> Column:
    """One number to sort dates without a year (O-80)."""
    return (month * 100 + day) * 100 + F.coalesce(order, F.lit(0))


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows that depend on the seed and keys alone (O-81)."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def quantile_bands(df: DataFrame, value: str, steps: int) -> DataFrame:
    """Band number of every row: 0 for values that are not positive (O-82).

    With at most `steps` distinct positive values each is a band; otherwise bands begin at the
    distinct values found at sorted place floor(n * i / steps), i = 0, 1, ...
    """
    scratch = Scratch(df.sparkSession, "bands")
    counts = scratch.save(df.filter(F.col(value) > 0).groupBy(F.col(value).alias("low")).agg(F.count("*").alias("rows")), "counts")
    if counts.limit(steps + 1).count() <= steps:
        cut = counts.select("low")
    else:
        # prefix sums by value range: only the ranges that hold a wanted place are sorted, each on its own
        edges = sorted(set(counts.approxQuantile("low", [i / VALUE_RANGES for i in range(1, VALUE_RANGES)], 0.25 / VALUE_RANGES)))
        above = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("low")))
        banded = counts.withColumn("range", above)
        totals = banded.groupBy("range").agg(F.sum("rows").alias("held"))
        upto = F.sum("held").over(Window.orderBy("range"))
        totals = totals.select("range", (upto - F.col("held")).alias("from"), upto.alias("to"), F.sum("held").over(Window.partitionBy()).alias("all"))
        places = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.floor(F.col("all") * i / F.lit(steps)))
        here = F.filter(places, lambda at: (at >= F.col("from")) & (at < F.col("to")))
        wanted = totals.withColumn("here", here).filter(F.size("here") > 0).select("range", "from", "here")
        end = F.col("from") + F.sum("rows").over(Window.partitionBy("range").orderBy("low"))
        found = banded.join(wanted, "range").withColumn("end", end)
        cut = found.filter(F.exists("here", lambda at: (at >= F.col("end") - F.col("rows")) & (at < F.col("end")))).select("low")
    # at most `steps` cuts: one small array beside every row
    cuts = cut.agg(F.sort_array(F.collect_list("low")).alias("cuts"))
    band = F.when(F.col(value) > 0, F.size(F.filter("cuts", lambda c: c <= F.col(value)))).otherwise(0)
    return df.crossJoin(F.broadcast(cuts)).withColumn("band", band.cast("int")).drop("cuts")


def freshest(primary: DataFrame, other: DataFrame, date: str, names: tuple[str, str]) -> DataFrame:
    """Which of two streams is fresher: later last date; ties to the primary; missing to the other (O-84)."""
    a, b = primary.agg(F.max(date).alias("a")), other.agg(F.max(date).alias("b"))
    pick = F.when(F.col("a").isNull() & F.col("b").isNull(), F.lit(None)).when(F.col("b").isNull() | (F.col("a") >= F.col("b")), names[0]).otherwise(names[1])
    return a.crossJoin(b).select(pick.alias("source"), F.greatest("a", "b").alias("date"))
