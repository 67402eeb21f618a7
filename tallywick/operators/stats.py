"""Career, period and district statistics over appearance facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.operators.ladder import best_of, ladder_ordinal


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def career_stats(facts: DataFrame, visible: DataFrame, entity: str, ladder: list[str], seasons: list[str], berths: DataFrame | None = None) -> DataFrame:
    """Per visible entity: counts, wins, losses, win rate, years, best results, titles (O-50 to O-53).

    facts: entity, year, season, result, wins, losses. Only spring and summer count. A null result is
    an appearance with unknown outcome, never a loss; null wins and losses add nothing; the rate is
    null without games. berths (entity, year) are listed as ascending years.
    """
    rows = facts.filter(F.col("season").isin("spring", "summer")).join(visible.select(entity).distinct(), entity, "left_semi")
    place = ladder_ordinal(F.col("result"), ladder)
    spring, summer = F.col("season") == "spring", F.col("season") == "summer"
    best = {"best": None, "best_spring": spring, "best_summer": summer}
    out = rows.groupBy(entity).agg(
        F.count_if(spring).alias("spring"),
        F.count_if(summer).alias("summer"),
        F.count("*").alias("total"),
        F.sum(_zero("wins")).alias("wins"),
        F.sum(_zero("losses")).alias("losses"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.max(F.when(spring, F.col("year"))).alias("last_spring"),
        F.max(F.when(summer, F.col("year"))).alias("last_summer"),
        F.count_if(place == 0).alias("titles"),
        F.count_if(place == 1).alias("runner_ups"),
        F.count_if(place <= 2).alias("final_fours"),
        *(best_of(F.col("result"), F.col("year"), F.col("season"), ladder, seasons, only=only).alias(name) for name, only in best.items()),
    )
    games = F.col("wins") + F.col("losses")
    out = out.withColumn("win_rate", F.when(games > 0, F.col("wins").cast("double") / games.cast("double")))
    if berths is not None:
        years = berths.groupBy(entity).agg(F.sort_array(F.collect_set("year")).alias("berth_years"))
        out = out.join(years, entity, "left").withColumn("berth_years", F.coalesce("berth_years", F.array().cast("array<int>")))
    return out


def appearance_counts(entities: DataFrame, facts: DataFrame, entity: str) -> DataFrame:
    """Stored counters per entity, zero where there is none; the last year is over all seasons (O-54)."""
    agg = facts.groupBy(entity).agg(F.count_if(F.col("season") == "spring").alias("spring"), F.count_if(F.col("season") == "summer").alias("summer"), F.max("year").alias("last_year"))
    return entities.select(entity).join(agg, entity, "left").select(entity, _zero("spring").alias("spring"), _zero("summer").alias("summer"), (_zero("spring") + _zero("summer")).alias("total"), "last_year")


def zero_filled(dimension: DataFrame, counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every row of the dimension with its aggregates, zero where none (O-38)."""
    return dimension.join(counts, keys, "left").select(*dimension.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns))


def category_counts(dimension: DataFrame, children: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Children per category with zero rows (O-55)."""
    return zero_filled(dimension, children.groupBy(*keys).agg(F.count("*").alias(name)), keys, [name])


def period_shares(facts: DataFrame, totals: DataFrame, keys: list[str], total: str = "total") -> DataFrame:
    """Participants per period, the period's total and the share; unknown or empty totals drop (O-39, O-56)."""
    counts = facts.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = counts.join(totals.select(*keys, total), keys, "left")
    return joined.filter(F.col(total) > 0).withColumn("share", F.col("n").cast("double") / F.col(total).cast("double"))


def decade_rollup(periods: DataFrame, year: str, number: str, total: str) -> DataFrame:
    """Sums per decade; periods without a total count on neither side (O-57)."""
    decade = (F.floor(F.col(year) / 10) * 10).cast("int").alias("decade")
    out = periods.filter(F.col(total).isNotNull()).groupBy(decade).agg(F.sum(number).alias("n"), F.sum(total).alias("total"), F.count("*").alias("periods"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.col("n").cast("double") / F.col("total").cast("double")))


def district_rollup(careers: DataFrame, dimension: DataFrame, district: str, ladder: list[str], seasons: list[str]) -> DataFrame:
    """Second-level aggregation of careers per district, all districts kept (O-58)."""
    b = F.col("best")
    agg = careers.groupBy(district).agg(
        F.count("*").alias("entities"), *(F.sum(c).alias(c) for c in ("total", "spring", "summer", "wins", "titles")),
        best_of(b["result"], b["year"], b["season"], ladder, seasons).alias("best"), F.max("last_year").alias("last_year"),
    )
    sums = ("entities", "total", "spring", "summer", "wins", "titles")
    return dimension.join(agg, district, "left").select(*dimension.columns, *(_zero(c).alias(c) for c in sums), "best", "last_year")


def stage_groups(careers: DataFrame, entity: str) -> DataFrame:
    """Entities by best stage, in order of total (descending) and key; unknown bests are left out (O-59)."""
    known = careers.filter(F.col("best").isNotNull())
    members = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), F.col(entity).alias("e")))), lambda x: x["e"])
    return known.groupBy(F.col("best.result").alias("stage")).agg(F.count("*").alias("n"), members.alias("members"))


def summary_tiles(careers: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of totals (O-60)."""
    a = careers.agg(F.count("*").alias("entities"), F.sum("total").alias("appearances"), F.count_if(F.col("titles") > 0).alias("champions"), F.count_if(F.col("best").isNull()).alias("unknown"), F.max("last_year").alias("latest"))
    return a.crossJoin(facts.agg(F.count_distinct("year").alias("years")))


def latest_coverage(latest: DataFrame, seasons: list[str]) -> DataFrame:
    """How many groups' latest year is the data's latest, per season column and in any (O-61)."""
    top = F.greatest(*(F.max(s) for s in seasons))
    newest = latest.agg(top.alias("newest"))
    rows = latest.crossJoin(F.broadcast(newest))
    hits = [F.coalesce(F.col(s) == F.col("newest"), F.lit(False)) for s in seasons]
    both = hits[0]
    for h in hits[1:]:
        both = both | h
    return rows.agg(F.max("newest").alias("newest"), *(F.count_if(h).alias(f"in_{s}") for h, s in zip(hits, seasons, strict=True)), F.count_if(both).alias("in_any"))


def vote_percent(options: DataFrame, poll: str, votes: str) -> DataFrame:
    """Whole percents per option, halves up; 0 where a poll has no votes (O-62)."""
    totals = options.groupBy(poll).agg(F.sum(votes).alias("poll_votes"))
    share = F.floor(F.col(votes) * F.lit(100.0) / F.col("poll_votes") + F.lit(0.5)).cast("long")
    return options.join(totals, poll).withColumn("percent", F.when(F.col("poll_votes") > 0, share).otherwise(F.lit(0).cast("long")))


def run_summary(games: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Games, wins and draws of a run (O-63)."""
    return games.groupBy(*key).agg(F.count("*").alias("games"), F.count_if(F.col(outcome) == "win").alias("wins"), F.count_if(F.col(outcome) == "draw").alias("draws"))


def berth_lookup(berths: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Berths with the result of the appearance of the same key, null where none (O-49)."""
    return berths.join(facts.select(*keys, "result"), keys, "left")


def berth_rollup(berths: DataFrame, dimension: DataFrame, district: str, ladder: list[str]) -> DataFrame:
    """Berths per district and the best result among them (O-64)."""
    agg = berths.groupBy(district).agg(F.count("*").alias("berths"), F.min_by("result", F.when(F.col("result").isNotNull(), ladder_ordinal(F.col("result"), ladder))).alias("best_result"))
    return dimension.join(agg, district, "left").withColumn("berths", _zero("berths"))


def tournament_summary(games: DataFrame, key: list[str], winner: str = "winner", loser: str = "loser") -> DataFrame:
    """Entries and games per tournament (O-65)."""
    sides = games.select(*key, F.explode(F.array(winner, loser)).alias("team"))
    entries = sides.groupBy(*key).agg(F.count_distinct("team").alias("entries"))
    return games.groupBy(*key).agg(F.count("*").alias("games")).join(entries, key)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
