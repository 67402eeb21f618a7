"""Audits: each returns a table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.operators.ranking import first_per_group


def stated_counts(facts: DataFrame, keys: list[str], year: str, note: str, pattern: str) -> DataFrame:
    """The ordinal stated on the latest row against the counted rows, where they differ (Q-01)."""
    agg = facts.groupBy(*keys).agg(F.max_by(note, year).alias("latest"), F.count("*").alias("counted"))
    stated = F.expr("try_cast(nullif(regexp_extract(latest, pattern, 1), '') as bigint)".replace("pattern", f"r'{pattern}'"))
    return agg.withColumn("stated", stated).filter("stated is not null and stated <> counted").drop("latest")


def knockout_invariant(results: DataFrame, champion: str, excluded: Column) -> DataFrame:
    """Entries whose losses are not 0 for the champion and 1 for the others (Q-02)."""
    want = F.when(F.col("result") == champion, 0).otherwise(1)
    known = F.col("result").isNotNull() & F.col("losses").isNotNull() & ~excluded
    return results.filter(known & (F.col("losses") != want)).withColumn("expected_losses", want)


def tail_rounds(games: DataFrame, labels: dict[str, int], partial: DataFrame) -> DataFrame:
    """Tail rounds that are present with another number of games than they must have (Q-03).

    labels: round label -> games. Partial sources are excused for too few, never for too many.
    """
    counts = games.filter(F.col("label").isin(list(labels))).groupBy("tournament", "label").agg(F.count("*").alias("n"))
    want = F.lit(None).cast("int")
    for label, n in labels.items():
        want = F.when(F.col("label") == label, n).otherwise(want)
    rows = counts.withColumn("expected", want).join(partial.select("tournament").distinct().withColumn("__p", F.lit(True)), "tournament", "left")
    finding = F.when(F.col("n") > F.col("expected"), "too many").when((F.col("n") < F.col("expected")) & F.col("__p").isNull(), "too few")
    return rows.select("tournament", "label", "n", "expected", finding.alias("finding")).filter("finding is not null")


def game_shortfall(entries: DataFrame, games: DataFrame, key: str = "tournament") -> DataFrame:
    """Tournaments with fewer games than participants - 1; without games they do not count (Q-04)."""
    e, g = entries.groupBy(key).agg(F.count("*").alias("entries")), games.groupBy(key).agg(F.count("*").alias("games"))
    return e.join(g, key).withColumn("missing", F.col("entries") - 1 - F.col("games")).filter("missing > 0")


def strangers(games: DataFrame, entries: DataFrame) -> DataFrame:
    """Sides of games that are not among the entries (Q-05)."""
    sides = games.select("tournament", F.explode(F.array("winner", "loser")).alias("team"))
    return sides.join(entries.select("tournament", "team"), ["tournament", "team"], "left_anti").groupBy("tournament", "team").agg(F.count("*").alias("games"))


def berths_without_facts(berths: DataFrame, facts: DataFrame, keys: list[str], excused: Column) -> DataFrame:
    """Berths that no appearance answers, cancelled periods excused (Q-06)."""
    return berths.filter(~excused).join(facts.select(*keys), keys, "left_anti")


def repair_plan(facts: DataFrame, parsed: DataFrame, keys: list[str], in_progress: Column) -> DataFrame:
    """Rows with an unknown result: fillable, in progress or unresolved (Q-07)."""
    found = parsed.filter("result is not null").select(*keys, F.col("result").alias("parsed"))
    rows = facts.filter("result is null").join(found, keys, "left")
    how = F.when(F.col("parsed").isNotNull(), "fillable").when(in_progress, "in progress").otherwise("unresolved")
    return rows.select(*keys, "parsed", how.alias("plan"))


def expected_counts(actual: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """One row per label: actual count, expected count and whether they agree (O-85, Q-08)."""
    parts = [df.agg(F.count("*").alias("actual")).select(F.lit(k).alias("label"), "actual", F.lit(expected.get(k)).cast("long").alias("expected")) for k, df in actual.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row per broken rule; an unknown outcome breaks it (Q-10)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


def shared_values(df: DataFrame, value: str, entity: str, tests: dict[str, Column]) -> DataFrame:
    """Rows with why they are excluded: a failed named test, or a value of two or more entities (O-87c)."""
    shared = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(entity).alias("__n")).filter("__n > 1")
    out = df.join(shared, value, "left")
    why = F.when(F.col("__n").isNotNull(), "shared")
    for name, ok in reversed(tests.items()):
        why = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(why)
    return out.withColumn("excluded", why).drop("__n")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in ingest order; nulls in keys are equal (O-86)."""
    return first_per_group(df, keys, [F.col(c) for c in order])


def decisive_games(games: DataFrame, a: str, b: str, score_a: str, score_b: str, keys: list[str]) -> DataFrame:
    """Winner and loser once per key; ties and scores that are no numbers drop (O-87)."""
    x, y = F.expr(f"try_cast({score_a} as int)"), F.expr(f"try_cast({score_b} as int)")
    sides = games.withColumn("__x", x).withColumn("__y", y).filter("__x is not null and __y is not null and __x <> __y")
    won = F.col("__x") > F.col("__y")
    return sides.select(*keys, F.when(won, F.col(a)).otherwise(F.col(b)).alias("winner"), F.when(won, F.col(b)).otherwise(F.col(a)).alias("loser")).distinct()
