"""Community events in batch: guards, first-wins votes, saturating counters, rate limits, moderation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.operators.ranking import first_per_group


def unique_presses(events: DataFrame, target: str, visitor: str, order: list[str]) -> DataFrame:
    """The first press per target and visitor (T-01)."""
    return first_per_group(events, [target, visitor], [F.col(c) for c in order])


def saturating_counter(events: DataFrame, key: str, delta: Column, order: list[str]) -> DataFrame:
    """Counter per key that never falls below zero (T-02).

    With S the running sum, the clamped count ends at S - min(0, least S so far): one window per key.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = events.withColumn("__s", F.sum(delta).over(w))
    return sums.groupBy(key).agg(F.max_by("__s", F.struct(*order)).alias("__last"), F.min("__s").alias("__least")).select(key, (F.col("__last") - F.least(F.lit(0), "__least")).alias("n"))


def guard_target(events: DataFrame, published: DataFrame, target: str) -> DataFrame:
    """Events whose target exists and is published (T-03)."""
    return events.join(published.select(target), target, "left_semi").select(events.columns)


def guard_votes(votes: DataFrame, polls: DataFrame, options: DataFrame, poll: str, option: str, ts: str) -> DataFrame:
    """votes with the reason of their rejection, or null (T-04): in this order no poll, not published,
    not started, ended, option of another poll. polls: poll, published, starts, ends."""
    p = polls.select(F.col(poll), F.col("published").alias("__pub"), F.col("starts").alias("__from"), F.col("ends").alias("__to"), F.lit(True).alias("__p"))
    o = options.select(poll, option).distinct().withColumn("__o", F.lit(True))
    rows = votes.join(p, poll, "left").join(o, [poll, option], "left")
    why = (
        F.when(F.col("__p").isNull(), "no poll")
        .when(~F.coalesce("__pub", F.lit(False)), "not published")
        .when(F.col(ts) < F.col("__from"), "not started")
        .when(F.col(ts) > F.col("__to"), "ended")
        .when(F.col("__o").isNull(), "foreign option")
    )
    return rows.select(*votes.columns, why.alias("rejected"))


def accepted_votes(guarded: DataFrame, poll: str, visitor: str, order: list[str]) -> DataFrame:
    """The first accepted vote per poll and visitor; rejected ones do not use up the vote (T-04)."""
    return unique_presses(guarded.filter("rejected is null"), poll, visitor, order)


def message_intake(rows: DataFrame, body: str, name: str, longest: int = 200, longest_name: int = 20) -> DataFrame:
    """Drafts from posted messages (T-05): blanks trimmed before the length is checked, blank bodies
    and overlong ones rejected with a reason, blank names null, status draft, no publish time."""
    text, who = F.btrim(F.coalesce(F.col(body), F.lit("")), F.lit(" ")), F.btrim(F.col(name), F.lit(" "))
    why = F.when(text == "", "blank").when(F.length(text) > longest, "too long").when(F.length(who) > longest_name, "name too long")
    return rows.withColumns({"status": F.lit("draft"), "published_at": F.lit(None).cast("timestamp"), "rejected": why, body: text, name: F.when(who != "", who)})


def gap_segments(events: DataFrame, visitor: str, ts: str, seconds: int, segment: str = "segment") -> DataFrame:
    """events with the number of their segment: a visitor's history is cut wherever `seconds` or more lie
    between two events in succession.

    Events of one time bucket of that length are never cut, so only the buckets' first and last times
    meet in a window; a visitor's events stay dealt as they are.
    """
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))
    rows = events.withColumn("__bucket", bucket)
    edges = rows.groupBy(visitor, "__bucket").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    w = Window.partitionBy(visitor).orderBy("__bucket")
    micros = [F.unix_micros(x.cast("timestamp")) for x in (F.col("__first"), F.lag("__last").over(w))]
    cut = F.coalesce(micros[0] - micros[1] >= seconds * 1_000_000, F.lit(False)).cast("long")
    edges = edges.withColumn("__cut", cut)
    numbered = edges.withColumn(segment, F.sum("__cut").over(w)).select(visitor, "__bucket", segment)
    return rows.join(numbered, [visitor, "__bucket"]).select(*events.columns, segment)


def rate_limit(events: DataFrame, visitor: str, ts: str, key: str, limit: int, seconds: int) -> DataFrame:
    """events with `accepted`: false where the visitor already has `limit` accepted ones newer than
    ts - seconds (T-06). Rows without visitor or time are left out.

    Acceptance feeds back, but not over a gap of `seconds`: each segment between such gaps is on its own,
    so a visitor's history spreads over tasks. A task streams its sorted rows in order of (ts, key) and
    holds `limit` times of one segment, however long it is.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])
    names = events.columns
    window = seconds * 1_000_000

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for frame in frames:
            times = frame[ts].to_numpy("datetime64[us]").astype("int64").tolist()
            verdicts = []
            for who, part, at in zip(frame[visitor].tolist(), frame["__segment"].tolist(), times, strict=True):
                if (who, part) != current:
                    current, recent = (who, part), deque()
                while recent and at - recent[0] >= window:
                    recent.popleft()
                verdicts.append(len(recent) < limit)
                if verdicts[-1]:
                    recent.append(at)
            yield frame[names].assign(accepted=verdicts)

    known = events.filter(F.col(visitor).isNotNull() & F.col(ts).isNotNull())
    parts = gap_segments(known, visitor, ts, seconds, "__segment")
    return parts.repartition(visitor, "__segment").sortWithinPartitions(visitor, "__segment", ts, key).mapInPandas(apply, schema)


def first_published(changes: DataFrame, key: str, status: str, ts: str, order: list[str]) -> DataFrame:
    """Time of the first change to published after another state; stamped once (T-07)."""
    w = Window.partitionBy(key).orderBy(*order)
    was = F.lag(status).over(w)
    return changes.withColumn("__was", was).filter((F.col(status) == "published") & F.col("__was").isNotNull() & (F.col("__was") != "published")).groupBy(key).agg(F.min(ts).alias("published_at"))


def freshness(events: DataFrame, group: str, ts: str) -> DataFrame:
    """Newest event per group and how many days it lies behind the newest of all (T-09)."""
    newest = events.groupBy(group).agg(F.max(ts).alias("newest"))
    top = newest.agg(F.max("newest").alias("top"))
    return newest.crossJoin(F.broadcast(top)).select(group, "newest", F.datediff("top", "newest").alias("days_behind"))
