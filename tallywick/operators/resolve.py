"""Conservative entity resolution: a name is matched only where exactly one master row answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_match(rows: DataFrame, key: str, candidates: Column, master: DataFrame, label: str, target: str) -> DataFrame:
    """The first candidate spelling that exists in the master wins (O-40): key, target, place, label."""
    every = rows.select(key, F.posexplode(candidates).alias("place", label)).filter(F.col(label).isNotNull() & (F.col(label) != ""))
    hits = every.join(master.select(label, target), label)
    return hits.groupBy(key).agg(F.min(F.struct("place", target, label)).alias("m")).select(key, "m.*")


def confirmed_map(table: DataFrame, source: str, target: str, confirmed: str) -> DataFrame:
    """Confirmed from-to pairs of a lookup table (O-04)."""
    return table.filter(F.coalesce(F.col(confirmed), F.lit(False)) & F.col(target).isNotNull()).select(source, target)


def rewrite_successors(rows: DataFrame, name: str, successors: DataFrame, source: str, target: str) -> DataFrame:
    """Names replaced by their successors, the former name kept as a note (O-41)."""
    out = rows.join(successors.select(F.col(source).alias(name), F.col(target).alias("__new")), name, "left")
    return out.withColumn("former", F.when(F.col("__new").isNotNull(), F.col(name))).withColumn(name, F.coalesce("__new", name)).drop("__new")


def label_index(labels: DataFrame, scope: list[str], label: str, target: str) -> DataFrame:
    """Hits per label within the scope: their number, and the target where it is the only one."""
    found = labels.groupBy(*scope, label).agg(F.count_distinct(target).alias("hits"), F.min(target).alias("__only"))
    return found.select(*scope, label, "hits", F.when(F.col("hits") == 1, F.col("__only")).alias(target))


def scoped_unique_match(rows: DataFrame, labels: DataFrame, scope: str, label: str, target: str) -> DataFrame:
    """Two-tier match (O-42): labels of the scope first; labels of all scopes where it has none. Only
    a single hit is accepted; hits tells how many there were."""
    near = label_index(labels, [scope], label, target).select(scope, label, F.col("hits").alias("__near"), F.col(target).alias("__t1"))
    wide = label_index(labels, [], label, target).select(label, F.col("hits").alias("__wide"), F.col(target).alias("__t2"))
    out = rows.join(near, [scope, label], "left").join(wide, label, "left")
    local = F.col("__near").isNotNull()
    return out.select(*rows.columns, F.when(local, F.col("__t1")).otherwise(F.col("__t2")).alias(target), F.coalesce("__near", "__wide", F.lit(0)).alias("hits"))


def ambiguous(matched: DataFrame) -> DataFrame:
    """Rows whose label has more than one hit (Q-09)."""
    return matched.filter("hits > 1")


def add_weak_labels(strong: DataFrame, weak: DataFrame, scope: str, label: str, target: str) -> DataFrame:
    """Weak labels join a scope only where the label is free there; ties go to the least target (O-43)."""
    free = weak.join(strong.select(scope, label), [scope, label], "left_anti")
    first = Window.partitionBy(scope, label).orderBy(target)
    chosen = free.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1")
    return strong.select(scope, label, target).unionByName(chosen.select(scope, label, target))


def add_aliases(labels: DataFrame, aliases: DataFrame, masters: DataFrame, scope: str, label: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Manual aliases appended where the label is free; the second table reports unknown targets (O-44)."""
    sound = aliases.join(masters.select(target), target, "left_semi")
    free = sound.join(labels.select(scope, label), [scope, label], "left_anti").select(scope, label, target)
    return labels.select(scope, label, target).unionByName(free), aliases.join(masters.select(target), target, "left_anti")


def second_chance(rows: DataFrame, matched: DataFrame, participants: DataFrame, event: list[str], name: str, article: str, target: str) -> DataFrame:
    """Unmatched rows look up another spelling among the participants of the same event (O-45).

    matched: rows with a nullable target. participants: event, name, article, target; a name shared by
    several participants of an event is no evidence.
    """
    other = participants.groupBy(*event, name).agg(F.count_distinct(target).alias("__n"), F.min(target).alias("__t")).filter("__n = 1").drop("__n")
    out = matched.join(other, [*event, name], "left")
    return out.withColumn("via", F.when(F.col(target).isNotNull(), "direct").when(F.col("__t").isNotNull(), "event")).withColumn(target, F.coalesce(target, "__t")).drop("__t")


def mutual_references(candidates: DataFrame, documents: DataFrame, master: DataFrame, source: str, target: str, text: str, redirect: str) -> DataFrame:
    """Confirm successors by references in both directions (O-46).

    candidates: source, target, redirect flag. A redirect into the master is confirmed; otherwise a
    source with exactly one candidate whose text mentions it back is; the rest are pending.
    """
    known = candidates.join(master.select(target), target, "left_semi")
    back = known.join(documents.select(F.col(target), F.col(text)), target).filter(F.expr(f"instr({text}, {source}) > 0"))
    redirected = known.filter(redirect).groupBy(source).agg(F.min(target).alias("__r"))
    mutual = back.groupBy(source).agg(F.sort_array(F.collect_set(target)).alias("mutual"))
    every = candidates.select(source).distinct().join(redirected, source, "left").join(mutual, source, "left")
    sole = F.when(F.size("mutual") == 1, F.col("mutual")[0])
    return every.select(source, F.coalesce("__r", sole).alias(target), F.when(F.col("__r").isNotNull(), "redirect").when(sole.isNotNull(), "mutual").otherwise("pending").alias("how"), F.coalesce(F.size("mutual"), F.lit(0)).alias("n_mutual"))


def unmatched_both_ways(rows: DataFrame, master: DataFrame, key: str, public_pattern: str, label: str) -> DataFrame:
    """Source keys without a master row (with counts and a flag by pattern) and masters without a row (O-47)."""
    lost = rows.join(master.select(key), key, "left_anti").groupBy(key, label).agg(F.count("*").alias("n"))
    lost = lost.select(F.lit("source").alias("side"), key, "n", F.col(label).rlike(public_pattern).alias("looks_public"))
    idle = master.join(rows.select(key), key, "left_anti").select(F.lit("master").alias("side"), key, F.lit(0).cast("long").alias("n"), F.lit(None).cast("boolean").alias("looks_public"))
    return lost.unionByName(idle)


def roster_members(entries: DataFrame, key: str, forms: Column, roster: DataFrame, label: str, endings: list[str]) -> DataFrame:
    """Membership by ordered candidate forms, or by a roster label that is a form and one of the
    completing characters more (O-48): key, label, how. Both are equi-joins."""
    every = entries.select(key, F.posexplode(forms).alias("place", label)).filter(F.length(label) > 0)
    exact = every.join(roster.select(label), label).select(key, "place", label, F.lit("form").alias("how"))
    cut = roster.filter(F.substring(label, -1, 1).isin(endings)).select(F.col(label).alias("__whole"), F.expr(f"substring({label}, 1, length({label}) - 1)").alias(label))
    completed = every.join(cut, label).select(key, (F.col("place") + 1000).alias("place"), F.col("__whole").alias(label), F.lit("completed").alias("how"))
    return exact.unionByName(completed).groupBy(key).agg(F.min(F.struct("place", label, "how")).alias("m")).select(key, f"m.{label}", "m.how")
