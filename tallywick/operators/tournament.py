"""Tournament inference from game results: records, champions, depth to the final, stages, brackets.

Games are rows (tournament, ord, winner, loser, round label or null). Pointers are followed by
contraction; each round is a table in the shared folder, so lineage stays short and survives losses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.operators.pointers import REMAINDER, ends_of
from tallywick.session import Scratch


def side_outcomes(sides: DataFrame, game: str, flag: str, score: str, side: str) -> DataFrame:
    """Whether each side won: the source's flag first, else the scores; equal scores win for none (O-89)."""
    w = Window.partitionBy(game)
    other = F.sum(score).over(w) - F.col(score)
    return sides.withColumn("won", F.coalesce(F.col(flag), F.col(score) > other, F.lit(False)))


def team_records(games: DataFrame) -> DataFrame:
    """Wins, losses and games per tournament and team (O-90)."""
    sides = games.select("tournament", F.explode(F.array(F.struct(F.col("winner").alias("team"), F.lit(1).alias("w")), F.struct(F.col("loser").alias("team"), F.lit(0).alias("w")))).alias("s"))
    return sides.groupBy("tournament", "s.team").agg(F.sum("s.w").alias("wins"), F.sum(1 - F.col("s.w")).alias("losses"), F.count("*").alias("games"))


def champions(games: DataFrame, label: str = "label", final: str = "final") -> DataFrame:
    """Winner of the labelled final, else the only unbeaten team with a win, else null (O-91)."""
    named = games.filter(F.col(label) == final).groupBy("tournament").agg(F.max_by("winner", "ord").alias("named"))
    unbeaten = team_records(games).filter("losses = 0 and wins > 0").groupBy("tournament").agg(F.count("*").alias("n"), F.min("team").alias("only"))
    every = games.select("tournament").distinct()
    return every.join(named, "tournament", "left").join(unbeaten, "tournament", "left").select("tournament", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("champion"))


def depth_to_final(games: DataFrame, terminals: dict[str, int], label: str = "label", most: int = REMAINDER) -> DataFrame:
    """games with k, the number of rounds before the final (O-92).

    A labelled round has its own k. Otherwise k is one more than that of the winner's next game by
    ord; without a next game it is 0 for the champion and unknown for others. ord ascends along the
    pointers, so they have no cycles; games are spliced out until at most `most` remain (see pointers).
    """
    scratch = Scratch(games.sparkSession, "depth")
    # the games are read by every step below: computed once
    games = scratch.save(games, "games")
    sides = games.select("tournament", "ord", F.explode(F.array("winner", "loser")).alias("team"))
    following = sides.withColumn("next", F.lead("ord").over(Window.partitionBy("tournament", "team").orderBy("ord")))
    own = F.lit(None).cast("int")
    for name, k in terminals.items():
        own = F.when(F.col(label) == name, k).otherwise(own)
    start = games.join(following.select("tournament", "ord", F.col("team").alias("winner"), "next"), ["tournament", "ord", "winner"]).join(champions(games, label), "tournament", "left")
    fixed = F.coalesce(own, F.when(F.col("next").isNull() & (F.col("winner") == F.col("champion")), 0))
    at = scratch.save(start.select(F.col("tournament").alias("tree"), F.col("ord").alias("node"), F.when(fixed.isNull(), F.col("next")).alias("to"), fixed.alias("base")), "start")
    base = at.filter("to is null").select("tree", F.col("node").alias("end"), "base")
    walked = ends_of(at, scratch, most).join(base, ["tree", "end"])
    return games.join(walked.select(F.col("tree").alias("tournament"), F.col("node").alias("ord"), (F.col("steps") + F.col("base")).cast("int").alias("k")), ["tournament", "ord"])


def stage_labels(entries: DataFrame, games_k: DataFrame, champs: DataFrame, names: list[str]) -> DataFrame:
    """Wins, losses and result of every entry (tournament, team, withdrew) (O-93).

    In this order: withdrew (keeps its record); no games: all unknown; champion; unbeaten but not
    champion: unknown; no win: first-game loss; else the stage of the last lost game's k.
    """
    last_loss = games_k.groupBy("tournament", F.col("loser").alias("team")).agg(F.max_by("k", "ord").alias("k"))
    rows = entries.join(team_records(games_k), ["tournament", "team"], "left").join(last_loss, ["tournament", "team"], "left").join(champs, "tournament", "left")
    k = F.col("k")
    known = F.array(*map(F.lit, names))
    stage = F.when(k < len(names), F.try_element_at(known, (k + 1).cast("int"))).otherwise(F.concat(F.lit("ベスト"), F.pow(F.lit(2), k + 1).cast("long").cast("string")))
    result = (
        F.when(F.coalesce("withdrew", F.lit(False)), "辞退")
        .when(F.col("games").isNull(), F.lit(None))
        .when(F.col("team") == F.col("champion"), "優勝")
        .when(F.col("losses") == 0, F.lit(None))
        .when(F.col("wins") == 0, "初戦敗退")
        .otherwise(stage)
    )
    return rows.select("tournament", "team", "wins", "losses", result.alias("result"))


def live_status(games: DataFrame, alive: DataFrame) -> DataFrame:
    """Wins, alive and the round of the latest loss per team; teams without a game come from alive (O-88)."""
    sides = games.select("tournament", "ord", "round", F.explode(F.array(F.struct(F.col("winner").alias("team"), F.lit(True).alias("won")), F.struct(F.col("loser").alias("team"), F.lit(False).alias("won")))).alias("s"))
    agg = sides.groupBy("tournament", F.col("s.team").alias("team")).agg(F.count_if("s.won").alias("wins"), F.max_by(F.when(~F.col("s.won"), F.col("round")), F.when(~F.col("s.won"), F.col("ord"))).alias("lost_in"))
    listed = alive.select("tournament", "team", F.lit(True).alias("alive"))
    out = agg.join(listed, ["tournament", "team"], "full_outer")
    return out.select("tournament", "team", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("alive", F.lit(False)).alias("alive"), "lost_in")


def alive_teams(teams: DataFrame, games: DataFrame) -> DataFrame:
    """Teams without a loss, with their wins (O-102)."""
    lost = games.select("tournament", F.col("loser").alias("team"))
    wins = games.groupBy("tournament", F.col("winner").alias("team")).agg(F.count("*").alias("wins"))
    return teams.join(lost, ["tournament", "team"], "left_anti").join(wins, ["tournament", "team"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def next_scheduled(schedule: DataFrame, done: DataFrame) -> DataFrame:
    """The first unplayed scheduled game per team (O-103). schedule: tournament, ord, a, b."""
    open_games = schedule.join(done.select("tournament", "ord"), ["tournament", "ord"], "left_anti")
    sides = open_games.select("tournament", "ord", F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("b").alias("opponent")), F.struct(F.col("b").alias("team"), F.col("a").alias("opponent")))).alias("s"))
    return sides.groupBy("tournament", F.col("s.team").alias("team")).agg(F.min("ord").alias("next_ord"), F.min_by("s.opponent", "ord").alias("opponent"))


def unbeaten_spotlight(games: DataFrame, finished: DataFrame, per: int, round_col: str = "round") -> DataFrame:
    """Unbeaten teams with a win of tournaments without a played final: deepest round, then wins (O-96)."""
    rec = team_records(games).filter("losses = 0 and wins > 0").join(finished.select("tournament"), "tournament", "left_anti")
    deep = games.groupBy("tournament", F.col("winner").alias("team")).agg(F.max(round_col).alias("deepest"))
    return rec.join(deep, ["tournament", "team"]).select("tournament", "team", "wins", "deepest").orderBy(F.col("deepest").desc(), F.col("wins").desc(), "tournament", "team").limit(per)


def standing(round_from_final: Column, won: Column) -> Column:
    """Standing by the deepest round and its outcome (O-97)."""
    return F.when(won & (round_from_final == 0), "champion").when(won & (round_from_final == 1), "reached the final").when(won & (round_from_final == 2), "reached the semi-final").when(won, "won a round").otherwise("out")


def split_third_place(games: DataFrame, label: str = "label", final: str = "final", third: str = "third place") -> DataFrame:
    """Where several games are labelled final and just one has two sides unbeaten elsewhere, the rest
    are for third place (O-98)."""
    finals = games.filter(F.col(label) == final)
    others = games.filter(~F.col(label).eqNullSafe(final)).select("tournament", F.col("loser").alias("team")).distinct()
    sides = finals.select("tournament", "ord", F.explode(F.array("winner", "loser")).alias("team"))
    beaten = sides.join(others, ["tournament", "team"], "left_semi").groupBy("tournament", "ord").agg(F.count("*").alias("beaten"))
    marked = finals.select("tournament", "ord").join(beaten, ["tournament", "ord"], "left").withColumn("clean", F.col("beaten").isNull())
    per = marked.groupBy("tournament").agg(F.count("*").alias("finals"), F.count_if("clean").alias("true_finals"))
    rest = marked.join(per.filter("finals > 1 and true_finals = 1"), "tournament").filter("not clean").select("tournament", "ord", F.lit(True).alias("__third"))
    out = games.join(rest, ["tournament", "ord"], "left")
    return out.withColumn(label, F.when(F.col("__third"), third).otherwise(F.col(label))).drop("__third")


def retention(df: DataFrame, keys: list[str], date: str, days: int) -> DataFrame:
    """Rows at most `days` before the newest date of their group: anchored on data, not today (O-99)."""
    newest = df.groupBy(*keys).agg(F.max(date).alias("__newest"))
    return df.join(newest, keys).filter(F.col(date) >= F.date_sub("__newest", days)).drop("__newest")


def with_fallback(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows, and previous rows of groups that have no current ones (O-100)."""
    missing = previous.join(current.select(*keys).distinct(), keys, "left_anti")
    return current.unionByName(missing.select(current.columns))


def public_games(games: DataFrame, public: DataFrame) -> DataFrame:
    """Games with at least one public side (O-30, O-101)."""
    sides = games.select("tournament", "ord", F.explode(F.array("winner", "loser")).alias("team")).join(public.select("team"), "team", "left_semi")
    return games.join(sides.select("tournament", "ord").distinct(), ["tournament", "ord"], "left_semi")


def bracket_tree(items: DataFrame, most: int = REMAINDER) -> DataFrame:
    """Parents and depths of an infix bracket (O-104).

    items: tree, pos, col (games: their column; teams: null). The parent of an item is the lower of
    the nearest game to the left with a column at least its own and the nearest to the right with a
    greater one; equal columns give the right one. Result adds parent (pos or null) and depth.
    """
    scratch = Scratch(items.sparkSession, "bracket")
    # every game stands on each level up to its column, so the nearest game of at least or over a
    # level is the last such row before or after an item on that level: n log n rows, no self join
    games = items.filter(F.col("col").isNotNull()).select("tree", "pos", F.col("col").alias("c"), F.explode(F.sequence(F.lit(-1), F.col("col").cast("int"))).alias("level"))
    teams = items.filter(F.col("col").isNull()).select("tree", "pos", F.lit(None).cast(items.schema["col"].dataType).alias("c"), F.lit(-1).alias("level"))
    here = F.struct(F.col("pos").alias("p"), F.col("c").alias("c"))
    ahead, behind = (Window.partitionBy("tree", "level").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("pos"), F.col("pos").desc()))
    near = games.unionByName(teams).select("tree", "level", "pos", "c", F.last(F.when(F.col("c") >= F.col("level"), here), True).over(ahead).alias("l"), F.last(F.when(F.col("c") > F.col("level"), here), True).over(behind).alias("r"))
    near = near.filter(F.col("level") == F.coalesce("c", F.lit(-1)))
    parent = F.when(F.col("r").isNotNull() & (F.col("l").isNull() | (F.col("r.c") <= F.col("l.c"))), F.col("r.p")).otherwise(F.col("l.p"))
    out = items.join(near.select("tree", "pos", parent.alias("parent")), ["tree", "pos"], "left")
    out = scratch.save(out, "parents")
    ends = ends_of(out.select("tree", F.col("pos").alias("node"), F.col("parent").alias("to")), scratch, most)
    return out.join(ends.select("tree", F.col("node").alias("pos"), F.col("steps").cast("int").alias("depth")), ["tree", "pos"])


def next_opponent(slots: DataFrame, games: DataFrame, alive: DataFrame) -> DataFrame:
    """For alive teams the first unplayed bracket game above them, and who waits there (O-105).

    slots: tournament, team, round, block (the team's block in every round). games: played, with
    round, block and winner. The opponent is the winner of the sibling block below, null if open.
    """
    climb = slots.join(alive.select("tournament", "team"), ["tournament", "team"], "left_semi")
    open_at = climb.join(games.select("tournament", "round", "block"), ["tournament", "round", "block"], "left_anti")
    first = open_at.groupBy("tournament", "team").agg(F.min(F.struct("round", "block")).alias("n")).select("tournament", "team", "n.round", "n.block")
    below = climb.select("tournament", "team", (F.col("round") + 1).alias("round"), F.col("block").alias("child"))
    placed = first.join(below, ["tournament", "team", "round"], "left")
    sibling = F.when(F.col("child") % 2 == 0, F.col("child") + 1).otherwise(F.col("child") - 1)
    waiting = games.select("tournament", (F.col("round") + 1).alias("round"), F.col("block").alias("sib"), F.col("winner").alias("opponent"))
    return placed.withColumn("sib", sibling).join(waiting, ["tournament", "round", "sib"], "left").select("tournament", "team", "round", "opponent")


def day_dates(known: DataFrame, wanted: DataFrame, group: str, ahead: int = 3) -> DataFrame:
    """Dates of day numbers: known ones; later ones only where all known days follow each other from
    the first, and at most `ahead` days after the last (O-106). known: group, day, date."""
    agg = known.groupBy(group).agg(F.min("day").alias("d0"), F.max("day").alias("d1"), F.min_by("date", "day").alias("first"), F.max_by("date", "day").alias("last"), F.count_distinct("day").alias("n"))
    sound = agg.withColumn("steady", (F.col("n") == F.col("d1") - F.col("d0") + 1) & (F.datediff("last", "first") == F.col("d1") - F.col("d0")))
    rows = wanted.join(known.select(group, "day", "date"), [group, "day"], "left").join(sound, group, "left")
    later = F.when(F.col("steady") & (F.col("day") > F.col("d1")) & (F.col("day") <= F.col("d1") + ahead), F.date_add("last", (F.col("day") - F.col("d1")).cast("int")))
    return rows.select(group, "day", F.coalesce("date", later).alias("date"))


def gated(rows: DataFrame, ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows, or none at all if any common key has another value in the other source (O-107)."""
    bad = ours.join(theirs.select(*keys, F.col(value).alias("__other")), keys).agg(F.count_if(~F.col(value).eqNullSafe(F.col("__other"))).alias("__bad"))
    return rows.crossJoin(F.broadcast(bad)).filter("__bad = 0").drop("__bad")


def short_name_aliases(entries: DataFrame, tournament: str, entity: str, short: str, regions: str) -> DataFrame:
    """Names by which an entry may be found in its tournament (O-94): its short name if no other entry
    has it, and region-qualified spellings; an alias of several entries is dropped for all."""
    region = F.explode(F.coalesce(F.col(regions), F.array().cast("array<string>"))).alias("region")
    qualified = entries.select(tournament, entity, short, region).select(tournament, entity, F.explode(F.array(F.concat(F.col("region"), F.col(short)), F.concat(F.col(short), F.lit("("), F.col("region"), F.lit(")")), F.concat(F.col("region"), F.lit("・"), F.col(short)))).alias("alias"))
    every = qualified.unionByName(entries.select(tournament, entity, F.col(short).alias("alias"))).distinct()
    single = every.groupBy(tournament, "alias").agg(F.count_distinct(entity).alias("n"), F.min(entity).alias(entity)).filter("n = 1")
    return single.select(tournament, "alias", entity)


def walkover_losers(rows: DataFrame, a: str, b: str, score_a: str, score_b: str, note: str, marker: str = "不戦") -> DataFrame:
    """The losing side of games without scores that the note marks as walkovers (O-95): side b loses."""
    blank = (F.coalesce(F.trim(F.col(score_a)), F.lit("")) == "") & (F.coalesce(F.trim(F.col(score_b)), F.lit("")) == "")
    return rows.filter(blank & F.col(note).contains(marker)).select("tournament", F.col(b).alias("team"))
