"""Queries over bracket games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import ranking
from tallywick.operators import tournament as T
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.session import table

# The stage of a side that lost k rounds before the final's end.
LOSER_STAGES = ["準優勝", "ベスト4", "ベスト8", "ベスト16", "ベスト32", "ベスト64"]

_K = "kk AS MATERIALIZED (SELECT g.*, (SELECT count(*) FROM brk h WHERE h.tournament = g.tournament AND h.round > g.round AND h.block = g.block >> (h.round - g.round)) AS k FROM brk g)"
_REC = "rec AS (SELECT tournament, team, sum(w)::BIGINT AS wins, sum(1 - w)::BIGINT AS losses, count(*) AS games FROM (SELECT tournament, winner AS team, 1 AS w FROM brk UNION ALL SELECT tournament, loser, 0 FROM brk) GROUP BY ALL)"
_WITH = B.cte("brk") + "," + _K + "," + _REC + " "


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Games with the label of the last round only."""
    g = B.bracket_games(spark, d)
    top = g.groupBy("tournament").agg(F.max("round").alias("top"))
    return g.join(top, "tournament").withColumn("label", F.when(F.col("round") == F.col("top"), "final")).drop("top")


def teams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("tournament"), F.col("c_custkey").alias("team"))


@query(_WITH + "SELECT * FROM rec")
def bracket_records(spark: SparkSession, d: str) -> DataFrame:
    return T.team_records(B.bracket_games(spark, d))


@query(_WITH + "SELECT tournament, arg_max(winner, ord) AS champion FROM brk GROUP BY 1")
def champions(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d)
    return T.champions(g.filter("label is null or tournament <> 'BUILDING'").unionByName(g.filter("label = 'final' and tournament = 'BUILDING'").withColumn("label", F.lit(None).cast("string"))))


@query(_WITH + "SELECT tournament, ord, k FROM kk")
def bracket_depth(spark: SparkSession, d: str) -> DataFrame:
    return T.depth_to_final(labelled(spark, d), {"final": 0, "semi": 1, "quarter": 2}).select("tournament", "ord", F.col("k").cast("long").alias("k"))


@query(_WITH + """, l AS (SELECT tournament, loser AS team, arg_max(k, ord) AS k FROM kk GROUP BY ALL), c AS (SELECT tournament, arg_max(winner, ord) AS champion FROM brk GROUP BY 1)
SELECT s.tournament, s.team, wins, losses, CASE WHEN s.team % 97 = 0 THEN '辞退' WHEN games IS NULL THEN NULL WHEN s.team = champion THEN '優勝' WHEN losses = 0 THEN NULL WHEN wins = 0 THEN '初戦敗退'
  WHEN k < 6 THEN ['準優勝', 'ベスト4', 'ベスト8', 'ベスト16', 'ベスト32', 'ベスト64'][k + 1] ELSE 'ベスト' || (2 ** (k + 1))::BIGINT END AS result
FROM seeded s LEFT JOIN rec USING (tournament, team) LEFT JOIN l USING (tournament, team) LEFT JOIN c USING (tournament)""")
def stage_labels(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d)
    entries = teams(spark, d).withColumn("withdrew", F.col("team") % 97 == 0)
    return T.stage_labels(entries, T.depth_to_final(g, {"final": 0}), T.champions(g), LOSER_STAGES)


@query(_WITH + """, g AS (SELECT * FROM brk WHERE round <= 4), a AS (SELECT tournament, team FROM seeded ANTI JOIN (SELECT tournament, loser AS team FROM g) USING (tournament, team)),
 s AS (SELECT tournament, team, count(*) FILTER (WHERE won) AS wins, max(CASE WHEN NOT won THEN round END) AS lost_in FROM (SELECT tournament, winner AS team, true AS won, round FROM g UNION ALL SELECT tournament, loser, false, round FROM g) GROUP BY ALL)
 SELECT tournament, team, coalesce(wins, 0) AS wins, a.team IS NOT NULL AS alive, lost_in FROM s FULL JOIN a USING (tournament, team)""")
def live_status(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d).filter("round <= 4")
    return T.live_status(g, T.alive_teams(teams(spark, d), g))


@query(_WITH + """, g AS (SELECT * FROM brk WHERE round <= 4) SELECT tournament, team, coalesce(wins, 0) AS wins FROM (SELECT tournament, team FROM seeded ANTI JOIN (SELECT tournament, loser AS team FROM g) USING (tournament, team))
 LEFT JOIN (SELECT tournament, winner AS team, count(*) AS wins FROM g GROUP BY ALL) USING (tournament, team)""")
def alive_list(spark: SparkSession, d: str) -> DataFrame:
    return T.alive_teams(teams(spark, d), B.bracket_games(spark, d).filter("round <= 4"))


@query(_WITH + """, o AS (SELECT * FROM brk WHERE round > 2) SELECT tournament, team, min(ord) AS next_ord, arg_min(opponent, ord) AS opponent FROM (SELECT tournament, ord, winner AS team, loser AS opponent FROM o UNION ALL SELECT tournament, ord, loser, winner FROM o) GROUP BY ALL""")
def next_scheduled(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    return T.next_scheduled(g.select("tournament", "ord", F.col("winner").alias("a"), F.col("loser").alias("b")), g.filter("round <= 2"))


@query(_WITH + """, g AS (SELECT * FROM brk WHERE round <= 4 AND tournament <> 'MACHINERY'), r AS (SELECT tournament, team, count(*) FILTER (WHERE w) AS wins, count(*) FILTER (WHERE NOT w) AS losses FROM (SELECT tournament, winner AS team, true AS w FROM g UNION ALL SELECT tournament, loser, false FROM g) GROUP BY ALL)
 SELECT r.tournament, r.team, wins, deepest FROM r JOIN (SELECT tournament, winner AS team, max(round) AS deepest FROM g GROUP BY ALL) USING (tournament, team) WHERE losses = 0 AND wins > 0 AND r.tournament <> 'BUILDING' ORDER BY deepest DESC, wins DESC, tournament, team LIMIT 30""")
def unbeaten_spotlight(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d).filter("round <= 4 and tournament <> 'MACHINERY'")
    return T.unbeaten_spotlight(g, teams(spark, d).select("tournament").distinct().filter("tournament = 'BUILDING'"), 30)


@query(_WITH + "SELECT tournament, ord, CASE WHEN k = 0 THEN 'champion' WHEN k = 1 THEN 'reached the final' WHEN k = 2 THEN 'reached the semi-final' ELSE 'won a round' END AS standing FROM kk")
def standings(spark: SparkSession, d: str) -> DataFrame:
    g = T.depth_to_final(labelled(spark, d), {"final": 0})
    return g.select("tournament", "ord", T.standing(F.col("k"), F.lit(True)).alias("standing"))


@query(_WITH + """, c AS (SELECT tournament, max(round) AS top FROM brk GROUP BY 1), x AS (SELECT tournament, ord, winner, loser, CASE WHEN round = top THEN 'final' END AS label FROM brk JOIN c USING (tournament)
 UNION ALL SELECT tournament, 90000000, min(loser), max(loser), 'final' FROM brk JOIN c USING (tournament) WHERE round = top - 1 GROUP BY 1 HAVING count(*) = 2)
 SELECT tournament, ord, CASE WHEN ord = 90000000 THEN 'third place' ELSE label END AS label FROM x""")
def third_place_repair(spark: SparkSession, d: str) -> DataFrame:
    g = labelled(spark, d)
    tops = g.groupBy("tournament").agg(F.max("round").alias("top"))
    semis = g.join(tops, "tournament").filter("round = top - 1").groupBy("tournament").agg(F.min("loser").alias("winner"), F.max("loser").alias("loser"), F.count("*").alias("n")).filter("n = 2")
    extra = semis.select("tournament", F.lit(90000000).alias("ord"), "winner", "loser", F.lit("final").alias("label"))
    both = g.select("tournament", "ord", "winner", "loser", "label").unionByName(extra.withColumn("ord", F.col("ord").cast("long")))
    return T.split_third_place(both).select("tournament", "ord", "label")


@query(B.cte("evt") + ", e AS (SELECT *, ts::DATE AS day FROM evt) SELECT event_id FROM e JOIN (SELECT target, action, max(day) AS newest FROM e GROUP BY ALL) USING (target, action) WHERE day >= newest - 20")
def retention_window(spark: SparkSession, d: str) -> DataFrame:
    return T.retention(B.events(spark, d).withColumn("day", F.to_date("ts")), ["target", "action"], "day", 20).select("event_id")


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS g, year(o_orderdate) AS y FROM orders), cur AS (SELECT * FROM o WHERE y = 1997 AND g % 3 <> 0) SELECT o_orderkey, g, y FROM cur UNION ALL SELECT o_orderkey, g, y FROM o WHERE y = 1996 AND g NOT IN (SELECT g FROM cur)""")
def fallback_period(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("g"), F.year("o_orderdate").alias("y"))
    return T.with_fallback(o.filter("y = 1997 and g % 3 <> 0"), o.filter("y = 1996"), ["g"])


@query(_WITH + "SELECT tournament, ord FROM brk WHERE winner % 3 = 0 OR loser % 3 = 0")
def public_games(spark: SparkSession, d: str) -> DataFrame:
    return T.public_games(B.bracket_games(spark, d), teams(spark, d).filter("team % 3 = 0")).select("tournament", "ord")


@query(_WITH + """, items AS (SELECT tournament AS tree, 2 * seed AS pos, -1 AS round, seed AS block FROM seeded UNION ALL SELECT tournament, 2 * ((2 * block + 1) << round) - 1, round, block FROM brk),
 up AS (SELECT i.tree, i.pos, count(h.round) AS depth, arg_min(2 * ((2 * h.block + 1) << h.round) - 1, h.round) AS parent FROM items i LEFT JOIN brk h ON h.tournament = i.tree AND h.round > i.round AND h.block = i.block >> (h.round - i.round) GROUP BY ALL)
 SELECT tree, pos, parent, depth FROM up""")
def bracket_tree(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    w = teams(spark, d).withColumn("pos", 2 * (F.row_number().over(ranking.Window.partitionBy("tournament").orderBy("team")) - 1))
    items = w.select(F.col("tournament").alias("tree"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("int").alias("col"))
    pos = 2 * ((2 * F.col("block") + 1) * F.pow(F.lit(2), F.col("round"))).cast("long") - 1
    items = items.unionByName(g.select(F.col("tournament").alias("tree"), pos.alias("pos"), F.col("round").cast("int").alias("col")))
    return T.bracket_tree(items).select("tree", "pos", "parent", F.col("depth").cast("long").alias("depth"))


@query(_WITH + """, slot AS (SELECT tournament, team, round, block FROM seeded JOIN brk USING (tournament) WHERE block = seed >> (round + 1)), live AS (SELECT tournament, team FROM seeded ANTI JOIN (SELECT tournament, loser AS team FROM brk WHERE round <= 3) USING (tournament, team)),
 nxt AS (SELECT tournament, team, min(round) AS round FROM slot JOIN live USING (tournament, team) WHERE round > 3 GROUP BY ALL)
 SELECT n.tournament, n.team, n.round, o.winner AS opponent FROM nxt n JOIN slot s USING (tournament, team, round) LEFT JOIN slot c ON c.tournament = n.tournament AND c.team = n.team AND c.round = n.round - 1
  LEFT JOIN brk o ON o.tournament = n.tournament AND o.round = n.round - 1 AND o.round <= 3 AND o.block = xor(c.block, 1)""")
def next_opponent(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    played = g.filter("round <= 3")
    seeds = teams(spark, d).withColumn("seed", F.row_number().over(ranking.Window.partitionBy("tournament").orderBy("team")) - 1)
    # log2(teams) rounds per team; the game of a round is found by its block, not by scanning games
    tops = g.groupBy("tournament").agg(F.max("round").alias("top"))
    climbs = seeds.join(tops, "tournament").select("tournament", "team", "seed", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("round"))
    climbs = climbs.select("tournament", "team", "round", F.floor(F.col("seed") / F.pow(F.lit(2), F.col("round") + 1)).cast("long").alias("block"))
    slots = climbs.join(g.select("tournament", "round", "block"), ["tournament", "round", "block"])
    return T.next_opponent(slots, played, T.alive_teams(teams(spark, d), played))


_DAYS = """known AS (SELECT target, datediff('day', (SELECT min(ts::DATE) FROM evt), ts::DATE) AS day, ts::DATE AS date FROM evt WHERE action = 'signup' OR target % 3 = 0 GROUP BY ALL),
 agg AS (SELECT target, min(day) AS d0, max(day) AS d1, min(date) AS f, max(date) AS l, count(DISTINCT day) AS n FROM known GROUP BY 1), want AS (SELECT target, d1 + i AS day FROM agg, (SELECT unnest(range(-1, 6)) AS i))"""


@query(B.cte("evt") + "," + _DAYS + """ SELECT w.target, w.day::INT AS day, coalesce(k.date, CASE WHEN n = d1 - d0 + 1 AND datediff('day', f, l) = d1 - d0 AND w.day > d1 AND w.day <= d1 + 3 THEN l + (w.day - d1)::INT END)::VARCHAR AS date
 FROM want w LEFT JOIN known k USING (target, day) LEFT JOIN agg USING (target)""")
def day_to_date(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumn("date", F.to_date("ts"))
    first = e.agg(F.min("date").alias("first"))
    known = e.filter("action = 'signup' or target % 3 = 0").crossJoin(F.broadcast(first)).select("target", F.datediff("date", "first").alias("day"), "date").distinct()
    want = known.groupBy("target").agg(F.max("day").alias("d1")).select("target", F.explode(F.sequence(F.lit(-1), F.lit(5))).alias("i"), "d1").select("target", (F.col("d1") + F.col("i")).alias("day"))
    return T.day_dates(known, want, "target").withColumn("date", F.col("date").cast("string"))


@query(_WITH + "SELECT tournament, ord FROM brk WHERE round <= 1 AND tournament <> 'FURNITURE'")
def cross_source_gate(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d).select("tournament", "ord", "round")
    rows = g.filter("round <= 1")
    clash = g.withColumn("round", F.when((F.col("tournament") == "FURNITURE") & (F.col("ord") == 0), F.lit(9)).otherwise(F.col("round")))
    good = T.gated(rows.filter("tournament <> 'FURNITURE'"), g.filter("tournament <> 'FURNITURE'"), clash, ["tournament", "ord"], "round")
    bad = T.gated(rows.filter("tournament = 'FURNITURE'"), g.filter("tournament = 'FURNITURE'"), clash, ["tournament", "ord"], "round")
    return good.unionByName(bad).select("tournament", "ord")


@query(_WITH + """, s AS (SELECT tournament, ord, winner AS team, (winner * 7 % 11)::INT AS score, NULL AS flag FROM brk UNION ALL SELECT tournament, ord, loser, (loser * 5 % 11)::INT, CASE WHEN loser % 4 = 0 THEN true END FROM brk)
 SELECT tournament, ord, team, coalesce(flag, score > sum(score) OVER (PARTITION BY tournament, ord) - score) AS won FROM s""")
def side_outcomes(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    sides = g.select("tournament", "ord", F.col("winner").alias("team"), (F.col("winner") * 7 % 11).alias("score"), F.lit(None).cast("boolean").alias("flag"))
    sides = sides.unionByName(g.select("tournament", "ord", F.col("loser").alias("team"), (F.col("loser") * 5 % 11).alias("score"), F.when(F.col("loser") % 4 == 0, True).alias("flag")))
    keyed = sides.withColumn("game", F.concat_ws(":", "tournament", "ord"))
    return T.side_outcomes(keyed, "game", "flag", "score", "team").select("tournament", "ord", "team", "won")


@query("""WITH n AS (SELECT c_mktsegment AS tournament, c_custkey AS team, 'T' || c_custkey % 50 AS short, 'R' || c_nationkey AS region FROM customer),
 a AS (SELECT tournament, team, short AS alias FROM n UNION SELECT tournament, team, unnest([region || short, short || '(' || region || ')', region || '・' || short]) FROM n)
 SELECT tournament, alias, min(team) AS team FROM a GROUP BY ALL HAVING count(DISTINCT team) = 1""")
def short_name_aliases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    entries = c.select(F.col("c_mktsegment").alias("tournament"), F.col("c_custkey").alias("team"), F.concat(F.lit("T"), (F.col("c_custkey") % 50).cast("string")).alias("short"), F.array(F.concat(F.lit("R"), F.col("c_nationkey").cast("string"))).alias("regions"))
    return T.short_name_aliases(entries, "tournament", "team", "short", "regions")


@query(B.cte("app", "brk", "ent") + """, cur AS (SELECT entity FROM app WHERE year = (SELECT max(year) FROM app) AND season = 'summer'), g AS (SELECT * FROM brk WHERE round <= 4),
 s AS (SELECT team, count(*) FILTER (WHERE won) AS wins FROM (SELECT winner AS team, true AS won FROM g UNION ALL SELECT loser, false FROM g) GROUP BY 1), dead AS (SELECT loser AS team FROM g)
 SELECT entity, name, entity NOT IN (SELECT team FROM dead) AS alive, coalesce(wins, 0) AS wins FROM cur JOIN ent USING (entity) LEFT JOIN s ON team = entity ORDER BY alive DESC, wins DESC, name, entity LIMIT 100""")
def season_participants(spark: SparkSession, d: str) -> DataFrame:
    """Participants of the newest summer with their live status, the living and winning first."""
    app = B.appearances(spark, d)
    newest = app.agg(F.max("year").alias("year"))
    now = app.filter("season = 'summer'").join(F.broadcast(newest), "year", "left_semi").select("entity")
    g = B.bracket_games(spark, d).filter("round <= 4")
    status = T.live_status(g, T.alive_teams(teams(spark, d), g)).select(F.col("team").alias("entity"), "alive", "wins")
    rows = now.join(B.entities(spark, d).select("entity", "name"), "entity").join(status, "entity", "left")
    rows = rows.select("entity", "name", F.coalesce("alive", F.lit(False)).alias("alive"), F.coalesce("wins", F.lit(0)).alias("wins"))
    return ranking.top_n(rows, [F.col("alive").desc(), F.col("wins").desc(), F.col("name"), F.col("entity")], 100)
