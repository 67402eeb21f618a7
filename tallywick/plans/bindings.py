"""Domain relations derived from the star-schema tables, each with its SQL twin.

appearances (one row per entity, year and season), entities, districts, bracket games and community
events. The operators know nothing of these names; queries bind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywick.session import table

# The stage ladder from best to worst, and the seasons in their order.
STAGES = ["優勝", "準優勝", "ベスト4", "ベスト8", "ベスト16", "ベスト32", "ベスト64", "初戦敗退"]
SEASONS = ["spring", "summer", "autumn"]

PRIORITY_STAGE = {"1-URGENT": "優勝", "2-HIGH": "準優勝", "3-MEDIUM": "ベスト4", "5-LOW": "初戦敗退"}


def appearances(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("wins"), F.count_if(F.col("l_returnflag") == "R").alias("losses"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    month = F.month("o_orderdate")
    stage = F.lit(None).cast("string")
    for k, v in PRIORITY_STAGE.items():
        stage = F.when(F.col("o_orderpriority") == k, v).otherwise(stage)
    rows = orders.join(lines, "o_orderkey", "left").select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").alias("year"),
        F.when(month <= 4, "spring").when(month <= 8, "summer").otherwise("autumn").alias("season"),
        "o_orderkey",
        stage.alias("result"),
        "wins",
        "losses",
    )
    first = Window.partitionBy("entity", "year", "season").orderBy("o_orderkey")
    return rows.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("balance"))


def districts(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("district"), F.col("n_name").alias("district_name"), F.col("r_name").alias("region"))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("visitor"), F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("target"))


def bracket_games(spark: SparkSession, d: str) -> DataFrame:
    """game = (tournament, ord), round r, block; a and b the winners of the half-blocks, winner and loser."""
    seeded = table(spark, d, "customer").select(F.col("c_mktsegment").alias("tournament"), F.col("c_custkey").alias("team"), F.col("c_acctbal").alias("bal"))
    seeded = seeded.withColumn("seed", F.row_number().over(Window.partitionBy("tournament").orderBy("team")) - 1)
    levels = seeded.groupBy("tournament").agg(F.max("seed").alias("top")).select("tournament", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("top") + 1)).cast("int"))).alias("r"))
    halves = seeded.join(levels, "tournament").groupBy("tournament", "r", F.floor(F.col("seed") / F.pow(F.lit(2), F.col("r"))).cast("long").alias("half")).agg(F.max(F.struct("bal", "team")).alias("best"))
    left, right = halves.filter("half % 2 = 0"), halves.filter("half % 2 = 1").select("tournament", "r", (F.col("half") - 1).alias("half"), F.col("best").alias("other"))
    games = left.join(right, ["tournament", "r", "half"])
    won = F.when(F.col("best") > F.col("other"), F.col("best.team")).otherwise(F.col("other.team"))
    lost = F.when(F.col("best") > F.col("other"), F.col("other.team")).otherwise(F.col("best.team"))
    return games.select("tournament", F.col("r").alias("round"), (F.col("half") / 2).cast("long").alias("block"), won.alias("winner"), lost.alias("loser")).withColumn("ord", F.col("round") * F.lit(1000000) + F.col("block"))


_STAGE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_STAGE.items())
_LADDER = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STAGES))
#: Ladder ordinal of a stage in SQL: unknown labels second to last, null last.
STAGE_ORD = f"CASE WHEN result IS NULL THEN 2147483647 ELSE CASE result {_LADDER} ELSE 2147483646 END END"
SEASON_ORD = "CASE season WHEN 'spring' THEN 0 WHEN 'summer' THEN 1 ELSE 2 END"

CTE = {
    "app": f"""app AS MATERIALIZED (SELECT entity, year, season, o_orderkey, result, wins, losses FROM (
      SELECT o_custkey AS entity, year(o_orderdate) AS year,
        CASE WHEN month(o_orderdate) <= 4 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
        o_orderkey, CASE o_orderpriority {_STAGE_CASE} END AS result, wins, losses,
        row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), CASE WHEN month(o_orderdate) <= 4 THEN 0 WHEN month(o_orderdate) <= 8 THEN 1 ELSE 2 END ORDER BY o_orderkey) AS rn
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS wins, count(*) FILTER (WHERE l_returnflag = 'R') AS losses FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey) WHERE rn = 1)""",
    "ent": "ent AS (SELECT c_custkey AS entity, c_name AS name, c_nationkey AS district, c_mktsegment AS kind, c_acctbal AS balance FROM customer)",
    "dim": "dim AS (SELECT n_nationkey AS district, n_name AS district_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "evt": "evt AS (SELECT event_id, ts, user_id AS visitor, event_type AS action, value, json_extract_string(props, '$.k')::BIGINT AS target FROM events)",
    "brk": """seeded AS (SELECT c_mktsegment AS tournament, c_custkey AS team, c_acctbal AS bal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS seed FROM customer),
    halves AS (SELECT tournament, r, seed >> r AS half, max((bal, team)) AS best FROM seeded JOIN (SELECT tournament, unnest(range(0, ceil(log2(max(seed) + 1))::INT + 1)) AS r FROM seeded GROUP BY 1) USING (tournament) GROUP BY ALL),
    brk AS MATERIALIZED (SELECT a.tournament, a.r::INT AS round, a.half // 2 AS block, CASE WHEN a.best > b.best THEN a.best[2] ELSE b.best[2] END AS winner, CASE WHEN a.best > b.best THEN b.best[2] ELSE a.best[2] END AS loser, a.r * 1000000 + a.half // 2 AS ord
      FROM halves a JOIN halves b ON a.tournament = b.tournament AND a.r = b.r AND b.half = a.half + 1 AND a.half % 2 = 0)""",
}


def cte(*names: str) -> str:
    """A WITH clause with the named relations."""
    return "WITH " + ",\n".join(CTE[n] for n in names)
