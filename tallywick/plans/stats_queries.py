"""Queries over appearances: careers, ranks, roll-ups, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import ranking, stats
from tallywick.operators.ladder import ladder_ordinal
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.session import table

# A berth is an entity's spring appearance of the fixed priority; totals are all appearances of a period.
BERTH = "result = 'ベスト4' AND season = 'spring'"


def careers(spark: SparkSession, d: str, berths: bool = False) -> DataFrame:
    app = B.appearances(spark, d)
    return stats.career_stats(app, B.entities(spark, d), "entity", B.STAGES, B.SEASONS, app.filter(BERTH) if berths else None)


_BEST = f"arg_min(struct_pack(result := result, year := year, season := season), ({B.STAGE_ORD}, -year, {B.SEASON_ORD})) FILTER (WHERE result IS NOT NULL"
CAREER = f"""career AS MATERIALIZED (SELECT entity, count(*) FILTER (WHERE season = 'spring') AS spring, count(*) FILTER (WHERE season = 'summer') AS summer,
  count(*) AS total, sum(coalesce(wins, 0))::BIGINT AS wins, sum(coalesce(losses, 0))::BIGINT AS losses, min(year) AS first_year, max(year) AS last_year,
  max(year) FILTER (WHERE season = 'spring') AS last_spring, max(year) FILTER (WHERE season = 'summer') AS last_summer,
  count(*) FILTER (WHERE result = '優勝') AS titles, count(*) FILTER (WHERE result = '準優勝') AS runner_ups, count(*) FILTER (WHERE result IN ('優勝', '準優勝', 'ベスト4')) AS final_fours,
  {_BEST}) AS best, {_BEST} AND season = 'spring') AS best_spring, {_BEST} AND season = 'summer') AS best_summer,
  list_sort(list(DISTINCT year) FILTER (WHERE {BERTH})) AS berth_years
  FROM app WHERE season IN ('spring', 'summer') AND entity IN (SELECT entity FROM ent) GROUP BY entity),
rated AS MATERIALIZED (SELECT *, CASE WHEN wins + losses > 0 THEN wins::DOUBLE / (wins + losses)::DOUBLE END AS win_rate FROM career)"""
WITH = B.cte("app", "ent", "dim") + ",\n" + CAREER + "\n"


def _flat(df: DataFrame, *structs: str) -> DataFrame:
    for s in structs:
        df = df.withColumns({f"{s}_result": F.col(s)["result"], f"{s}_year": F.col(s)["year"], f"{s}_season": F.col(s)["season"]}).drop(s)
    return df


@query(WITH + """SELECT entity, spring, summer, total, wins, losses, win_rate, first_year, last_year, last_spring, last_summer, titles, runner_ups, final_fours,
  best.result AS best_result, best.year AS best_year, best.season AS best_season, best_spring.result AS best_spring_result, best_summer.year AS best_summer_year,
  coalesce(array_to_string(berth_years, ','), '') AS berth_years FROM rated""")
def career_stats(spark: SparkSession, d: str) -> DataFrame:
    out = careers(spark, d, berths=True).withColumn("berth_years", F.array_join("berth_years", ","))
    return out.select("*", F.col("best.result").alias("best_result"), F.col("best.year").alias("best_year"), F.col("best.season").alias("best_season"), F.col("best_spring.result").alias("best_spring_result"), F.col("best_summer.year").alias("best_summer_year")).drop("best", "best_spring", "best_summer")


@query(B.cte("app") + f"""SELECT entity, arg_min(result, (ord, -year)) AS latest_best, max(year) AS last_year FROM (SELECT *, {B.STAGE_ORD} AS ord FROM app WHERE result IS NOT NULL) GROUP BY entity""")
def best_stage_latest_year(spark: SparkSession, d: str) -> DataFrame:
    known = B.appearances(spark, d).filter("result is not null")
    return known.groupBy("entity").agg(F.min_by("result", F.struct(ladder_ordinal(F.col("result"), B.STAGES), -F.col("year"))).alias("latest_best"), F.max("year").alias("last_year"))


@query(WITH + "SELECT result, ord, count(*) AS n FROM (SELECT result, " + B.STAGE_ORD + " AS ord FROM app) GROUP BY ALL")
def ladder_histogram(spark: SparkSession, d: str) -> DataFrame:
    return B.appearances(spark, d).select("result", ladder_ordinal(F.col("result"), B.STAGES).alias("ord")).groupBy("result", "ord").agg(F.count("*").alias("n"))


@query(WITH + """SELECT e.entity, coalesce(spring, 0) AS spring, coalesce(summer, 0) AS summer, coalesce(spring, 0) + coalesce(summer, 0) AS total, last_year FROM ent e
  LEFT JOIN (SELECT entity, count(*) FILTER (WHERE season = 'spring') AS spring, count(*) FILTER (WHERE season = 'summer') AS summer, max(year) AS last_year FROM app GROUP BY 1) a USING (entity)""")
def appearance_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.appearance_counts(B.entities(spark, d), B.appearances(spark, d), "entity")


@query(WITH + "SELECT district, district_name, region, coalesce(n, 0) AS n FROM dim LEFT JOIN (SELECT district, count(*) AS n FROM ent WHERE kind = 'BUILDING' AND balance > 9000 GROUP BY 1) USING (district)")
def category_counts_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return stats.category_counts(B.districts(spark, d), B.entities(spark, d).filter("kind = 'BUILDING' and balance > 9000"), ["district"])


_SHARES = """tot AS (SELECT year, season, count(*) AS total FROM app WHERE NOT (year = 1993 AND season = 'autumn') GROUP BY ALL),
shares AS (SELECT year, season, n, total, n::DOUBLE / total::DOUBLE AS share FROM (SELECT year, season, count(*) AS n FROM app WHERE result = '優勝' GROUP BY ALL) JOIN tot USING (year, season) WHERE total > 0)"""


def _year_shares(spark: SparkSession, d: str) -> DataFrame:
    app = B.appearances(spark, d)
    totals = app.filter("not (year = 1993 and season = 'autumn')").groupBy("year", "season").agg(F.count("*").alias("total"))
    return stats.period_shares(app.filter("result = '優勝'"), totals, ["year", "season"])


@query(WITH + "," + _SHARES + "SELECT * FROM shares")
def year_share(spark: SparkSession, d: str) -> DataFrame:
    return _year_shares(spark, d)


@query(WITH + "," + _SHARES + """SELECT (year // 10 * 10)::INT AS decade, sum(n)::BIGINT AS n, sum(total)::BIGINT AS total, count(*) AS periods, sum(n)::DOUBLE / sum(total)::DOUBLE AS share FROM shares GROUP BY 1""")
def decade_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.decade_rollup(_year_shares(spark, d), "year", "n", "total")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return careers(spark, d).join(B.entities(spark, d).select("entity", "name", "district"), "entity")


@query(WITH + f"""SELECT d.district, district_name, region, coalesce(entities, 0) AS entities, coalesce(total, 0) AS total, coalesce(spring, 0) AS spring, coalesce(summer, 0) AS summer, coalesce(wins, 0) AS wins, coalesce(titles, 0) AS titles,
  best.result AS best_result, best.year AS best_year, best.season AS best_season, last_year FROM dim d LEFT JOIN (
  SELECT district, count(*) AS entities, sum(total)::BIGINT AS total, sum(spring)::BIGINT AS spring, sum(summer)::BIGINT AS summer, sum(wins)::BIGINT AS wins, sum(titles)::BIGINT AS titles,
   arg_min(struct_pack(result := result, year := year, season := season), ({B.STAGE_ORD}, -year, {B.SEASON_ORD})) FILTER (WHERE result IS NOT NULL) AS best, max(last_year) AS last_year
   FROM (SELECT district, total, spring, summer, wins, titles, last_year, best.result AS result, best.year AS year, best.season AS season FROM rated JOIN ent USING (entity)) GROUP BY 1) USING (district)""")
def district_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _flat(stats.district_rollup(_placed(spark, d), B.districts(spark, d), "district", B.STAGES, B.SEASONS), "best")


@query(WITH + "SELECT best.result AS stage, count(*) AS n, string_agg(entity::VARCHAR, ',' ORDER BY total DESC, entity) AS members FROM rated WHERE best IS NOT NULL GROUP BY 1")
def best_stage_groups(spark: SparkSession, d: str) -> DataFrame:
    return stats.stage_groups(careers(spark, d), "entity").withColumn("members", F.array_join("members", ","))


@query(WITH + """SELECT count(*) AS entities, sum(total)::BIGINT AS appearances, count(*) FILTER (WHERE titles > 0) AS champions, count(*) FILTER (WHERE best IS NULL) AS unknown, max(last_year) AS latest, (SELECT count(DISTINCT year) FROM app) AS years FROM rated""")
def summary_tiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary_tiles(careers(spark, d), B.appearances(spark, d))


_LATEST = """pick AS (SELECT d.district, district_name, region, s.e[1] AS spring_entity, s.e[2] AS spring_year, m.e[1] AS summer_entity, m.e[2] AS summer_year FROM dim d
  LEFT JOIN (SELECT district, max_by([entity, last_spring], (last_spring, spring, -entity)) AS e FROM rated JOIN ent USING (entity) WHERE last_spring IS NOT NULL GROUP BY 1) s USING (district)
  LEFT JOIN (SELECT district, max_by([entity, last_summer], (last_summer, summer, -entity)) AS e FROM rated JOIN ent USING (entity) WHERE last_summer IS NOT NULL GROUP BY 1) m USING (district))"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    picks = ranking.latest_by_group_season(_placed(spark, d), B.districts(spark, d), "district", "entity", {"sp": ("last_spring", "spring"), "su": ("last_summer", "summer")})
    return picks.select("district", "district_name", "region", F.col("sp.entity").alias("spring_entity"), F.col("sp.year").alias("spring_year"), F.col("su.entity").alias("summer_entity"), F.col("su.year").alias("summer_year"))


@query(WITH + "," + _LATEST + "SELECT * FROM pick")
def latest_by_district_season(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d)


@query(WITH + "," + _LATEST + """SELECT n AS newest, count(*) FILTER (WHERE spring_year = n) AS in_spring_year, count(*) FILTER (WHERE summer_year = n) AS in_summer_year, count(*) FILTER (WHERE spring_year = n OR summer_year = n) AS in_any
  FROM pick, (SELECT greatest(max(spring_year), max(summer_year)) AS n FROM pick) GROUP BY n""")
def latest_year_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.latest_coverage(_latest(spark, d), ["spring_year", "summer_year"])


@query(B.cte("evt") + """, v AS (SELECT target, action, count(*) AS votes FROM evt GROUP BY ALL) SELECT target, action, votes, sum(votes) OVER (PARTITION BY target)::BIGINT AS poll_votes,
  floor(votes * 100.0::DOUBLE / sum(votes) OVER (PARTITION BY target) + 0.5::DOUBLE)::BIGINT AS percent FROM v""")
def vote_percent(spark: SparkSession, d: str) -> DataFrame:
    votes = B.events(spark, d).groupBy("target", "action").agg(F.count("*").alias("votes"))
    return stats.vote_percent(votes, "target", "votes")


@query(B.cte("brk") + """SELECT tournament, team, count(*) AS games, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'draw') AS draws FROM (
  SELECT tournament, winner AS team, CASE WHEN winner % 10 = loser % 10 THEN 'draw' ELSE 'win' END AS outcome FROM brk UNION ALL SELECT tournament, loser, CASE WHEN winner % 10 = loser % 10 THEN 'draw' ELSE 'loss' END FROM brk) GROUP BY ALL""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    tie = F.col("winner") % 10 == F.col("loser") % 10
    sides = g.select("tournament", F.explode(F.array(F.struct(F.col("winner").alias("team"), F.when(tie, "draw").otherwise("win").alias("outcome")), F.struct(F.col("loser").alias("team"), F.when(tie, "draw").otherwise("loss").alias("outcome")))).alias("s"))
    return stats.run_summary(sides.select("tournament", "s.*"), ["tournament", "team"], "outcome")


_BERTHS = "berth AS (SELECT DISTINCT entity, year, 'spring' AS season FROM app WHERE season = 'spring' AND losses > wins), found AS (SELECT b.entity, b.year, b.season, result FROM berth b LEFT JOIN (SELECT * FROM app WHERE result IS NOT NULL) a USING (entity, year, season))"


def _berths(spark: SparkSession, d: str) -> DataFrame:
    app = B.appearances(spark, d)
    berths = app.filter("season = 'spring' and losses > wins").select("entity", "year", F.lit("spring").alias("season")).distinct()
    return stats.berth_lookup(berths, app.filter("result is not null"), ["entity", "year", "season"])


@query(WITH + "," + _BERTHS + "SELECT * FROM found")
def berth_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _berths(spark, d).select("entity", "year", "season", "result")


@query(WITH + "," + _BERTHS + f"SELECT d.district, district_name, region, coalesce(berths, 0) AS berths, best_result FROM dim d LEFT JOIN (SELECT district, count(*) AS berths, arg_min(result, {B.STAGE_ORD}) FILTER (WHERE result IS NOT NULL) AS best_result FROM found JOIN ent USING (entity) GROUP BY 1) USING (district)")
def berth_rollup(spark: SparkSession, d: str) -> DataFrame:
    placed = _berths(spark, d).join(B.entities(spark, d).select("entity", "district"), "entity")
    return stats.berth_rollup(placed, B.districts(spark, d), "district", B.STAGES)


@query(B.cte("brk") + "SELECT tournament, count(*) AS games, (SELECT count(DISTINCT t) FROM (SELECT winner AS t FROM brk x WHERE x.tournament = b.tournament UNION ALL SELECT loser FROM brk x WHERE x.tournament = b.tournament)) AS entries FROM brk b GROUP BY 1")
def tournament_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.tournament_summary(B.bracket_games(spark, d), ["tournament"])


@query("SELECT year(o_orderdate) AS year, o_custkey AS entity, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplicate_keys(table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("entity")), ["year", "entity"])


for _name, _value, _where in (("total", "total", "total > 0"), ("spring", "spring", "spring > 0"), ("summer", "summer", "summer > 0"), ("wins", "wins", "wins > 0"), ("rate", "win_rate", "wins + losses >= 10")):

    def _rank(spark: SparkSession, d: str, value: str = _value, where: str = _where) -> DataFrame:
        return ranking.rank_by(careers(spark, d), value, F.expr(where), wide=value == "win_rate").select("entity", value, "rank")

    _rank.__name__ = f"tied_rank_{_name}"
    query(WITH + f"SELECT entity, {_value}, rank() OVER (ORDER BY {_value} DESC) AS rank FROM rated WHERE {_where}")(_rank)


@query(WITH + "SELECT entity, last_year, total FROM rated ORDER BY last_year DESC, total DESC, entity LIMIT 50")
def recent(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(careers(spark, d).select("entity", "last_year", "total"), [F.col("last_year").desc(), F.col("total").desc(), F.col("entity")], 50)


@query(WITH + "SELECT entity, last_year, total FROM rated WHERE total >= 5 ORDER BY last_year, total DESC, entity LIMIT 50")
def long_absence(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(careers(spark, d).filter("total >= 5").select("entity", "last_year", "total"), [F.col("last_year"), F.col("total").desc(), F.col("entity")], 50)


@query(B.cte("ent") + """SELECT *, (SELECT count(*) FROM ent WHERE balance >= 0) AS total, (SELECT ceil(count(*) / 40)::BIGINT FROM ent WHERE balance >= 0) AS pages FROM (SELECT entity, name, balance FROM ent WHERE balance >= 0 ORDER BY balance DESC, entity LIMIT 40 OFFSET 80)""")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page_slice(B.entities(spark, d).filter("balance >= 0").select("entity", "name", "balance"), [F.col("balance").desc(), F.col("entity")], 3.7, 40)


@query(B.cte("ent") + "SELECT entity, name FROM ent WHERE entity > 500 ORDER BY entity LIMIT 40")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return ranking.after_key(B.entities(spark, d).select("entity", "name"), "entity", 500, 40)


@query(WITH + "SELECT entity, year, season, result FROM app ORDER BY year DESC NULLS LAST, " + B.SEASON_ORD + " DESC, entity LIMIT 200")
def season_ordered(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(B.appearances(spark, d).select("entity", "year", "season", "result"), [F.col("year").desc_nulls_last(), ladder_ordinal(F.col("season"), B.SEASONS).desc(), F.col("entity")], 200)


@query(B.cte("ent") + """SELECT district, entity, balance FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY kind = 'BUILDING' DESC, balance DESC, entity) AS rn FROM ent) WHERE rn <= 4 ORDER BY kind = 'BUILDING' DESC, balance DESC, entity LIMIT 80""")
def per_group_topk_then_global(spark: SparkSession, d: str) -> DataFrame:
    order = [(F.col("kind") == "BUILDING").desc(), F.col("balance").desc(), F.col("entity")]
    return ranking.top_k_then_n(B.entities(spark, d), ["district"], order, 4, 80).select("district", "entity", "balance")


_LSS = """e AS (SELECT target, CASE WHEN month(ts) % 3 = 0 THEN 'spring' WHEN month(ts) % 3 = 1 THEN 'summer' ELSE 'autumn' END AS season, ts, event_id, action FROM evt),
n AS (SELECT target, arg_max(season, (ts, event_id)) AS season FROM e GROUP BY 1), r AS (SELECT e.* FROM e JOIN n USING (target, season))"""


@query(B.cte("evt") + "," + _LSS + """SELECT target, season, event_id, total, labels FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts DESC, event_id DESC) AS rn FROM r) JOIN (SELECT target, count(*) AS total, string_agg(DISTINCT action, ',' ORDER BY action) AS labels FROM r GROUP BY 1) USING (target) WHERE rn <= 5""")
def latest_season_slice(spark: SparkSession, d: str) -> DataFrame:
    m = F.month("ts") % 3
    e = B.events(spark, d).withColumn("season", F.when(m == 0, "spring").when(m == 1, "summer").otherwise("autumn"))
    return ranking.latest_season_slice(e, "target", "season", "ts", "event_id", 5, "action").select("target", "season", "event_id", "total", "labels")


@query(B.cte("evt") + """, m AS (SELECT *, CASE WHEN action IS NOT DISTINCT FROM lag(action) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM evt WINDOW w AS (PARTITION BY target ORDER BY ts, event_id)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY target ORDER BY ts, event_id) AS run FROM m) SELECT target, run::BIGINT AS run, action, count(*) AS n, min(event_id) AS first_key, max(event_id) AS last_key FROM r GROUP BY ALL""")
def date_runs(spark: SparkSession, d: str) -> DataFrame:
    return ranking.consecutive_runs(B.events(spark, d), ["target"], ["ts", "event_id"], "action")


@query(B.cte("evt") + "SELECT event_id, ((month(ts) * 100 + day(ts)) * 100 + coalesce(target % 100, 0))::BIGINT AS recency FROM evt ORDER BY recency DESC, event_id LIMIT 100")
def recency_order(spark: SparkSession, d: str) -> DataFrame:
    keyed = B.events(spark, d).select("event_id", ranking.recency_key(F.month("ts"), F.dayofmonth("ts"), F.col("target") % 100).cast("long").alias("recency"))
    return ranking.top_n(keyed, [F.col("recency").desc(), F.col("event_id")], 100)


@query(B.cte("ent") + "SELECT entity, name FROM ent ORDER BY md5('board:' || entity), entity LIMIT 60")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.seeded_sample(B.entities(spark, d).select("entity", "name"), "entity", "board", 60)


@query(B.cte("ent", "dim") + """, c AS (SELECT dim.district, coalesce(n, 0) AS n FROM dim LEFT JOIN (SELECT district, count(*) AS n FROM ent WHERE balance > 5000 GROUP BY 1) USING (district)),
 p AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM c WHERE n > 0), k AS (SELECT count(DISTINCT n) AS kinds FROM p),
 cut AS (SELECT DISTINCT n AS low FROM p, k WHERE kinds <= 5 OR i IN (SELECT floor(m * j / 5)::BIGINT FROM (SELECT unnest(range(5)) AS j)))
 SELECT district, n, CASE WHEN n > 0 THEN (SELECT count(*) FROM cut WHERE low <= n) ELSE 0 END::INT AS band FROM c""")
def quantile_bands(spark: SparkSession, d: str) -> DataFrame:
    counts = stats.category_counts(B.districts(spark, d), B.entities(spark, d).filter("balance > 5000"), ["district"])
    return ranking.quantile_bands(counts.select("district", "n"), "n", 5)


@query(B.cte("evt") + """SELECT CASE WHEN a >= b THEN 'views' ELSE 'clicks' END AS source, greatest(a, b)::VARCHAR AS date FROM (SELECT max(ts::DATE) FILTER (WHERE action = 'view') AS a, max(ts::DATE) FILTER (WHERE action = 'click') AS b FROM evt)""")
def freshest_source(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumn("day", F.to_date("ts"))
    return ranking.freshest(e.filter("action = 'view'"), e.filter("action = 'click'"), "day", ("views", "clicks")).withColumn("date", F.col("date").cast("string"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.tied_rank(careers(spark, d), "total")
    return ranking.top_n(ranked.select("rank", "entity", "total", "wins", "losses", "win_rate", F.col("best.result").alias("best_result")), [F.col("rank"), F.col("entity")], 100)
