"""Queries for name matching, key allocation, audits and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import audit, keys, resolve, upsert
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.plans.tournament_queries import teams
from tallywick.session import table


@query("""WITH c AS (SELECT p_partkey AS k, unnest([lower(p_name), regexp_replace(lower(p_name), ' .*$', ''), regexp_replace(lower(p_name), '^.* ', '')]) AS label, unnest([0, 1, 2]) AS place FROM part),
 m AS (SELECT DISTINCT regexp_replace(lower(p_name), '^.* ', '') AS label, 'M' || regexp_replace(lower(p_name), '^.* ', '') AS target FROM part WHERE p_partkey % 3 = 0)
 SELECT k AS p_partkey, arg_min(place, place) AS place, arg_min(target, (place, target)) AS target FROM c JOIN m USING (label) GROUP BY k""")
def candidate_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"))
    last = F.regexp_replace("n", "^.* ", "")
    master = p.filter("p_partkey % 3 = 0").select(last.alias("label"), F.concat(F.lit("M"), last).alias("target")).distinct()
    forms = F.array("n", F.regexp_replace("n", " .*$", ""), last)
    return resolve.candidate_match(p, "p_partkey", forms, master, "label", "target").select("p_partkey", "place", "target")


@query("SELECT n_nationkey AS source, n_regionkey AS target FROM nation WHERE n_nationkey % 2 = 0")
def confirmed_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.when(F.col("n_nationkey") % 5 != 3, F.col("n_nationkey") % 2 == 0).otherwise(F.when(F.col("n_nationkey") % 2 == 0, True)).alias("sure"))
    return resolve.confirmed_map(n, "source", "target", "sure")


@query(B.cte("ent") + "SELECT entity, CASE WHEN district % 4 = 1 THEN (district + 1) % 25 ELSE district END AS district, CASE WHEN district % 4 = 1 THEN district END AS former FROM ent")
def successor_rewrite(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("old"), ((F.col("n_nationkey") + 1) % 25).alias("new"))
    return resolve.rewrite_successors(B.entities(spark, d).select("entity", "district"), "district", n, "old", "new").select("entity", "district", "former")


_SCOPED = """l AS (SELECT c_nationkey AS district, 'N' || (c_custkey * 7 % 400) AS label, c_custkey AS target FROM customer WHERE c_custkey % 2 = 0),
 r AS (SELECT c_custkey AS id, c_nationkey AS district, 'N' || (c_custkey * 11 % 500) AS label FROM customer),
 near AS (SELECT district, label, count(DISTINCT target) AS hits, min(target) AS t FROM l GROUP BY ALL), wide AS (SELECT label, count(DISTINCT target) AS hits, min(target) AS t FROM l GROUP BY ALL),
 m AS (SELECT id, CASE WHEN near.hits IS NOT NULL THEN CASE WHEN near.hits = 1 THEN near.t END ELSE CASE WHEN wide.hits = 1 THEN wide.t END END AS target, coalesce(near.hits, wide.hits, 0) AS hits FROM r LEFT JOIN near USING (district, label) LEFT JOIN wide USING (label))"""


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("district"))
    labels = c.filter("id % 2 = 0").select("district", F.concat(F.lit("N"), (F.col("id") * 7 % 400).cast("string")).alias("label"), F.col("id").alias("target"))
    rows = c.withColumn("label", F.concat(F.lit("N"), (F.col("id") * 11 % 500).cast("string")))
    return resolve.scoped_unique_match(rows, labels, "district", "label", "target").select("id", "target", "hits")


@query("WITH " + _SCOPED + "SELECT * FROM m")
def scoped_unique_match(spark: SparkSession, d: str) -> DataFrame:
    return _scoped(spark, d)


@query("WITH " + _SCOPED + "SELECT id, hits FROM m WHERE hits > 1")
def ambiguity_report(spark: SparkSession, d: str) -> DataFrame:
    return resolve.ambiguous(_scoped(spark, d)).select("id", "hits")


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS district, 'N' || c_custkey % 30 AS label, c_custkey AS target FROM customer WHERE c_custkey % 3 = 0),
 w AS (SELECT c_nationkey AS district, 'N' || c_custkey % 30 AS label, c_custkey AS target FROM customer WHERE c_custkey % 3 = 1)
 SELECT * FROM s UNION ALL SELECT district, label, min(target) FROM w ANTI JOIN s USING (district, label) GROUP BY ALL""")
def weak_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("district"), F.concat(F.lit("N"), (F.col("c_custkey") % 30).cast("string")).alias("label"), F.col("c_custkey").alias("target"))
    return resolve.add_weak_labels(c.filter("target % 3 = 0"), c.filter("target % 3 = 1"), "district", "label", "target")


_APP2 = "rows AS (SELECT year, 'S' || entity % 60 AS name, entity FROM app WHERE season = 'summer' AND entity % 2 = 0), part AS (SELECT year, name, count(DISTINCT entity) AS n, min(entity) AS t FROM (SELECT year, 'S' || entity % 60 AS name, entity FROM app WHERE season = 'spring') GROUP BY ALL)"


@query(B.cte("app") + "," + _APP2 + "SELECT r.year, r.entity, CASE WHEN r.entity % 4 = 0 THEN r.entity WHEN n = 1 THEN t END AS target, CASE WHEN r.entity % 4 = 0 THEN 'direct' WHEN n = 1 THEN 'event' END AS via FROM rows r LEFT JOIN part USING (year, name)")
def second_chance_match(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("S"), (F.col("entity") % 60).cast("string")).alias("name")
    app = B.appearances(spark, d)
    rows = app.filter("season = 'summer' and entity % 2 = 0").select("year", name, "entity", F.when(F.col("entity") % 4 == 0, F.col("entity")).alias("target"))
    seen = app.filter("season = 'spring'").select("year", name, F.col("entity").alias("target"))
    return resolve.second_chance(rows, rows, seen, ["year"], "name", "name", "target").select("year", "entity", "target", "via")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS word FROM documents), k AS (SELECT DISTINCT string_split(text, ' ')[1] AS source FROM benchmark WHERE text <> ''),
 cand AS (SELECT k.source, d.doc_id AS target, starts_with(d.text, k.source || ' ') AS redirect FROM k JOIN w ON word = k.source JOIN documents d USING (doc_id)),
 mas AS (SELECT doc_id AS target FROM labels WHERE quality = 1), kn AS (SELECT * FROM cand WHERE target IN (SELECT target FROM mas)),
 r AS (SELECT source, min(target) AS r FROM kn WHERE redirect GROUP BY 1), m AS (SELECT kn.source, list_sort(list(DISTINCT target)) AS m FROM kn JOIN documents d ON d.doc_id = kn.target AND contains(d.text, kn.source) GROUP BY 1)
 SELECT source, coalesce(r, CASE WHEN len(m) = 1 THEN m[1] END) AS target, CASE WHEN r IS NOT NULL THEN 'redirect' WHEN len(m) = 1 THEN 'mutual' ELSE 'pending' END AS how, coalesce(len(m), 0)::INT AS n_mutual FROM (SELECT DISTINCT source FROM cand) LEFT JOIN r USING (source) LEFT JOIN m USING (source)""")
def mutual_reference(spark: SparkSession, d: str) -> DataFrame:
    """O-46: first words of the items, candidates every document that has the word, by a join on words;
    documents that begin with it redirect, those rated good are the master."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("target"), F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("target", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("source"))
    items = table(spark, d, "benchmark").filter("text <> ''").select(F.split("text", " ")[0].alias("source")).distinct()
    pairs = words.join(items, "source").select("source", "target", F.expr("startswith(text, source || ' ')").alias("redirect"))
    master = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").cast("long").alias("target"))
    return resolve.mutual_references(pairs, docs, master, "source", "target", "text", "redirect")


@query("""WITH o AS (SELECT o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS k, o_orderstatus AS label FROM orders)
 SELECT 'source' AS side, k, count(*) AS n, regexp_matches(label, '^[OF]') AS looks_public FROM o WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY k, label UNION ALL
 SELECT 'master', c_custkey, 0, NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)""")
def unmatched_both_ways(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1000000).otherwise(0)).alias("k"), F.col("o_orderstatus").alias("label"))
    return resolve.unmatched_both_ways(o, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", "^[OF]", "label")


@query("""WITH f AS (SELECT p_partkey AS k, unnest([lower(p_name), regexp_replace(lower(p_name), '^.* ', '')]) AS label, unnest([0, 1]) AS place FROM part),
 ro AS (SELECT DISTINCT regexp_replace(lower(p_name), '^.* ', '') || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS label FROM part WHERE p_partkey % 50 < 3),
 u AS (SELECT k, place, f.label, 'form' AS how FROM f JOIN ro USING (label) UNION ALL SELECT k, place + 1000, ro.label, 'completed' FROM f JOIN ro ON ro.label = f.label || 's')
 SELECT k AS p_partkey, arg_min(label, (place, label, how)) AS label, arg_min(how, (place, label, how)) AS how FROM u GROUP BY 1""")
def roster_membership(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"))
    last = F.regexp_replace("n", "^.* ", "")
    roster = p.filter("p_partkey % 50 < 3").select(F.concat(last, F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("label")).distinct()
    return resolve.roster_members(p, "p_partkey", F.array("n", last), roster, "label", ["s"])


@query("""WITH RECURSIVE c AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, p AS plain, lower(p_brand) AS kind, 's' || p_size % 5 AS dist FROM (SELECT *, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS p FROM part)),
 f AS (SELECT p_partkey, rn, [plain, plain || '-' || kind, dist || '-' || plain, dist || '-' || plain || '-' || kind, plain || '-2', plain || '-3', plain || '-4'] AS cands FROM c),
 g AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS taken, NULL::VARCHAR AS key, NULL::BIGINT AS id
   UNION ALL SELECT f.rn, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, x, p_partkey FROM (SELECT f.*, g.taken, list_filter(f.cands, lambda y: NOT list_contains(g.taken, y))[1] AS x FROM g JOIN f ON f.rn = g.rn + 1) f)
 SELECT id AS p_partkey, key FROM g WHERE rn > 0""")
def slug_allocation(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    forms = keys.key_forms(F.col("p_name"), F.lower("p_brand"), F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")))
    return keys.allocate_keys(p.select("p_partkey", F.col("p_partkey").alias("prio"), "p_name", "p_brand", "p_size"), "p_partkey", "prio", forms).select("p_partkey", "key")


@query(B.cte("ent") + "SELECT entity, CASE WHEN CASE WHEN district < 10 THEN balance > 5000 ELSE kind = 'BUILDING' END THEN 'published' ELSE 'draft' END AS status, CASE WHEN district < 10 THEN 'roster' ELSE 'name' END AS by FROM ent")
def publish_decision(spark: SparkSession, d: str) -> DataFrame:
    e = B.entities(spark, d)
    return keys.publish_decision(e, "entity", "district", B.districts(spark, d).filter("district < 10"), e.filter("balance > 5000"), F.col("kind") == "BUILDING").select("entity", "status", "by")


@query(B.cte("app") + """, n AS (SELECT *, CASE WHEN entity % 3 = 0 THEN (entity % 9) || '回目' END AS note FROM app)
 SELECT entity, season, counted, stated FROM (SELECT entity, season, count(*) AS counted, try_cast(nullif(regexp_extract(arg_max(note, year) , '([0-9]+)回目', 1), '') AS BIGINT) AS stated FROM n GROUP BY ALL) WHERE stated IS NOT NULL AND stated <> counted""")
def audit_stated_counts(spark: SparkSession, d: str) -> DataFrame:
    n = B.appearances(spark, d).withColumn("note", F.when(F.col("entity") % 3 == 0, F.concat((F.col("entity") % 9).cast("string"), F.lit("回目"))))
    return audit.stated_counts(n, ["entity", "season"], "year", "note", "([0-9]+)回目")


@query(B.cte("app") + "SELECT entity, year, season, losses, CASE WHEN result = '優勝' THEN 0 ELSE 1 END AS expected_losses FROM app WHERE result IS NOT NULL AND losses IS NOT NULL AND NOT year <= 1993 AND losses <> CASE WHEN result = '優勝' THEN 0 ELSE 1 END")
def audit_invariants(spark: SparkSession, d: str) -> DataFrame:
    return audit.knockout_invariant(B.appearances(spark, d), "優勝", F.col("year") <= 1993).select("entity", "year", "season", "losses", "expected_losses")


@query(B.cte("brk") + """, g AS (SELECT tournament, ord, CASE t.top - round WHEN 0 THEN 'final' WHEN 1 THEN 'semi' WHEN 2 THEN 'quarter' END AS label FROM brk JOIN (SELECT tournament, max(round) AS top FROM brk GROUP BY 1) t USING (tournament) WHERE loser % 7 <> 0),
 c AS (SELECT tournament, label, count(*) AS n, CASE label WHEN 'final' THEN 1 WHEN 'semi' THEN 3 ELSE 4 END AS expected FROM g WHERE label IS NOT NULL GROUP BY ALL)
 SELECT tournament, label, n, expected, CASE WHEN n > expected THEN 'too many' ELSE 'too few' END AS finding FROM c WHERE n > expected OR (n < expected AND tournament <> 'MACHINERY')""")
def audit_tail_rounds(spark: SparkSession, d: str) -> DataFrame:
    g = B.bracket_games(spark, d)
    tops = g.groupBy("tournament").agg(F.max("round").alias("top"))
    back = F.col("top") - F.col("round")
    g = g.join(tops, "tournament").withColumn("label", F.when(back == 0, "final").when(back == 1, "semi").when(back == 2, "quarter")).filter("loser % 7 <> 0")
    return audit.tail_rounds(g, {"final": 1, "semi": 3, "quarter": 4}, g.filter("tournament = 'MACHINERY'"))


@query(B.cte("brk") + ", e AS (SELECT tournament, count(*) AS entries FROM seeded GROUP BY 1), g AS (SELECT tournament, count(*) AS games FROM brk WHERE ord % 9 <> 0 AND tournament <> 'BUILDING' GROUP BY 1) SELECT tournament, entries, games, entries - 1 - games AS missing FROM e JOIN g USING (tournament) WHERE entries - 1 - games > 0")
def audit_game_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return audit.game_shortfall(teams(spark, d), B.bracket_games(spark, d).filter("ord % 9 <> 0 and tournament <> 'BUILDING'"))


@query(B.cte("brk") + "SELECT tournament, team, count(*) AS games FROM (SELECT tournament, winner AS team FROM brk UNION ALL SELECT tournament, loser FROM brk) WHERE team % 11 = 0 GROUP BY ALL")
def audit_strangers(spark: SparkSession, d: str) -> DataFrame:
    return audit.strangers(B.bracket_games(spark, d), teams(spark, d).filter("team % 11 <> 0"))


@query(B.cte("app") + "SELECT DISTINCT entity, year + 1 AS year FROM app WHERE season = 'spring' AND result = '優勝' AND year + 1 <> 1998 AND (entity, year + 1) NOT IN (SELECT (entity, year) FROM app WHERE season = 'spring')")
def audit_berths(spark: SparkSession, d: str) -> DataFrame:
    app = B.appearances(spark, d).filter("season = 'spring'")
    berths = app.filter("result = '優勝'").select("entity", (F.col("year") + 1).alias("year")).distinct()
    return audit.berths_without_facts(berths, app, ["entity", "year"], F.col("year") == 1998)


@query(B.cte("app") + """SELECT entity, year, season, CASE WHEN o_orderkey % 3 = 0 THEN 'ベスト8' END AS parsed, CASE WHEN o_orderkey % 3 = 0 THEN 'fillable' WHEN year >= 1998 THEN 'in progress' ELSE 'unresolved' END AS plan FROM app WHERE result IS NULL""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    app = B.appearances(spark, d)
    parsed = app.select("entity", "year", "season", F.when(F.col("o_orderkey") % 3 == 0, "ベスト8").alias("result"))
    return audit.repair_plan(app, parsed, ["entity", "year", "season"], F.col("year") >= 1998)


@query("SELECT label, actual, expected, actual IS NOT DISTINCT FROM expected AS ok FROM (SELECT 'nation' AS label, count(*) AS actual, 25 AS expected FROM nation UNION ALL SELECT 'region', count(*), 4 FROM region UNION ALL SELECT 'orders', count(*), NULL FROM orders)")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.expected_counts({n: table(spark, d, n) for n in ("nation", "region", "orders")}, {"nation": 25, "region": 4})


@query("""SELECT conv_id, turn, unnest(list_filter([CASE WHEN NOT length(text) BETWEEN 1 AND 200 THEN 'body' END, CASE WHEN NOT length(role) BETWEEN 1 AND 20 THEN 'name' END, CASE WHEN NOT turn < 6 THEN 'turn' END], lambda x: x IS NOT NULL)) AS rule FROM conversations""")
def audit_constraints(spark: SparkSession, d: str) -> DataFrame:
    rules = {"body": F.length("text").between(1, 200), "name": F.length("role").between(1, 20), "turn": F.col("turn") < 6}
    return audit.violations(table(spark, d, "conversations"), ["conv_id", "turn"], rules)


@query("""WITH s AS (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1) SELECT doc_id, CASE WHEN NOT lang IN ('en', 'de', 'fr') THEN 'lang' WHEN NOT n_chars >= 200 THEN 'short' WHEN text IN (SELECT text FROM s) THEN 'shared' END AS excluded FROM documents""")
def shared_value_exclusion(spark: SparkSession, d: str) -> DataFrame:
    tests = {"lang": F.col("lang").isin("en", "de", "fr"), "short": F.col("n_chars") >= 200}
    return audit.shared_values(table(spark, d, "documents"), "text", "doc_id", tests).select("doc_id", "excluded")


@query(B.cte("evt") + "SELECT event_id FROM evt QUALIFY row_number() OVER (PARTITION BY ts::DATE, target, visitor % 10 ORDER BY event_id) = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumn("day", F.to_date("ts")).withColumn("side", F.col("visitor") % 10)
    return audit.first_wins(e, ["day", "target", "side"], ["event_id"]).select("event_id")


@query("""WITH g AS (SELECT l_orderkey % 100 AS t, l_partkey AS a, l_suppkey AS b, CASE WHEN l_linenumber = 3 THEN 'x' ELSE (l_partkey % 5)::VARCHAR END AS x, (l_suppkey % 5)::VARCHAR AS y FROM lineitem)
 SELECT DISTINCT t, CASE WHEN try_cast(x AS INT) > try_cast(y AS INT) THEN a ELSE b END AS winner, CASE WHEN try_cast(x AS INT) > try_cast(y AS INT) THEN b ELSE a END AS loser FROM g WHERE try_cast(x AS INT) <> try_cast(y AS INT)""")
def decisive_games(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    g = l.select((F.col("l_orderkey") % 100).alias("t"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_linenumber") == 3, "x").otherwise((F.col("l_partkey") % 5).cast("string")).alias("x"), (F.col("l_suppkey") % 5).cast("string").alias("y"))
    return audit.decisive_games(g, "a", "b", "x", "y", ["t"])


@query("SELECT lang, source, count(*) AS n FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY ALL")
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "source", "text").dropDuplicates().groupBy("lang", "source").agg(F.count("*").alias("n"))


_NEW = "n AS (SELECT c_custkey AS id, 'new' AS name, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 'added', 0.0 FROM customer WHERE c_custkey % 50 = 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, c_acctbal AS bal FROM customer)"


def _upsert_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("name"), (F.col("c_acctbal") + 1).alias("bal"))
    return base, new.unionByName(c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1000000).alias("id"), F.lit("added").alias("name"), F.lit(0.0).alias("bal")))


@query("WITH " + _NEW + " SELECT * FROM b WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n")
def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return upsert.do_update(*_upsert_sides(spark, d), ["id"])


@query("WITH " + _NEW + " SELECT * FROM b UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM b)")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    return upsert.do_nothing(*_upsert_sides(spark, d), ["id"])


@query("WITH " + _NEW + " SELECT b.id, coalesce(b.name, n.name) AS name, b.bal FROM b LEFT JOIN n USING (id)")
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    return upsert.fill_nulls(*_upsert_sides(spark, d), ["id"], ["name"])


@query("WITH " + _NEW + " SELECT b.id, coalesce(n.name, CASE WHEN NOT coalesce(b.name LIKE '%7', false) THEN b.name END) AS name, b.bal FROM b LEFT JOIN n USING (id)")
def clear_then_set(spark: SparkSession, d: str) -> DataFrame:
    return upsert.clear_then_set(*_upsert_sides(spark, d), ["id"], "name", F.col("name").like("%7"))


@query("SELECT 'customer' AS t, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    kept, (orders,) = upsert.delete_cascade(c, c.filter("c_acctbal < 0"), "c_custkey", [(table(spark, d, "orders"), "o_custkey")])
    return kept.agg(F.count("*").alias("n")).select(F.lit("customer").alias("t"), "n").unionByName(orders.agg(F.count("*").alias("n")).select(F.lit("orders").alias("t"), "n"))
