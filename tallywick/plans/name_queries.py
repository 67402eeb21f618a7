"""Queries of the column steps: names, registries, dates and scores, composed from given rows; the SQL
twins state what the composed text must come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.functions import names as N
from tallywick.plans.catalog import query
from tallywick.plans.document_queries import text
from tallywick.session import table

#: Addresses as they are written, and the place that each is in.
PLACES = (
    ("三重県四日市市富田", "四日市市"), ("大阪府大阪市北区", "大阪市"), ("群馬県佐波郡玉村町", "玉村町"), ("東京都八王子市館町", "八王子市"),
    ("愛知県蒲郡市三谷町", "蒲郡市"), ("北海道余市郡余市町黒川町", "余市町"), ("東京都東村山市恩多町", "東村山市"), ("佐賀県杵島郡大町町", "大町町"),
    ("福島県田村市船引町", "田村市"), ("東京都千代田区九段", "千代田区"), ("東京都八丈島八丈町大賀郷", "八丈町"), ("石川県野々市市三納", "野々市市"),
    ("福島県郡山市", "郡山市"), ("東京都神津島村", "神津島村"), ("福井県あわら市市姫", "あわら市"), ("沖縄県国頭郡恩納村", "恩納村"),
)
#: Official names around a name X, the founder's code, and kind, stem and display that they come to.
SCHOOLS = (
    ("千葉県立X高等学校", "2", "prefectural", "X", "X高校"), ("横浜市立X高等学校", "2", "municipal", "X", "X高校"), ("千葉県X高等学校", "2", "prefectural", "X", "X高校"),
    ("市立X高等学校Y分校", "2", "municipal", "XY分校", "X高校Y分校"), ("石川県立工業高等学校", "2", "prefectural", "石川県立工業", "石川県立工業高校"), ("X町立Y高等学校", "2", "town_village", "Y", "Y高校"),
    ("南北組合立X高等学校", "2", "combined", "X", "X高校"), ("X工業高等専門学校", "1", "national", "X工業", "X工業高専"), ("X学園", "3", None, "X学園", "X学園"),
    ("兵庫県立大学附属高等学校", "2", "prefectural", "兵庫県立大学附属", "兵庫県立大学附属高校"), ("X中等教育学校", "3", None, "X", "X中等教育学校"), ("小松市立高等学校", "2", "municipal", "小松市立", "小松市立高校"),
)


#: Names as sources write them (X: a name of the row) and the key that each comes to.
KEYS = (
    ("松本蟻ケ崎", "松本蟻ヶ崎"), ("松本蟻ヶ崎", "松本蟻ヶ崎"), ("赤　穗X（長野 1位）", "赤穂X"), ("中野立志舘X", "中野立志館X"), ("神埼清明X ", "神崎清明X"),
    ("神崎清明X", "神崎清明X"), ("宮﨑 濵田X(2)", "宮崎浜田X"), ("日本ｳｪﾙﾈｽX", "日本ウェルネスX"), ("齋澤邊X", "齋澤邊X"), ("飯 山X", "飯山X"),
)
#: Names of teams, and whether they join several.
TEAMS = (("農林･塩山", "1"), ("大東・小西", "1"), ("北信連合", "1"), ("寒川 藤沢総合　深沢", "1"), ("横 浜", "0"), ("佐渡", "0"), (" 大東 ", "0"))
#: School names, their spellings, their weak spelling, and those of district 熊本 alone.
LABELS = (
    ("X佐賀商業高校", "X佐賀商業高校,X佐賀商業,X佐賀商", None, ""), ("X農業高校", "X農業高校,X農業,X農", None, ""), ("X工業高校", "X工業高校,X工業,X工", None, ""),
    ("X阿南工業高専", "X阿南工業高専,X阿南高専", None, ""), ("X高等専門学校", "X高等専門学校,X高専", None, ""), ("X中等教育学校", "X中等教育学校", "X", ""),
    ("熊本県立第二高校", "熊本県立第二高校,熊本県立第二", None, "県立第二,第二"), ("熊本X高校", "熊本X高校,熊本X", None, "X"), ("熊本北高校", "熊本北高校,熊本北", None, ""), ("熊本高校", "熊本高校,熊本", None, ""),
)
#: Headings and the round that comes first in them.
HEADINGS = (
    ("準々決勝 決勝", "quarter"), ("１回戦 準決勝", "round 1"), ("決勝 1回戦", "final"), ("第三代表決定戦", "representative"), ("三位決定戦", "third place"), ("３位決定戦", "third place"),
    ("二回戦", "round 2"), ("十三回戦", "round 3"), ("1二回戦", "round 12"), ("準決勝第1試合", "semi"), ("開会式", None), ("決勝戦", "final"), ("準準決勝", "semi"),
)
#: Lines and the venue in them (X: a name of the row).
VENUES = (
    ("■X球場", "X球場"), ("【三回戦】さがみどりの森球場", "さがみどりの森球場"), ("Xドーム　第1試合", "Xドーム"), ("第2試合 （X）Xパーク", "Xパーク"), ("ベルーナドーム", "ベルーナドーム"),
    ("Xグラウンド", None), ("信州グリーンローズスタジアム", "信州グリーンローズスタジアム"), ("会場未定", None), ("X球場・Y球場", "X球場"),
)
#: Scores and words, folded (X: a number of the row).
FOLDS = (
    ("３ ー 2", "3-2"), ("X─2", "X-2"), ("　X ― ２ ", "X - 2"), ("ＡＢＣー", "ＡＢＣー"), ("ルーテルX", "ルーテルX"), ("1ー2ー3", "1-2ー3"), ("X　−‐‑‒–—－", "X -------"), ("（X）", "（X）"),
)
#: Files, and whether they may be photographs.
FILES = (
    ("X_Tamaplaza_High.jpg", "1"), ("X校舎.TIFF", "1"), ("X.png", "1"), ("X.SVG", "0"), ("X.svgz", "0"), ("Location map X.png", "0"), ("X位置図.png", "0"), ("X校章.jpg", "0"),
    ("Crest of X.jpg", "0"), ("Map of X.webp", "0"), ("X.svg.png", "1"), ("X白地図.gif", "0"), ("X flag.jpg", "1"),
)
#: School names with the displayed name and the label of a cap.
CAPS = (
    ("X商業高校", None, None, "X商業", "X商"), ("X高等学校", None, None, "X高等学校", "X高等学校"), ("X農業高校", "own X", None, "own X", "own X"), ("X工業高校", None, "県X工", "X工業", "県X工"),
    ("X工業高校", "X工業", None, "X工業", "X工"), ("X中等教育学校", None, None, "X中等教育学校", "X中等教育学校"), ("X高校Y分校", None, None, "X高校Y分校", "X高校Y分校"),
)


def case_of(df: DataFrame, rows: tuple, number: F.Column, own: F.Column) -> DataFrame:
    """df with `case`, the first text of the row's case, and its X replaced by the row's own name."""
    return df.withColumn("case", F.replace(pick(rows, 0, number % len(rows)), F.lit("X"), own))


def sql_values(rows: tuple, *names: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else f"'{v}'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join([str(i), *map(one, r)]) + ')' for i, r in enumerate(rows))}) v(i, {', '.join(names)}))"


def pick(rows: tuple, column: int, at: F.Column) -> F.Column:
    """The rows' value of a column at a place."""
    return F.element_at(F.array(*(F.lit(r[column]) for r in rows)), (at + 1).cast("int"))


@query(f"SELECT c_custkey, place AS city FROM customer JOIN {sql_values(PLACES, 'address', 'place')} ON i = c_custkey % {len(PLACES)}")
def municipalities(spark: SparkSession, d: str) -> DataFrame:
    """S-11 over addresses with a street number."""
    address = text(pick(PLACES, 0, F.col("c_custkey") % len(PLACES)), F.col("c_custkey"), "番地")
    return table(spark, d, "customer").select("c_custkey", N.municipality(address).alias("city"))


@query(f"""WITH s AS (SELECT c_custkey, c_name AS x, s.* FROM customer JOIN {sql_values(SCHOOLS, 'official', 'code', 'kind', 'stem', 'display')} s ON i = c_custkey % {len(SCHOOLS)})
 SELECT c_custkey, kind, replace(stem, 'X', x) AS stem, replace(display, 'X', x) AS display,
  CASE kind WHEN 'prefectural' THEN '県立' WHEN 'municipal' THEN '市立' WHEN 'town_village' THEN '町村立' WHEN 'combined' THEN '組合立' WHEN 'national' THEN '国立' END AS label,
  coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'own ' || c_custkey END, replace(display, 'X', x)) AS name,
  coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'own ' || c_custkey END, replace(display, 'X', x)) || ' ' || replace(official, 'X', x) || ' a b ' || CASE WHEN c_custkey % 4 > 0 THEN 'city' ELSE '' END AS search FROM s""")
def registry_names(spark: SparkSession, d: str) -> DataFrame:
    """S-09, S-10, S-12, S-15 and S-16 over one registry."""
    k, at = F.col("c_custkey"), F.col("c_custkey") % len(SCHOOLS)
    rows = table(spark, d, "customer").select("c_custkey", F.replace(pick(SCHOOLS, 0, at), F.lit("X"), F.col("c_name")).alias("official"), pick(SCHOOLS, 1, at).alias("code"))
    rows = rows.withColumns({"kind": N.establishment(F.col("official"), F.col("code"), F.lit("千葉県")), "s": N.split_name(F.col("official"), F.lit("千葉県"))})
    rows = rows.withColumns({"label": N.establishment_label(F.col("kind"), F.lit("千葉")), "own": F.when(k % 10 == 0, text("own ", k)), "shown": F.col("s.display"), "aliases": F.array(F.lit("a"), F.lit("b")), "city": F.when(k % 4 > 0, "city")})
    rows = rows.withColumn("name", N.override_chain("own", "shown"))
    return rows.select("c_custkey", "kind", "s.stem", "s.display", "label", "name", N.search_text("name", "official", F.col("aliases"), F.col("city")).alias("search"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'nishi' WHEN 1 THEN 'higashi' WHEN 2 THEN 'higashi' WHEN 3 THEN 'nishi' END || '-tokyo' AS capital,
  CASE WHEN c_nationkey < 3 THEN 'minami-hokkaido' WHEN c_nationkey < 20 THEN 'kita-hokkaido' END AS half FROM customer""")
def sub_districts(spark: SparkSession, d: str) -> DataFrame:
    """S-14: halves of the capital by ward and island, halves of the north by a table of offices."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    city = F.element_at(F.array(*map(F.lit, ["世田谷区", "中野区", "八丈町", "八王子市"])), (k % 5 + 1).cast("int"))
    office = F.when(n < len(N.SOUTH), F.element_at(F.array(*map(F.lit, N.SOUTH)), (F.least(n, F.lit(6)) + 1).cast("int"))).otherwise("上川")
    offices = table(spark, d, "nation").filter(n < 20).select(text("T", n).alias("town"), F.when(n < 3, office).otherwise("上川").alias("office"))
    rows = table(spark, d, "customer").select("c_custkey", N.capital_half(F.when(k % 5 < 4, city)).alias("capital"), text("T", F.col("c_nationkey")).alias("town"))
    return N.north_south(rows, "town", offices).select("c_custkey", "capital", "half")


@query(f"""SELECT p_partkey, replace(k.key, 'X', replace(p_name, ' ', '')) AS key, t.joint = '1' AS combined, replace(l.forms, 'X', p_name) || ',' || p_brand AS forms, replace(l.weak, 'X', p_name) AS weak,
  replace(l.local, 'X', p_name) AS local FROM part JOIN {sql_values(KEYS, 'name', 'key')} k ON k.i = p_partkey % {len(KEYS)} JOIN {sql_values(TEAMS, 'team', 'joint')} t ON t.i = p_partkey % {len(TEAMS)}
  JOIN {sql_values(LABELS, 'name', 'forms', 'weak', 'local')} l ON l.i = p_partkey % {len(LABELS)}""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """S-02, S-03, S-06 and S-07: keys, joined teams, spellings everywhere, weak ones, and in a district."""
    k, own = F.col("p_partkey"), F.col("p_name")
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    rows = case_of(rows, KEYS, k, own).withColumn("key", N.name_key(F.col("case")))
    rows = case_of(rows, TEAMS, k, own).withColumn("combined", N.is_combined(F.col("case")))
    rows = case_of(rows, LABELS, k, own)
    forms = F.array_join(N.label_candidates(F.col("case"), F.array("p_brand", F.lit(""))), ",")
    local = F.array_join(N.district_candidates(F.col("case"), F.lit("熊本")), ",")
    return rows.select("p_partkey", "key", "combined", forms.alias("forms"), N.weak_candidate(F.col("case")).alias("weak"), local.alias("local"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, replace(f.folded, 'X', l_partkey::VARCHAR) AS folded, r.round, replace(v.venue, 'X', 'P' || l_partkey) AS venue,
  CASE WHEN l_linenumber = 1 THEN 2019 WHEN l_linenumber < 4 THEN 2018 + l_suppkey % 10 WHEN l_linenumber < 7 THEN 1918 + l_partkey % 120 END::INT AS year
  FROM lineitem JOIN {sql_values(FOLDS, 'raw', 'folded')} f ON f.i = l_partkey % {len(FOLDS)} JOIN {sql_values(HEADINGS, 'heading', 'round')} r ON r.i = l_partkey % {len(HEADINGS)}
  JOIN {sql_values(VENUES, 'line', 'venue')} v ON v.i = l_partkey % {len(VENUES)}""")
def document_steps(spark: SparkSession, d: str) -> DataFrame:
    """S-01, S-04, S-05 and S-19: widths and dashes, rounds, venues, eras and editions."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    year = F.when(n == 1, "令和元年").when(n < 4, text("令和", F.col("l_suppkey") % 10, "年 第9回")).when(n < 7, text("第", k % 120, "回")).otherwise("秋季")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", N.era_year(year).alias("year"))
    rows = case_of(rows, FOLDS, k, k.cast("string")).withColumn("folded", N.fold_width(F.col("case")))
    rows = case_of(rows, HEADINGS, k, F.lit("")).withColumn("round", N.pick_round(F.col("case")))
    rows = case_of(rows, VENUES, k, text("P", k)).withColumn("venue", N.pick_venue(F.col("case")))
    return rows.drop("case")


@query(f"""SELECT o_orderkey, replace(c.shown, 'X', o_orderkey::VARCHAR) AS name, replace(c.cap, 'X', o_orderkey::VARCHAR) AS cap, o_orderkey % 5 + o_orderkey % 3 AS total,
  strftime(o_orderdate, '%Y.%m.%d') AS dotted, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS long, month(o_orderdate) || '月' || day(o_orderdate) || '日' AS short,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' END AS shown, o_orderdate::DATE::VARCHAR AS back,
  CASE WHEN o_orderkey % 3 = 1 THEN 'a' WHEN o_orderkey % 3 = 2 THEN 'b' WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'a' END AS own
  FROM orders JOIN {sql_values(CAPS, 'name', 'own', 'own_cap', 'shown', 'cap')} c ON c.i = o_orderkey % {len(CAPS)}""")
def display_steps(spark: SparkSession, d: str) -> DataFrame:
    """S-08, S-17, S-18 and S-26: short names and cap labels, totals, dates there and back, own side first."""
    k, date = F.col("o_orderkey"), F.to_date("o_orderdate")
    iso = F.when(k % 4 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    third = k % 3
    # one public side, or two of which one won
    sides = F.array(*(F.struct(F.lit(n).alias("n"), p.alias("public"), w.alias("won")) for n, p, w in (("a", third != 2, k % 2 == 1), ("b", third != 1, k % 2 == 0))))
    rows = table(spark, d, "orders").withColumns({"spring": k % 5, "summer": third})
    rows = N.with_total(rows, "total", "spring", "summer")
    name, own, own_cap = (F.replace(pick(CAPS, i, k % len(CAPS)), F.lit("X"), k.cast("string")) for i in range(3))
    back = N.yearless_date(N.japanese_date(date), F.year(date)).cast("string")
    return rows.select("o_orderkey", N.short_name(name, own).alias("name"), N.cap_label(name, own, own_cap).alias("cap"), "total", N.dotted_date(date).alias("dotted"), N.long_date(date).alias("long"), N.japanese_date(date).alias("short"), N.iso_shown(iso, year=True).alias("shown"), back.alias("back"), N.orient(sides)[0]["n"].alias("own"))


@query("""SELECT event_id, length(v) BETWEEN 16 AND 64 AND event_id % 5 > 0 AS ok FROM (SELECT event_id, repeat('aZ-_' || event_id % 10, (event_id % 16)::INT) AS v FROM events)""")
def visitor_keys(spark: SparkSession, d: str) -> DataFrame:
    """S-21: length and characters of visitor keys."""
    k = F.col("event_id")
    key = F.concat(F.repeat(text("aZ-_", k % 10), (k % 16).cast("int")), F.when(k % 5 == 0, "é").otherwise(""))
    return table(spark, d, "events").select("event_id", N.valid_visitor(key).alias("ok"))


@query("""SELECT o_orderkey, greatest(2 + o_orderkey % 4, 1 + o_orderkey % 3)::INT AS innings, array_to_string(list_transform(range(1 + o_orderkey % 4), lambda i: (i + o_orderkey) % 10), ',') || ',-' AS home,
  array_to_string(list_transform(range(1 + o_orderkey % 3), lambda i: i), ',') AS away, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 12 || '-' || o_orderkey % 7 END AS hits FROM orders""")
def inning_scores(spark: SparkSession, d: str) -> DataFrame:
    """S-23: walk-off and unplayed innings, the longer side's innings, hits only where both sides have them."""
    k = F.col("o_orderkey")
    home = F.concat(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(((i + k) % 10).cast("string"), F.when(i == k % 4, "x").otherwise(""))), F.array(F.lit("X")))
    away = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: i.cast("string"))
    totals = [F.struct(h.alias("h"), F.lit(None).cast("long").alias("e")) for h in (k % 12, F.when(k % 2 == 0, k % 7))]
    rows = table(spark, d, "orders").select("o_orderkey", N.linescore(home, away, *totals).alias("s"))
    runs = [F.array_join("s." + side, ",", "-").alias(side) for side in ("home", "away")]
    return rows.select("o_orderkey", "s.innings", *runs, F.array_join("s.hits", "-").alias("hits"))


@query(f"SELECT p_partkey, photo = '1' AS photo FROM part JOIN {sql_values(FILES, 'file', 'photo')} ON i = p_partkey % {len(FILES)}")
def photo_files(spark: SparkSession, d: str) -> DataFrame:
    """S-24: files that are no maps, marks or drawings."""
    rows = case_of(table(spark, d, "part").select("p_partkey", "p_name"), FILES, F.col("p_partkey"), F.col("p_name"))
    return rows.select("p_partkey", N.likely_photo(F.col("case")).alias("photo"))
