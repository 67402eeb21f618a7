"""Queries of the extraction jobs: documents are composed from given rows and read back by the operators;
the SQL twins state the expected rows from the same rows, without any document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import extract as X
from tallywick.operators import layouts as L
from tallywick.operators import tournament
from tallywick.operators import wikitext as W
from tallywick.plans.catalog import query
from tallywick.session import table


def text(*parts: Column | str) -> Column:
    """Columns as they are, strings as text, one after another."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def joined(df: DataFrame, key: str, order: list[str], line: Column, name: str, between: str = "") -> DataFrame:
    """One text per key of its rows' lines in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("__line"))))
    return df.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["__line"]), between).alias(name))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT - 1 AS row FROM lineitem)
 SELECT l_orderkey, row, cell, CASE cell WHEN 0 THEN l_linenumber::VARCHAR WHEN 1 THEN 'P' || l_partkey || ' &' ELSE '' END AS text FROM l, (SELECT unnest(range(3))::INT AS cell)""")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """O-111 over one table per order."""
    c = F.col
    row = text('<TR class="r">\n<td>', c("l_linenumber"), "</td><th scope=row> <b>P", c("l_partkey"), "</b>&amp;</th><td><!-- empty --></td></TR>\n")
    pages = joined(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], row, "html")
    return X.table_cells(pages, "l_orderkey", "html")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS h FROM orders),
 w AS (SELECT *, lead(o_orderkey, 1) OVER w AS a, lead(o_orderkey, 2) OVER w AS b, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
 SELECT o_custkey, o_orderkey AS header, a AS first, b AS second FROM w WHERE h AND NOT h1 AND NOT h2""")
def row_pairs(spark: SparkSession, d: str) -> DataFrame:
    """O-114: urgent orders as headers, the two orders after each as its sides."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    pairs = X.pair_rows(o, ["o_custkey"], ["o_orderkey"], F.col("o_orderpriority") == "1-URGENT", ["o_orderkey"])
    return pairs.select("o_custkey", F.col("o_orderkey").alias("header"), F.col("o_orderkey_1").alias("first"), F.col("o_orderkey_2").alias("second"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 40 WHEN l_linenumber % 3 > 0 THEN l_suppkey % 30 END::INT AS total FROM lineitem")
def number_cells(spark: SparkSession, d: str) -> DataFrame:
    """O-115: the first cell is a name, blanks and x are skipped."""
    odd, some = F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") % 3 > 0
    second = F.when(some, text(F.col("l_suppkey") % 30)).otherwise("")
    last = F.when(odd, text(F.col("l_partkey") % 40)).otherwise("x")
    cells = F.array(text(F.col("l_partkey")), second, last, F.lit(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", X.rightmost_number(cells).alias("total"))


DASHES = "-−－–—ー‐"


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_partkey % 20 END::INT AS a, CASE WHEN l_linenumber < 7 THEN l_suppkey % 20 END::INT AS b,
  CASE WHEN l_linenumber < 7 THEN l_linenumber IN (2, 3) END AS walk_off, CASE WHEN l_linenumber = 5 THEN '延長' || l_partkey % 15 || '回' END AS note FROM lineitem""")
def score_cells(spark: SparkSession, d: str) -> DataFrame:
    """O-116: seven dashes, a walk-off mark on either side, notes of extra innings, cells without a score."""
    n, c = F.col("l_linenumber"), F.col
    dash = F.substring(F.lit(DASHES), (c("l_orderkey") % len(DASHES) + 1).cast("int"), F.lit(1))
    mark = [F.when(n == k, "x").otherwise("") for k in (2, 3)]
    note = F.when(n == 5, text("（延長", c("l_partkey") % 15, "回）")).otherwise("")
    cell = F.when(n < 7, text(c("l_partkey") % 20, mark[0], " ", dash, " ", c("l_suppkey") % 20, mark[1], note)).otherwise(text("P", c("l_partkey")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.score_cell(cell).alias("s"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "s.*")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS x, o_orderkey % 5 AS y, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 90)::VARCHAR WHEN 1 THEN '' ELSE 'x' END AS stated FROM orders)
 SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT - 1 AS block, (o_orderkey % 30)::VARCHAR || ',' || x || ',x,' || y || CASE WHEN o_orderkey % 4 > 0 THEN ',' || stated ELSE '' END AS cells,
  CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 = 0 THEN o_orderkey % 90 ELSE x + y END::INT AS total FROM o""")
def side_blocks(spark: SparkSession, d: str) -> DataFrame:
    """O-117: a row of a customer's orders side by side, each under a team column; the names are numbers,
    three of four blocks have a total column, and a third of those a number in it."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    stated = F.when(k % 3 == 0, text(k % 90)).when(k % 3 == 1, "").otherwise("x")
    head, cell = F.array(*map(F.lit, ["team", "1", "2", "3"])), F.array(text(k % 30), text(k % 7), F.lit("x"), text(k % 5))
    head, cell = (F.when(k % 4 > 0, F.concat(a, F.array(b))).otherwise(a) for a, b in ((head, F.lit("計")), (cell, stated)))
    every = F.sort_array(F.collect_list(F.struct("o_orderkey", head.alias("h"), cell.alias("c"))))
    rows = o.groupBy("o_custkey").agg(every.alias("e"))
    rows = rows.select("o_custkey", F.flatten("e.h").alias("header"), F.flatten("e.c").alias("cells"))
    return X.unpivot_blocks(rows, ["o_custkey"], "header", "cells", "^team$").select("o_custkey", "block", F.array_join("cells", ",").alias("cells"), "total")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'N' || o_orderkey END AS name, o_orderpriority IN ('3-MEDIUM', '5-LOW') AS bare, o_orderstatus = 'P' AS stop FROM orders),
 s AS (SELECT *, coalesce(sum(CASE WHEN stop OR NOT bare THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM o),
 h AS (SELECT o_custkey, seg, arg_max(name, o_orderkey) AS half FROM s WHERE bare AND NOT stop AND name <> '' GROUP BY ALL)
 SELECT o_custkey, o_orderkey, coalesce(half, '') || name AS name FROM s LEFT JOIN h USING (o_custkey, seg) WHERE NOT bare AND NOT stop""")
def wrapped_names(spark: SparkSession, d: str) -> DataFrame:
    """O-118: the last name without a score prefixes the next scored row, over rows that are empty; rows of
    status P stop that."""
    name = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(text("N", F.col("o_orderkey")))
    score = F.when(~F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW"), F.col("o_totalprice"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", name.alias("name"), score.alias("score"), "o_orderstatus")
    return X.join_wrapped(o, ["o_custkey"], ["o_orderkey"], "name", "score", F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name LIKE 'small%' OR p_name LIKE '%widget' OR p_size = 11)")
def real_rows(spark: SparkSession, d: str) -> DataFrame:
    """O-120: template rows, dashes and titles of other events are no rows."""
    name = F.when(F.col("p_size") == 11, "--").otherwise(F.col("p_name")).alias("shown")
    return X.reject_placeholders(table(spark, d, "part").select("p_partkey", "p_name", name), "shown", ["^small", "widget$", "^--$"]).drop("shown")


@query("""SELECT s_suppkey, n, CASE n WHEN 2 THEN '* ' || s_name WHEN 3 THEN '=== Sub ===' WHEN 4 THEN '* ' || s_nationkey END AS line FROM supplier, (SELECT unnest([2, 3, 4])::INT AS n)
  UNION ALL SELECT s_suppkey, 5, '' FROM supplier WHERE s_suppkey % 2 = 1""")
def wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    """O-122: a section ends at the next heading of its level or higher, not at one below it."""
    after = F.when(F.col("s_suppkey") % 2 == 0, "== Next ==\nlost\n=== Teams of it ===\nlost").otherwise("")
    page = text("= Top =\n== Teams ==\n* ", F.col("s_name"), "\n=== Sub ===\n* ", F.col("s_nationkey"), "\n", after)
    return X.wiki_section(table(spark, d, "supplier").select("s_suppkey", page.alias("page")), "s_suppkey", "page", "Teams")


@query("""SELECT p_partkey, p_name || '-' || p_brand || '}}' AS plain, p_name || '-{{Round8|' || p_size || '|' || repeat('{{x', (p_partkey % 30)::INT) || repeat('}}', (p_partkey % 30)::INT) || '}}' || p_brand || '}}'
  || CASE WHEN p_partkey % 5 = 0 THEN '{{rest of ' || p_size ELSE '' END AS kept FROM part""")
def wiki_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """O-123: all templates gone, and note templates alone, with references and what both nest, up to
    30 deep; an end without a beginning stays, a beginning without an end takes the rest."""
    p, c = table(spark, d, "part"), F.col
    deep = (c("p_partkey") % 30).cast("int")
    nest = text(F.repeat(F.lit("{{efn|{{x|"), deep), c("p_type"), F.repeat(F.lit("}}}}"), deep))
    note = text(c("p_name"), "{{Efn|see {{Cite|", c("p_type"), "}}<ref>x|y</ref> and\n{{r|z}}", nest, "}}<ref name=\"a\"/>-")
    kept = text("{{Round8|", c("p_size"), "|", F.repeat(F.lit("{{x"), deep), F.repeat(F.lit("}}"), deep), "}}")
    tail = text(c("p_brand"), "<ref name=b>{{", c("p_type"), "}}</ref>}}", F.when(c("p_partkey") % 5 == 0, text("{{rest of ", c("p_size"))).otherwise(""))
    pages = p.select("p_partkey", text(note, kept, tail).alias("plain")).withColumn("kept", c("plain"))
    return X.strip_templates(X.strip_templates(pages, "p_partkey", "plain"), "p_partkey", "kept", W.NOTES)


@query("""SELECT p_partkey, 0 AS place, p_name || '高等学校 (' || p_brand || ')' AS target, p_type AS label, true AS school FROM part
  UNION ALL SELECT p_partkey, 1, p_name || '大会', p_name || '大会', false FROM part""")
def wiki_link_targets(spark: SparkSession, d: str) -> DataFrame:
    """O-124: targets and labels of links, and which are schools."""
    c = F.col
    line = text("a [[", c("p_name"), "高等学校 (", c("p_brand"), ")|", c("p_type"), "]] and [[", c("p_name"), "大会]].")
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(X.wiki_links(line)).alias("place", "l"))
    return rows.select("p_partkey", "place", "l.target", "l.label", W.is_school(F.col("l.target")).alias("school"))


@query("""SELECT c_nationkey, c_name || '高等学校' || CASE WHEN c_custkey % 3 = 0 THEN ' (三重県)' ELSE '' END AS article, 'S' || c_custkey % 50 AS short,
  CASE WHEN c_custkey % 3 = 0 THEN '三重,' ELSE '' END || '長崎' AS prefs, c_custkey % 5 IN (1, 3) AS withdrew, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 || '年連続' || c_custkey % 9 || '回目' END AS appearance FROM customer WHERE c_custkey % 7 > 0""")
def wiki_participants(spark: SparkSession, d: str) -> DataFrame:
    """O-125: table and list lines with notes, lines repeated, and lines with two schools, by nation."""
    k, c = F.col("c_custkey"), F.col
    school = text("[[", c("c_name"), "高等学校", F.when(k % 3 == 0, " (三重県)").otherwise(""), "|S", k % 50, "]]")
    times = F.when(k % 4 > 0, text(k % 4, "年連続", k % 9, "回目")).otherwise("")
    note = F.when(k % 5 == 1, "<ref>病気のため棄権。</ref>").when(k % 5 == 2, "<ref name=x>[[他の高等学校]]の出場辞退による</ref>").when(k % 5 == 3, "{{efn|参加を辞退}}").otherwise("")
    other = F.when(k % 7 == 0, "[[別の高等学校]]").otherwise("[[長崎県]]")
    line = text(F.when(k % 2 == 0, "* ").otherwise("| "), other, school, " ", times, note)
    lines = table(spark, d, "customer").select("c_nationkey", F.explode(F.array(F.struct((k * 2).alias("n"), line.alias("line")), F.struct((k * 2 + 1).alias("n"), F.when(k % 2 == 0, line).otherwise(text("|-", line)).alias("line")))).alias("x"))
    found = W.participants(lines.select("c_nationkey", "x.*"), "c_nationkey", "n", "line")
    return found.select("c_nationkey", "article", "short", F.array_join("prefs", ",").alias("prefs"), "withdrew", "appearance")


def game_pages(spark: SparkSession, d: str) -> DataFrame:
    """A result section per customer, whose orders are its games in four layouts."""
    k, c = F.col("o_orderkey"), F.col
    a, b = text("A", k), text("B", k)
    x, y = k % 10, F.floor(k / 10).cast("long") % 10
    bracket = F.when(c("o_orderstatus") == "P", text("|x|", a, "（不戦勝）||", b, "|\n")).otherwise(text("|8月[[日|", k % 30, "日]]|[[", a, "高校|", a, "]]|", x, "|'''", b, "'''{{Efn|name=\"q|r\"}}|", y, "x\n"))
    row = text("|rowspan=3|8月8日||第1試合||", a, "||", x, " － ", y, "x||", b, "||1時間\n|-\n")
    bullet = text("* 8月", k % 30, "日 [[", a, "高校|", a, "]] ", x, " - ", y, "x ", b, "\n")
    box = text("{{Linescore\n|Road=[[", a, "]] |RR=", x, "\n|Home=", b, "\n|HR = ", y, "\n}}\n")
    kind = k % 4
    line = F.when(kind == 0, bracket).when(kind == 1, row).when(kind == 2, bullet).when(kind == 3, box)
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    pages = table(spark, d, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    part = [F.array_join(F.transform(F.filter("rows", lambda r: r["o_orderkey"] % 4 == i), lambda r: r["line"]), "") for i in range(4)]
    section = text("=== 準決勝 ===\n", part[1], "=== 2回戦 ===\n", part[2], "{{Round8\n|RD1='''決勝'''\n", part[0], "}}\n", part[3])
    return pages.select("o_custkey", section.alias("section"))


_GAMES = """WITH o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey % 4 AS kind, o_orderkey % 10 AS x, o_orderkey // 10 % 10 AS y, o_orderstatus = 'P' AS walked FROM orders),
 g AS (SELECT *, CASE WHEN x > y THEN 'A' ELSE 'B' END || k AS winner, CASE WHEN x > y THEN 'B' ELSE 'A' END || k AS loser FROM o WHERE x <> y AND NOT (kind = 0 AND walked)),
 f AS (SELECT DISTINCT o_custkey FROM g WHERE kind = 0)"""


@query(_GAMES + """ SELECT o_custkey, CASE kind WHEN 0 THEN 'bracket' WHEN 1 THEN 'table' ELSE 'bullet' END AS layout, winner, loser, CASE kind WHEN 0 THEN '決勝' WHEN 1 THEN '準決勝' END AS round FROM g WHERE kind < 3
 UNION ALL SELECT * FROM (SELECT o_custkey, 'linescore', arg_min(winner, k), arg_min(loser, k), '決勝' FROM g WHERE kind = 3 GROUP BY 1) WHERE o_custkey NOT IN (SELECT o_custkey FROM f)""")
def wiki_games(spark: SparkSession, d: str) -> DataFrame:
    """O-126: four layouts, the line score only where no bracket has a decided final."""
    return W.games(game_pages(spark, d), "o_custkey", "section")[0].drop("n")


@query("SELECT DISTINCT o_custkey, 'B' || o_orderkey AS loser FROM orders WHERE o_orderkey % 4 = 0 AND o_orderstatus = 'P'")
def wiki_walkovers(spark: SparkSession, d: str) -> DataFrame:
    """O-95 in brackets: the side that the other's walkover names."""
    return W.games(game_pages(spark, d), "o_custkey", "section")[1]


@query("SELECT l_orderkey % 100 AS tournament, 'B' || l_suppkey AS team FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber % 2 = 0")
def walkovers(spark: SparkSession, d: str) -> DataFrame:
    """O-95: games without scores that their note marks; the second side loses."""
    n, c = F.col("l_linenumber"), F.col
    score = F.when(n % 2 == 1, text(n)).when(n == 2, " ")
    note = F.when(c("l_returnflag") == "R", "不戦勝").when(c("l_returnflag") == "A", "延長")
    rows = table(spark, d, "lineitem").select((c("l_orderkey") % 100).alias("tournament"), text("A", c("l_partkey")).alias("a"), text("B", c("l_suppkey")).alias("b"), score.alias("x"), score.alias("y"), note.alias("note"))
    return tournament.walkover_losers(rows, "a", "b", "x", "y", "note")


@query("""WITH r AS (SELECT p_size, p_partkey, p_name, p_brand, p_partkey % 3 AS kind, p_partkey % 5 > 0 AS own FROM part),
 n AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey)::INT - 1 AS n FROM r),
 y AS (SELECT *, last_value(CASE WHEN own THEN 2000 + p_partkey % 20 END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY n ROWS UNBOUNDED PRECEDING)::INT AS year FROM n)
 SELECT p_size, n, year, CASE WHEN problem IS NULL THEN p_brand END AS region, CASE WHEN problem IS NULL THEN p_name || '高等学校' END AS article, CASE WHEN problem IS NULL THEN p_name END AS display,
  CASE WHEN problem IS NULL AND kind = 1 THEN '沖縄' END AS prefecture, problem
 FROM (SELECT *, CASE WHEN year IS NULL THEN 'no year' WHEN kind = 2 THEN 'no link' END AS problem FROM y)""")
def berth_table(spark: SparkSession, d: str) -> DataFrame:
    """O-127: a table per size; four of five rows state a year, a third of the rows has no link."""
    k, c = F.col("p_partkey"), F.col
    year = F.when(k % 5 > 0, text('| rowspan="2" style="x"|', 2000 + k % 20, "年<br>第", k % 90, "回\n")).otherwise("")
    school = F.when(k % 3 == 2, text("|| none ")).otherwise(text("||[[", c("p_name"), "高等学校|'''", c("p_name"), "''']]", F.when(k % 3 == 1, "<br />（沖縄）").otherwise("")))
    row = text(year, "|align=center|", F.substring(c("p_brand"), 1, 2), "<br/> ", F.substring(c("p_brand"), 3, 99), school, "\n|{{small|x|y}}note ", k)
    pages = joined(table(spark, d, "part"), "p_size", ["p_partkey"], text("\n|-\n", row), "rows")
    return W.berths(pages.select("p_size", text("{| class=wikitable\n!年!!地区", F.col("rows")).alias("page")), "p_size", "page")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN year(o_orderdate) END::INT AS year FROM orders")
def infobox_years(spark: SparkSession, d: str) -> DataFrame:
    """O-128: the year of an infobox, null where the field is empty."""
    year = F.when(F.col("o_orderkey") % 6 > 0, F.date_format("o_orderdate", "yyyy")).otherwise("")
    page = text("{{Infobox\n| name = 1999\n| year = ", year, "\n| yearly = 1234\n}}")
    return table(spark, d, "orders").select("o_orderkey", X.infobox_year(page, "year").alias("year"))


#: Layouts of the game pages below: a table whose first cell is the context, a list of line scores, and
#: sheets of games side by side.
LAYOUTS = {
    "daily table": L.Layout(rows=r"(?is)<tr\b[^>]*>(.*?)</tr>", cells=r"(?is)<td\b[^>]*>(.*?)</td>", games="inline", in_cell=True),
    "line scores": L.Layout(rows=r"(?is)<(?:h3|tr)\b[^>]*>(.*?)</(?:h3|tr)>", cells=r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", games="pair", context="月|球場|回戦|決勝", header="^チーム"),
    "sheet": L.Layout(rows=r"([^\n]+)", cells=r"([^\t]*)(?:\t|$)", games="blocks", context="令和|球場|決勝", header="^校名$", placeholder="^(?:--|組合せ.*)$"),
}


def layout_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page per customer in one of four layouts, of which the last is unknown; its orders are games."""
    k, c = F.col("o_orderkey"), F.col
    o = table(spark, d, "orders").withColumn("day", F.add_months(F.to_date("o_orderdate"), 360))
    a, b = text("A", k), F.when(c("o_orderstatus") == "P", "--").otherwise(text("B", k))
    x, y = k % 10, F.floor(k / 10).cast("long") % 10
    dated, staged = c("o_orderpriority") != "5-LOW", c("o_orderpriority") != "4-NOT SPECIFIED"
    wide = F.translate(x.cast("string"), "0123456789", "０１２３４５６７８９")
    full = F.when(dated, text(F.year("day"), "年", F.month("day"), "月", F.dayofmonth("day"), "日")).otherwise("")
    short = text(F.month("day"), "月", F.dayofmonth("day"), "日")
    era = text("令和", F.year("day") - 2018, "年", short)
    stage = F.when(staged, text("P", k % 50, "球場 ", k % 4 + 1, "回戦")).otherwise("")
    daily = text("<tr><td>", full, " ", stage, "</td><td>", a, "  ", wide, " － ", y, "x ", b, "<br>C", k, " ", y, "-", x, " D", k, "</td></tr>\n")
    line = text(F.when(dated, text("<h3>", short, "</h3>")).otherwise(""), F.when(staged, text("<h3>■", stage, "</h3>")).otherwise(""), "<tr><th>チーム<th>1</th><th>計</th></tr><tr><td>", a, "</td><td>1</td><td>", wide, "</td><td></td></tr><tr><td>", b, "</td><td>0</td><td>", y, "</td><td>x</td></tr>\n")
    sheet = text(F.when(dated, text(era, "\n")).otherwise(""), F.when(staged, text(stage, "\n")).otherwise(""), "校名\t1\t2\t計\t校名\t1\n", a, "\t4\t4\t", x, "\tC", k, "\t", y, "\n", b, "\t4\t4\t", y, "\tD", k, "\t", x, "\n")
    kinds = [joined(o.filter(c("o_custkey") % 4 == i), "o_custkey", ["o_orderkey"], part, "html").withColumn("layout", F.lit(name)) for i, (part, name) in enumerate(((daily, "daily table"), (line, "line scores"), (sheet, "sheet"), (daily, "unknown")))]
    pages = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])
    return pages.withColumn("year", F.lit(2028))


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS k, o_custkey % 4 AS kind, (o_orderdate::DATE + INTERVAL 30 YEAR)::DATE AS day, o_orderkey % 10 AS x, o_orderkey // 10 % 10 AS y, o_orderstatus = 'P' AS held, o_orderpriority <> '5-LOW' AS dated, o_orderpriority <> '4-NOT SPECIFIED' AS staged FROM orders WHERE o_custkey % 4 < 3),
 r AS (SELECT *, CASE WHEN dated THEN CASE kind WHEN 1 THEN make_date(2028, month(day), day(day)) ELSE day END END AS own FROM o),
 c AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS date FROM r),
 g AS (SELECT *, unnest(CASE kind WHEN 1 THEN [0] ELSE [0, 1] END)::INT AS block FROM c),
 t AS (SELECT *, CASE WHEN block = 0 THEN 'A' ELSE 'C' END || k AS a, CASE WHEN block = 1 THEN 'D' || k WHEN held THEN '--' ELSE 'B' || k END AS b, CASE WHEN block = 0 THEN x ELSE y END::INT AS sx, CASE WHEN block = 0 THEN y ELSE x END::INT AS sy FROM g),
 p AS (SELECT *, CASE WHEN b = '--' THEN 'placeholder' WHEN date IS NULL THEN 'no date' END AS problem FROM t)
 SELECT o_custkey, CASE kind WHEN 0 THEN 'daily table' WHEN 1 THEN 'line scores' ELSE 'sheet' END AS layout, block, date, CASE WHEN staged THEN 'round ' || (k % 4 + 1) END AS round, CASE WHEN staged THEN 'P' || k % 50 || '球場' END AS venue,
  a, sx AS x, b, sy AS y, CASE WHEN problem IS NULL AND sx > sy THEN a WHEN problem IS NULL AND sx < sy THEN b END AS winner, problem FROM p""")
def layout_games(spark: SparkSession, d: str) -> DataFrame:
    """§2.8 as one job: three layouts in one scan, from pages to checked games; dates carry forward, and
    round and venue begin anew with them."""
    return L.extract_games(layout_pages(spark, d), LAYOUTS, "o_custkey", "layout", "html", "year").drop("n")
