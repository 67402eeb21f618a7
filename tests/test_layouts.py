"""The extraction job over layout specifications, with hand-made pages."""

import datetime

from tallywick.operators import layouts
from tallywick.operators.layouts import Layout

TABLE = {"rows": r"(?is)<tr\b[^>]*>(.*?)</tr>", "cells": r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"}
SPECS = {
    "inline": Layout(**TABLE, games="inline", in_cell=True),
    "pair": Layout(**TABLE, games="pair", context="月", header="計"),
    "blocks": Layout(rows=r"([^\n]+)", cells=r"([^|]*)(?:\||$)", games="blocks", context="令和|球場", header="^team$"),
}


def pages(spark, rows):
    return spark.createDataFrame(rows, "id int, layout string, html string, year int")


def read(df, specs=SPECS):
    got = layouts.extract_games(df, specs, "id", "layout", "html", "year")
    return [tuple(r) for r in got.orderBy("id", "n", "block").drop("layout", "n").collect()]


def test_inline_rows_hold_several_games_and_carry_their_context(spark):
    html = (
        "<tr><td>2024年7月19日 県営球場 準決勝</td><td>長野 5 - 6 松商  東海 ２ － ９x 松本</td></tr>"
        "<tr><td>伊那球場</td><td>上田 1 ー 0 諏訪</td></tr><tr><td>2024/7/20</td><td>上田 1-1 上田</td></tr>"
    )
    day, next_day = datetime.date(2024, 7, 19), datetime.date(2024, 7, 20)
    assert read(pages(spark, [(1, "inline", html, 2024)])) == [
        (1, 0, day, "semi", "県営球場", "長野", 5, "松商", 6, "松商", None),
        (1, 1, day, "semi", "県営球場", "東海", 2, "松本", 9, "松本", None),
        (1, 0, day, "semi", "伊那球場", "上田", 1, "諏訪", 0, "上田", None),
        (1, 0, next_day, None, None, "上田", 1, "上田", 1, None, "one team"),
    ]


def test_pairs_take_the_rightmost_number_and_name_their_problem(spark):
    head = "<tr><th>校名</th><th>計</th></tr>"
    side = "<tr><td>{}</td><td>{}</td><td>{}</td><td></td></tr>"
    html = head + side.format("A", 1, 2) + side.format("B", 0, 3) + "<tr><td>7月1日</td></tr>" + head + side.format("C", "", "") + side.format("D", 1, "x") + head + side.format("E", 1, 1)
    day = datetime.date(2023, 7, 1)
    assert read(pages(spark, [(1, "pair", html, 2023)])) == [
        (1, 0, None, None, None, "A", 2, "B", 3, None, "no date"),
        (1, 0, day, None, None, "C", None, "D", 1, None, "no score"),
    ]


def test_blocks_of_different_widths(spark):
    html = "令和6年5月1日\n山球場 決勝\nteam|1|計|team|1|2\nA|9|1|C|1|2\nB|9|0|--|0|4\n"
    day = datetime.date(2024, 5, 1)
    assert read(pages(spark, [(1, "blocks", html, None)])) == [
        (1, 0, day, "final", "山球場", "A", 1, "B", 0, "A", None),
        (1, 1, day, "final", "山球場", "C", 3, "--", 4, None, "placeholder"),
    ]


def test_odd_pages_and_a_new_layout(spark):
    assert read(pages(spark, [(1, "other", "<tr>", 1), (2, "inline", None, 1), (3, "pair", "", None), (4, None, "x", 1)])) == []
    assert read(pages(spark, [])) == []
    specs = SPECS | {"lines": Layout(rows=r"([^;]+)", cells=r"([^,]*)(?:,|$)", games="inline", in_cell=True)}
    got = read(pages(spark, [(5, "lines", "8月9日,A 1-0 B;,C 0-2 D", 2020), (6, "inline", "x", 2020)]), specs)
    assert [(r[2], r[5], r[9]) for r in got] == [(datetime.date(2020, 8, 9), "A", "A"), (datetime.date(2020, 8, 9), "C", "D")]


def test_all_layouts_share_one_scan_and_one_plan(spark):
    df = pages(spark, [(1, "inline", "x", 1)]).repartition(3)
    plan = layouts.extract_games(df, SPECS, "id", "layout", "html", "year")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan and "Join" not in plan
