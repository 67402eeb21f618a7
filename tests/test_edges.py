"""Edge rows: nulls, ties, gaps, empty groups, drawn and missing games."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywick.operators import audit, community, extract, joins, ranking, search, stats, tournament, upsert, wikitext
from tallywick.operators.ladder import MISSING, UNKNOWN, ladder_ordinal

LADDER, SEASONS = ["gold", "silver", "semi"], ["spring", "summer", "autumn"]


@pytest.fixture(scope="module")
def careers(spark):
    facts = spark.createDataFrame(
        [
            (1, 2000, "spring", "gold", 5, 0), (1, 2000, "summer", "gold", 4, None), (1, 2001, "summer", None, None, None),
            (2, 1999, "spring", "odd", 0, 0), (3, 2001, "autumn", "gold", 3, 0), (4, 2001, "spring", "semi", 1, 1), (9, 2001, "spring", "gold", 1, 1),
        ],
        "entity int, year int, season string, result string, wins int, losses int",
    )
    visible = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entity int")
    return {r.entity: r for r in stats.career_stats(facts, visible, "entity", LADDER, SEASONS).collect()}


def test_career_visibility_and_autumn(careers):
    assert set(careers) == {1, 2, 4}  # 3 has autumn only, 9 is not visible


def test_career_null_semantics(careers):
    assert careers[1].total == 3 and careers[1].wins == 9 and careers[1].titles == 2
    assert careers[2].win_rate is None and careers[4].win_rate == 0.5
    assert careers[1].best.season == "spring"  # equal stage and year: the earlier season
    assert careers[2].best.result == "odd"  # an unknown label is a best of last resort


def test_ladder(spark):
    df = spark.createDataFrame([("gold",), ("odd",), (None,)], "r string").select(ladder_ordinal(F.col("r"), LADDER).alias("o"))
    assert [r.o for r in df.collect()] == [0, UNKNOWN, MISSING]


@pytest.mark.parametrize("wide", [False, True])
def test_ties(spark, wide):
    df = spark.createDataFrame([(k, v) for k, v in zip("abcde", [9.0, 7.0, 7.0, 7.0, 1.0], strict=True)], "k string, v double")
    got = {r.k: r["rank"] for r in ranking.tied_rank(df, "v", wide=wide).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 5}


def test_pages(spark):
    df = spark.range(25)
    assert [r.id for r in ranking.page_slice(df, [F.col("id")], 0, 10).collect()] == list(range(10))
    last = ranking.page_slice(df, [F.col("id")], 3.9, 10).collect()
    assert [r.id for r in last] == list(range(20, 25)) and last[0].pages == 3 and last[0].total == 25
    assert ranking.page_slice(df, [F.col("id")], 9, 10).count() == 0


def test_search_metacharacters(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "a_b"), (3, "c\\d"), (4, 'x,"y"'), (5, None), (6, "100x")], "id int, t string")

    def found(q):
        return [r.id for r in search.search(df, ["t"], q, [F.col("id")], 9).collect()]

    assert found("0%") == [1] and found("_") == [2] and found("\\") == [3] and found(',"') == [4] and found("") == [] and found("A_B") == [2]
    assert search.normal_query(" " + "x" * 99) == "x" * 60


def test_siblings_match_brute_force(spark):
    rows = [(i, i % 3, (i * 7) % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    got = {}
    for r in joins.siblings(df, "g", "id", [F.col("v").desc(), F.col("id")], 4).collect():
        got.setdefault(r.id, []).append((r.place, r.sibling))
    for i, g, _ in rows:
        want = sorted(((-v, j) for j, h, v in rows if h == g and j != i))[:4]
        assert [s for _, s in sorted(got[i])] == [j for _, j in want]


def test_child_needs_both_parents(spark):
    child = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 1)], "id int, a int, b int")
    one = spark.createDataFrame([(1,)], "k int")
    assert [r.id for r in joins.visible_children(child, [(one, "a", "k"), (one, "b", "k")]).collect()] == [1]


GAMES = "tournament string, ord long, winner string, loser string, label string"


def test_depth_and_stages(spark):
    rows = [("t", 1, "a", "b", None), ("t", 2, "c", "d", None), ("t", 3, "a", "c", "final"), ("u", 1, "a", "b", None), ("u", 2, "b", "c", None), ("v", 1, "x", "y", None), ("v", 2, "z", "w", None)]
    g = spark.createDataFrame(rows, GAMES)
    champs = {r.tournament: r.champion for r in tournament.champions(g).collect()}
    assert champs == {"t": "a", "u": "a", "v": None}  # v: two unbeaten teams, no final
    deep = tournament.depth_to_final(g, {"final": 0})
    k = {(r.tournament, r.ord): r.k for r in deep.collect()}
    assert k[("t", 1)] == 1 and k[("t", 3)] == 0 and k[("u", 1)] == 0 and k[("u", 2)] is None and k[("v", 1)] is None
    entries = spark.createDataFrame([("t", "a", False), ("t", "b", False), ("t", "c", True), ("t", "q", False), ("v", "x", False)], "tournament string, team string, withdrew boolean")
    got = {(r.tournament, r.team): r.result for r in tournament.stage_labels(entries, deep, tournament.champions(g), ["second", "semi"]).collect()}
    assert got == {("t", "a"): "優勝", ("t", "b"): "初戦敗退", ("t", "c"): "辞退", ("t", "q"): None, ("v", "x"): None}


def test_outcomes_prefer_the_flag_and_draws_win_for_none(spark):
    sides = spark.createDataFrame([(1, "a", None, 2), (1, "b", None, 2), (2, "a", True, 0), (2, "b", False, 5)], "g int, side string, flag boolean, score int")
    got = {(r.g, r.side): r.won for r in tournament.side_outcomes(sides, "g", "flag", "score", "side").collect()}
    assert got == {(1, "a"): False, (1, "b"): False, (2, "a"): True, (2, "b"): False}


def test_third_place(spark):
    g = spark.createDataFrame([("t", 1, "a", "b", "semi"), ("t", 2, "c", "d", "semi"), ("t", 3, "a", "c", "final"), ("t", 4, "b", "d", "final")], GAMES)
    assert {r.ord: r.label for r in tournament.split_third_place(g).collect()} == {1: "semi", 2: "semi", 3: "final", 4: "third place"}


def test_day_dates_gap_and_reach(spark):
    d = dt.date(2024, 8, 1)
    known = spark.createDataFrame([("a", 1, d), ("a", 2, d + dt.timedelta(1)), ("b", 1, d), ("b", 3, d + dt.timedelta(2))], "g string, day int, date date")
    want = spark.createDataFrame([("a", 5), ("a", 6), ("b", 4)], "g string, day int")
    got = {(r.g, r.day): r.date for r in tournament.day_dates(known, want, "g").collect()}
    assert got == {("a", 5): d + dt.timedelta(4), ("a", 6): None, ("b", 4): None}


def test_short_names_shared_by_two_teams_are_dropped(spark):
    e = spark.createDataFrame([("t", 1, "kita", ["east"]), ("t", 2, "kita", ["west"]), ("t", 3, "minami", None)], "tournament string, team int, short string, regions array<string>")
    got = {r.alias: r.team for r in tournament.short_name_aliases(e, "tournament", "team", "short", "regions").collect()}
    assert got["eastkita"] == 1 and got["minami"] == 3 and "kita" not in got


def test_walkovers(spark):
    rows = spark.createDataFrame([("t", "a", "b", "", " ", "不戦勝"), ("t", "c", "d", "1", "0", "不戦勝"), ("t", "e", "f", None, None, None)], "tournament string, a string, b string, x string, y string, note string")
    assert [r.team for r in tournament.walkover_losers(rows, "a", "b", "x", "y", "note").collect()] == ["b"]


def test_rate_limit_boundary(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 2, 3, 4, 59, 60, 61])] + [(99, 2, t)]
    e = spark.createDataFrame(rows, "id int, v int, ts timestamp")
    got = {r.id: r.accepted for r in community.rate_limit(e, "v", "ts", "id", 5, 3600).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 99: True}


def test_messages(spark):
    rows = spark.createDataFrame([(1, " " + "x" * 200 + " ", " "), (2, "x" * 201, "n"), (3, "   ", "n"), (4, None, "n" * 21), (5, "ok", "n" * 21)], "id int, body string, name string")
    got = {r.id: (r.rejected, r["name"]) for r in community.message_intake(rows, "body", "name").collect()}
    assert got == {1: (None, None), 2: ("too long", "n"), 3: ("blank", "n"), 4: ("blank", "n" * 21), 5: ("name too long", "n" * 21)}


def test_counter_saturates(spark):
    e = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("a", 3, 1), ("a", 4, -1), ("b", 1, -1)], "k string, o int, d int")
    assert {r.k: r.n for r in community.saturating_counter(e, "k", F.col("d"), ["o"]).collect()} == {"a": 1, "b": 0}


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, v string")
    assert dict(map(tuple, upsert.do_update(base, new, ["id"]).collect())) == {1: "x", 2: "y", 3: "z"}
    assert dict(map(tuple, upsert.do_nothing(base, new, ["id"]).collect())) == {1: "a", 2: None, 3: "z"}
    assert dict(map(tuple, upsert.fill_nulls(base, new, ["id"], ["v"]).collect())) == {1: "a", 2: "y"}


def test_decisive_games(spark):
    g = spark.createDataFrame([("a", "b", "2x", "1"), ("a", "b", "2", "1"), ("b", "a", "1", "2"), ("c", "d", "1", "1")], "a string, b string, x string, y string")
    assert [tuple(r) for r in audit.decisive_games(g, "a", "b", "x", "y", []).collect()] == [("a", "b")]


def test_score_cells(spark):
    df = spark.createDataFrame([("3 - 2",), ("5ｘ",), ("4x－3（延長10回）",), (None,), ("－",)], "t string").select(extract.score_cell(F.col("t")).alias("s"))
    got = [r.s and tuple(r.s) for r in df.collect()]
    assert got == [(3, 2, False, None), None, (4, 3, True, "延長10回"), None, None]


def test_tables_pairs_and_numbers(spark):
    html = "<table><tr><th>final</th></tr><tr><td>A</td><td>1</td><td>x</td><td>10</td></tr><tr><td>B</td><td></td><td>2</td></tr></table>"
    cells = extract.table_cells(spark.createDataFrame([(1, html)], "k int, h string"), "k", "h")
    rows = cells.groupBy("k", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]).alias("c"))
    rows = rows.select("k", "row", F.col("c")[0].alias("name"), extract.rightmost_number(F.col("c")).alias("total"), F.size("c").alias("n"))
    got = extract.pair_rows(rows, ["k"], ["row"], F.col("n") == 1, ["name", "total"]).collect()
    assert [(r.name, r.name_1, r.total_1, r.name_2, r.total_2) for r in got] == [("final", "A", 10, "B", 2)]


def test_blocks_and_wrapped_names(spark):
    df = spark.createDataFrame([(1, ["team", "1", "team", "1"], ["A", "2", "B", "x"])], "k int, h array<string>, c array<string>")
    assert [(r.block, r.cells, r.total) for r in extract.unpivot_blocks(df, ["k"], "h", "c", "^team$").collect()] == [(0, ["A", "2"], 2), (1, ["B", "x"], 0)]
    rows = spark.createDataFrame([(1, 1, "long ", None), (1, 2, "name", 3), (1, 3, "round:", None), (1, 4, "other", 1)], "k int, n int, name string, score int")
    got = extract.join_wrapped(rows, ["k"], ["n"], "name", "score", F.col("name").endswith(":")).orderBy("n").collect()
    assert [r.name for r in got] == ["long name", "other"]


def test_wikitext(spark):
    text = "= A =\nx\n== Teams ==\n* [[North High|North]]{{ref|{{in}}}}\n=== sub ===\n| [[South High]]\n== Next ==\ny"
    pages = spark.createDataFrame([(1, text)], "k int, t string")
    lines = extract.wiki_section(pages, "k", "t", "Teams")
    assert [r.line for r in lines.orderBy("n").collect()] == ["* [[North High|North]]{{ref|{{in}}}}", "=== sub ===", "| [[South High]]"]
    cut = pages.sparkSession.createDataFrame([(1, "a{{b|{{c}}}}<ref>x</ref>d"), (2, None), (3, ""), (4, "}}a}}{{b}}{{c"), (5, "{{efn|" * 40 + "x" + "}}" * 40 + "y{{z}}")], "k int, t string")
    assert {r.k: r.t for r in extract.strip_templates(cut, "k", "t").collect()} == {1: "ad", 2: None, 3: "", 4: "}}a}}", 5: "y"}
    assert {r.k: r.t for r in extract.strip_templates(cut, "k", "t", ("efn",)).collect()} == {1: "a{{b|{{c}}}}d", 2: None, 3: "", 4: "}}a}}{{b}}{{c", 5: "y{{z}}"}
    assert pages.select(extract.infobox_year(F.lit("| year = 1998 |"), "year").alias("y")).first().y == 1998


def test_placeholders(spark):
    rows = spark.createDataFrame([("A",), ("--",), (None,)], "t string")
    assert extract.reject_placeholders(rows, "t", ["^--$"]).count() == 2


def test_participants(spark):
    lines = ["* [[三重県]] [[海星中学校・高等学校 (三重県)|海星]] 2年ぶり3回目<ref>病気で棄権</ref>", "|-", "| [[和歌山県立海南高等学校|海南]]<ref>[[他校]]の出場辞退</ref> 初出場", "plain [[東高等学校]]", "* [[東高等学校]] [[西高等学校]]", "* [[和歌山県立海南高等学校|again]]", "* [[千葉大会]]", None]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, n int, line string")
    got = [(r.article, r.short, r.prefs, r.withdrew, r.appearance) for r in wikitext.participants(df, "k", "n", "line").orderBy("n").collect()]
    assert got == [("海星中学校・高等学校 (三重県)", "海星", ["三重"], True, "2年ぶり3回目"), ("和歌山県立海南高等学校", "海南", ["和歌山"], False, "初出場")]


SECTION = """=== 準決勝 ===
* 海星（長崎）2 - 0 海星（三重）
* 8月18日 A 1－1 B
|rowspan="3"|8月8日||第1試合||[[有田|有田工]]||5 – 4x||大垣||1時間
=== 他 ===
{{Round4
|RD1='''準々決勝'''
|8月1日|甲{{Efn|name="a|b"}}|3|'''乙'''|10x
||広島||'''大阪'''（不戦勝）|
}}
* C 3 - 1 D
{{Linescore
|Road=E |RR=0
|Home=F |HR=0
}}
{{Linescore
|Road=[[E]] |RR=2
|Home=F |HR=4
}}"""


def test_games_in_four_layouts(spark):
    df = spark.createDataFrame([(1, SECTION), (2, SECTION + "\n=== 決勝 ===\n* G 1 - 0 H"), (3, None), (4, "")], "k int, t string")
    found, walked = wikitext.games(df, "k", "t")
    got = {k: {(r.layout, r.winner, r.loser, r["round"]) for r in found.collect() if r.k == k} for k in (1, 2, 3, 4)}
    both = {("bullet", "海星（長崎）", "海星（三重）", "準決勝"), ("table", "有田工", "大垣", "準決勝"), ("bracket", "乙", "甲", "準々決勝"), ("bullet", "C", "D", None)}
    assert got[1] == both | {("linescore", "F", "E", "決勝")} and got[2] == both | {("bullet", "G", "H", "決勝")} and not got[3] and not got[4]
    assert sorted((r.k, r.loser) for r in walked.collect()) == [(1, "広島"), (2, "広島")]


def test_berths(spark):
    page = "{|\n!年!!地区\n|-\n|関東||[[早い高等学校]]||x\n|-\n| rowspan=2|2001年<br>第73回\n|東北<br />南||[[安積高等学校|'''安積''']]<br>（福島）||備考\n|-\n|九州||[[宜野座高等学校]] (沖縄)||{{x|y}}z\n|-\n|四国||なし||z"
    df = spark.createDataFrame([(1, page), (2, None)], "k int, t string")
    got = [(r.year, r.region, r.article, r.display, r.prefecture, r.problem) for r in wikitext.berths(df, "k", "t").orderBy("n").collect()]
    assert got == [(None, None, None, None, None, "no year"), (2001, "東北南", "安積高等学校", "安積", "福島", None), (2001, "九州", "宜野座高等学校", "宜野座高等学校", "沖縄", None), (2001, None, None, None, None, "no link")]


def test_rounds_of_links(spark):
    pages = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    links = spark.createDataFrame([("a", "c", 0), ("a", "b", 1), ("a", "d", 2), ("c", "a", 0), ("c", "gone", 1), ("b", "e", 0), ("e", "d", 0)], "source string, href string, place int")
    got = {r.url: r["round"] for r in extract.follow_rounds(pages.filter("url = 'a'"), links, pages, "url", "source", "href", "place", [2, 5, 5]).collect()}
    assert got == {"a": 0, "c": 1, "b": 1, "e": 2, "d": 3}


def test_links_of_a_page(spark):
    html = "<a href=' sub.html '>One</a><a class=x HREF=\"/r?q\">Two</a><a href='../up'>Up</a><a href='http://other.org/'>no</a><a href='//h.org/p'>P</a><a href='#f'>F</a><a href='sub.html'>again</a>"
    df = spark.createDataFrame([(1, "http://h.org/d/page?x=1#y", html), (2, "http://h.org", "<a href='a'>A</a>"), (3, None, html), (4, "http://h.org", None)], "k int, u string, h string")
    got = {(r.k, r.href): (r.label, r.place) for r in extract.links(df, "k", "u", "h").collect()}
    assert got == {(1, "http://h.org/d/sub.html"): ("One", 0), (1, "http://h.org/r?q"): ("Two", 1), (1, "http://h.org/up"): ("Up", 2), (1, "http://h.org/p"): ("P", 4), (1, "http://h.org/d/page?x=1#f"): ("F", 5), (2, "http://h.org/a"): ("A", 0)}


def test_key_rounds_write_only_what_moves(spark, tmp_path):
    """Against the greedy order in plain Python, with chains of displacements; rows written stay few."""
    import glob
    import random

    from tallywick.operators import keys
    from tallywick.session import shared_dir

    rng = random.Random(3)
    rows = [(i, p, [rng.choice("abcdefghij") + str(rng.randrange(12)) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 5))] if i else None) for i, p in enumerate(rng.sample(range(1000), 300))]
    taken, want = set(), {}
    for i, _, c in sorted(rows, key=lambda r: r[1]):
        want[i] = next((x for x in c or [] if x is not None and x not in taken), None)
        taken.add(want[i])
    df = spark.createDataFrame(rows, "id int, prio int, c array<string>")
    before = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/keys-*"))
    got = {r.id: r.key for r in keys.allocate_keys(df, "id", "prio", F.col("c")).collect()}
    assert got == want and None in want.values()
    root = (set(glob.glob(shared_dir(spark).removeprefix("file://") + "/keys-*")) - before).pop()
    sizes = [spark.read.parquet(p).count() for p in sorted(glob.glob(f"{root}/0*"))]
    assert len(sizes) > 3 and sizes[-1] < sizes[0] / 4 and sum(sizes) < 3 * len(rows)
    empty = keys.allocate_keys(df.limit(0), "id", "prio", F.col("c"))
    assert empty.collect() == [] and empty.columns == ["id", "prio", "c", "key"]
