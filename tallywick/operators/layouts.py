"""Games from pages of many layouts in one job (the extraction job over layout specifications).

A layout is data: patterns of rows and cells, where a page states date, round and venue, and how its
rows make games. `extract_games` turns a dict of layouts into one plan: every page's layout chooses the
patterns, so all pages are scanned once; tokens in document order, context carried forward, rows paired
with those after them, and each game checked. A new layout is a new entry, not a new job.

Defined results: a page whose layout is not in the dict, or that is null or empty, gives no rows; games
that fail a check are returned with the reason in `problem`; pages of one key would mix their context,
so keys must be unique.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.functions import names
from tallywick.operators.extract import block_total, carry_forward, rightmost_number, strip_markup

#: A game in running text: name, score, dash, score, name.
INLINE = r"(\S+)\s+(\d+)\s*[xX]?\s*-\s*(\d+)\s*[xX]?\s+(\S+)"


@dataclass(frozen=True)
class Layout:
    """How pages of one source are read. Patterns are regular expressions.

    rows, cells: what parts a page into rows and a row into cells, group 1 being the content.
    context: what a row's text must match to be read for date, round and venue; the first cell of such
        a row where `in_cell` is set, else the whole row.
    games: `inline` (games in the text of a row's other cells), `pair` (a header row, then two rows
        that each begin with a name), or `blocks` (a header row whose cells that match `header` begin
        blocks, then two rows of the same columns).
    header: what tells the header row (pair) or the header cells of a block (blocks).
    placeholder: what a name must not match.
    """

    rows: str
    cells: str
    games: str
    context: str = "."
    in_cell: bool = False
    header: str = "^$"
    placeholder: str = "^[-―ー]*$"


def any_date(text: Column, year: Column) -> Column:
    """A date with a year, of an era, or with the page's year (S-18, S-19)."""
    full = [F.regexp_extract(text, r"(\d{4})[年/.-](\d{1,2})[月/.-](\d{1,2})", i) for i in (1, 2, 3)]
    era = [F.regexp_extract(text, r"令和(\d+|元)年(\d{1,2})月(\d{1,2})日", i) for i in (1, 2, 3)]
    own = F.when(full[0] != "", F.try_to_date(F.concat_ws("-", full[0], F.lpad(full[1], 2, "0"), F.lpad(full[2], 2, "0")), "yyyy-MM-dd"))
    eras = F.when(text.contains("令和") & (era[0] != ""), names.yearless_date(F.concat(era[1], F.lit("月"), era[2], F.lit("日")), names.era_year(text)))
    return F.coalesce(own, eras, names.yearless_date(text, year))


def _by_layout(layouts: dict[str, Layout], layout: str, value: Callable[[Layout], Column]) -> Column:
    """The value of a row's own layout; layouts of one value share a branch."""
    out = None
    for name, spec in layouts.items():
        here = F.col(layout) == name
        out = F.when(here, value(spec)) if out is None else out.when(here, value(spec))
    return out


def tokens(pages: DataFrame, layouts: dict[str, Layout], key: str, layout: str, html: str, year: str) -> DataFrame:
    """Rows of all pages in document order: key, layout, year, n, text, cells."""
    known = pages.filter(F.col(layout).isin(list(layouts)))
    bodies = _by_layout(layouts, layout, lambda s: F.regexp_extract_all(html, F.lit(s.rows), 1))
    rows = known.select(key, layout, year, F.posexplode(bodies).alias("n", "__body"))
    cells = _by_layout(layouts, layout, lambda s: F.regexp_extract_all("__body", F.lit(s.cells), 1))
    read = F.transform(cells, lambda c: names.fold_width(strip_markup(c)))
    return rows.select(key, layout, year, "n", names.fold_width(strip_markup(F.col("__body"))).alias("text"), read.alias("cells"))


def _inline(cells: Column) -> Column:
    found = F.flatten(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.regexp_extract_all(c, F.lit(INLINE), 0)))
    return F.transform(found, lambda m: _game(*(F.regexp_extract(m, INLINE, i) for i in (1, 2, 4, 3))))


def _game(a: Column, x: Column, b: Column, y: Column) -> Column:
    return F.struct(a.alias("a"), x.try_cast("int").alias("x"), b.alias("b"), y.try_cast("int").alias("y"))


def _pair(spec: Layout, text: Column, first: Column, second: Column) -> Column:
    two = first.isNotNull() & second.isNotNull()
    game = _game(F.get(first, F.lit(0)), rightmost_number(first), F.get(second, F.lit(0)), rightmost_number(second))
    return F.when(text.rlike(spec.header) & two, F.array(game))


def _blocks(spec: Layout, header: Column, first: Column, second: Column) -> Column:
    at = F.filter(F.transform(header, lambda h, i: F.when(h.rlike(spec.header), i)), lambda i: i.isNotNull())
    end = F.greatest(F.size(header), F.size(first), F.size(second))

    def game(begin: Column, k: Column) -> Column:
        size = F.coalesce(F.try_element_at(at, k + 2), end) - begin
        heads, one, two = (F.slice(c, begin + 1, size) for c in (header, first, second))
        return _game(F.get(one, F.lit(0)), block_total(heads, one), F.get(two, F.lit(0)), block_total(heads, two))

    return F.when(first.isNotNull() & second.isNotNull(), F.transform(at, game))


def extract_games(pages: DataFrame, layouts: dict[str, Layout], key: str, layout: str, html: str, year: str) -> DataFrame:
    """Checked games of all pages: key, layout, n, block, date, round, venue, a, x, b, y, winner, problem.

    n is the game's row on its page and block its place in the row. A date begins a segment in which
    round and venue start anew. Problems: no team, placeholder, one team, no score, no date, in this
    order; equal scores have no winner.
    """
    rows = tokens(pages, layouts, key, layout, html, year)
    context = _by_layout(layouts, layout, lambda s: F.when(F.col("text").rlike(s.context), F.get("cells", F.lit(0)) if s.in_cell else F.col("text")))
    rows = rows.withColumn("__c", context)
    rows = rows.withColumns({"date": any_date(F.col("__c"), F.col(year)), "round": names.pick_round(F.col("__c")), "venue": names.pick_venue(F.col("__c"))})
    rows = carry_forward(rows, [key], ["n"], ["round", "venue"], reset="date")
    w = Window.partitionBy(key).orderBy("n")
    rows = rows.withColumns({"__1": F.lead("cells", 1).over(w), "__2": F.lead("cells", 2).over(w)})
    first, second = F.col("__1"), F.col("__2")
    makers = {
        "inline": lambda s: _inline(F.col("cells")),
        "pair": lambda s: _pair(s, F.col("text"), first, second),
        "blocks": lambda s: _blocks(s, F.col("cells"), first, second),
    }
    games = rows.withColumn("__g", _by_layout(layouts, layout, lambda s: makers[s.games](s)))
    # outer, as Spark would move the filter that the other form implies to the cells and read them anew
    games = games.select(key, layout, "n", "date", "round", "venue", F.posexplode_outer("__g").alias("block", "__g")).filter("block is not null").select("*", "__g.*").drop("__g")
    blank = (F.coalesce("a", F.lit("")) == "") | (F.coalesce("b", F.lit("")) == "")
    held = _by_layout(layouts, layout, lambda s: F.col("a").rlike(s.placeholder) | F.col("b").rlike(s.placeholder))
    problem = F.when(blank, "no team").when(held, "placeholder").when(F.col("a") == F.col("b"), "one team")
    problem = problem.when(F.col("x").isNull() | F.col("y").isNull(), "no score").when(F.col("date").isNull(), "no date")
    winner = F.when(problem.isNull(), F.when(F.col("x") > F.col("y"), F.col("a")).when(F.col("x") < F.col("y"), F.col("b")))
    return games.select(key, layout, "n", "block", "date", "round", "venue", "a", "x", "b", "y", winner.alias("winner"), problem.alias("problem"))
