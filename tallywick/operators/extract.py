"""Rows from pages, wikitext and positioned fragments.

One job: text to ordered tokens by expressions, context carried forward by windows in document order,
rows paired by lead and checked by pattern.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.functions.uris import resolve, uri_parts
from tallywick.operators.ranking import first_per_group
from tallywick.session import Scratch

# Entities that plain text resolves, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def first_landed(plan: DataFrame, landed: DataFrame, key: str, place: str, title: str, size: str, least: int) -> DataFrame:
    """Per key the first candidate title that landed with more than `least` characters, else null (O-07a)."""
    found = plan.join(landed.filter(F.col(size) > least).select(title), title, "left_semi")
    return plan.select(key).distinct().join(found.groupBy(key).agg(F.min_by(title, place).alias(title)), key, "left")


def pick_version(df: DataFrame, title: str, own: Column, order: str) -> DataFrame:
    """Of several records of a title the one that bears its own number, else the first (O-07)."""
    return first_per_group(df, [title], [own.desc(), F.col(order)])


def strip_markup(html: Column, scripts: bool = True, comments: bool = True) -> Column:
    """Text without tags, entities resolved, white space single (O-110)."""
    text = F.coalesce(html, F.lit(""))
    if comments:
        text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    if scripts:
        text = F.regexp_replace(text, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rows and cells of all tables in document order (O-111): key, row, cell, text."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("row", "__r"))
    cells = rows.select(key, "row", F.posexplode(F.regexp_extract_all("__r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)).alias("cell", "__c"))
    return cells.select(key, "row", "cell", strip_markup(F.col("__c")).alias("text"))


ANCHOR = r"(?is)(<a\s[^>]*href\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a>)"


def links(pages: DataFrame, key: str, url: str, html: str, href: str = ".*", label: str = ".*") -> DataFrame:
    """Same-origin links resolved against the page, the first label of each (O-112): key, href, label
    and place, the link's first position on its page."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), 1)
    rows = pages.select(key, uri_parts(F.col(url)).alias("__b"), F.posexplode(found).alias("__p", "__a"))
    raw = F.regexp_extract("__a", r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    raw = F.concat(raw, F.regexp_extract("__a", r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 2))
    origin = F.concat(F.col("__b.scheme"), F.col("__b.host"))
    rows = rows.select(key, origin.alias("__o"), "__p", resolve(F.trim(raw), F.col("__b")).alias("href"), strip_markup(F.col("__a")).alias("label"))
    same = (F.col("href") == F.col("__o")) | F.col("href").rlike("^[^/]*//[^/?#]*[/?#]") & (F.regexp_extract("href", "^([^/]*//[^/?#]*)", 1) == F.col("__o"))
    kept = rows.filter(same & F.col("href").rlike(href) & F.col("label").rlike(label))
    return kept.groupBy(key, "href").agg(F.min_by("label", "__p").alias("label"), F.min("__p").alias("place"))


def follow(index: DataFrame, pages: DataFrame, key: str, href: str, url: str, cap: int, order: str) -> DataFrame:
    """The landed pages that an index links to, at most `cap` per index page in link order (O-121)."""
    first = index.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order, href))).filter(F.col("__rn") <= cap)
    return first.select(key, F.col(href).alias(url)).join(pages, url)


def follow_rounds(start: DataFrame, links: DataFrame, pages: DataFrame, url: str, source: str, href: str, order: str, caps: list[int]) -> DataFrame:
    """Rounds of links from start pages: index, archive, page (O-121): url and round, the first in which
    it was reached. links: source, href, order; each round takes at most its cap of a page's links."""
    reached = start.select(url, F.lit(0).alias("round"))
    frontier = reached.select(url)
    for i, cap in enumerate(caps, 1):
        index = links.join(frontier.select(F.col(url).alias(source)), source, "left_semi")
        found = follow(index, pages.select(url), source, href, url, cap, order).select(url).distinct()
        frontier = found.join(reached.select(url), url, "left_anti")
        reached = reached.unionByName(frontier.select(url, F.lit(i).alias("round")))
    return reached


def carry_forward(df: DataFrame, partition: list[str], order: list[str], values: list[str], reset: str | None = None) -> DataFrame:
    """The last value that is not null applies on; with `reset`, a new value of that column starts a
    segment in which the others begin anew (O-113)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if reset:
        df = df.withColumn("__seg", F.count(reset).over(w))
        w = Window.partitionBy(*partition, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in [*([reset] if reset else []), *values]})
    return out.drop("__seg") if reset else out


def pair_rows(df: DataFrame, partition: list[str], order: list[str], is_header: Column, columns: list[str]) -> DataFrame:
    """A header row with the two team rows after it (O-114); a header that meets another first drops."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = df.withColumn("__h", F.coalesce(is_header, F.lit(False)))
    for i in (1, 2):
        rows = rows.withColumns({f"{c}_{i}": F.lead(c, i).over(w) for c in columns} | {f"__h{i}": F.lead("__h", i).over(w)})
    return rows.filter("__h and not __h1 and not __h2").drop("__h", "__h1", "__h2")


def rightmost_number(cells: Column) -> Column:
    """Right-most numeric cell after the first (O-115); blanks and x are skipped."""
    numbers = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: c.rlike(r"^\d+$"))
    return F.try_element_at(numbers, F.lit(-1)).cast("int")


def score_cell(text: Column) -> Column:
    """Struct of both scores, walk-off and the extra-inning note of a score cell (O-116)."""
    pattern = r"^\s*(\d+)\s*([xX])?\s*[-−－–—ー‐]\s*(\d+)\s*([xX])?\s*(?:[（(]([^）)]*)[）)])?\s*$"
    part = [F.regexp_extract(text, pattern, i) for i in range(6)]
    return F.when(part[0] != "", F.struct(part[1].cast("int").alias("a"), part[3].cast("int").alias("b"), ((part[2] != "") | (part[4] != "")).alias("walk_off"), F.when(part[5] != "", part[5]).alias("note")))


def unpivot_blocks(df: DataFrame, key: list[str], header: str, cells: str, starts: str, total: str = "^計$") -> DataFrame:
    """Side-by-side blocks of a row (O-117): cells from a header cell that matches `starts` to the next.

    A block's total is its cell under the header that matches `total` where that holds a number, else
    the sum of the numeric cells after its first. header and cells are arrays.
    """
    at = F.filter(F.transform(F.col(header), lambda h, i: F.when(h.rlike(starts), i)), lambda i: i.isNotNull())
    rows = df.withColumn("__at", at)
    begin = rows.select("*", F.posexplode("__at").alias("block", "__b"))
    stop = F.coalesce(F.try_element_at("__at", F.col("block") + 2), F.greatest(F.size(header), F.size(cells)))
    heads, part = (F.slice(c, F.col("__b") + 1, stop - F.col("__b")) for c in (header, cells))
    return begin.select(*key, "block", part.alias("cells"), block_total(heads, part, total).alias("total"))


def block_total(heads: Column, cells: Column, total: str = "^計$") -> Column:
    """The number under the header that matches `total`, else the sum of the numeric cells after the first."""
    place = F.array_position(F.transform(heads, lambda h: F.coalesce(h.rlike(total), F.lit(False))), True).cast("int")
    stated = F.when(place > 0, F.get(cells, place - 1))
    runs = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    summed = F.aggregate(runs, F.lit(0), lambda s, c: s + F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("int")), F.lit(0)))
    return F.when(stated.rlike(r"^\d+$"), stated.try_cast("int")).otherwise(summed)


def join_wrapped(df: DataFrame, partition: list[str], order: list[str], name: str, score: str, stop: Column) -> DataFrame:
    """The last name without a score prefixes the next scored row, over empty rows too, unless a stop row
    lies between (O-118)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__stop", F.coalesce(stop, F.lit(False)))
    ends = (F.col("__stop") | F.col(score).isNotNull()).cast("int")
    rows = rows.withColumn("__seg", F.coalesce(F.sum(ends).over(w), F.lit(0)))
    before = Window.partitionBy(*partition, "__seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    half = F.last(F.when(~F.col("__stop") & F.col(score).isNull(), F.nullif(F.col(name), F.lit(""))), True).over(before)
    joined = rows.withColumn(name, F.concat(F.coalesce(half, F.lit("")), F.col(name)))
    return joined.filter(F.col(score).isNotNull() & ~F.col("__stop")).drop("__stop", "__seg")


@F.pandas_udf(T.DoubleType())
def lowest_within(y: pd.Series, tolerance: pd.Series) -> pd.Series:
    """The lowest number z for which y - z, as doubles subtract, is at most the tolerance; y - tolerance
    may be rounded past it. Found by halving the doubles between, as whole numbers in their order."""
    top = y.to_numpy("float64")

    def ordered(bits: np.ndarray) -> np.ndarray:
        return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)

    low, high = ordered(np.full_like(top, -np.inf).view("int64")), ordered(top.view("int64"))
    with np.errstate(invalid="ignore", over="ignore"):
        for _ in range(64):
            middle = (low >> 1) + (high >> 1) + (low & high & 1)
            near = top - ordered(middle).view("float64") <= tolerance.to_numpy()
            low, high = np.where(near, low, middle), np.where(near, middle, high)
    return pd.Series(ordered(high).view("float64") + 0.0)


def anchored_rows(fragments: DataFrame, group: list[str], y: str, tolerance: float) -> DataFrame:
    """Rows of fragments (O-119): in descending y, a fragment joins the row while it lies within the
    tolerance of the row's first fragment. Adds `line`, from 0 in each group; null where y is null.

    Where more than the tolerance lies between two heights a new row begins, whatever came before. Those
    gaps cut a group into segments that are on their own, and most segments are one row. Inside the
    others each height points to the first one below its tolerance; the rows begin at what the pointers
    reach from the top, found by doubling them.
    """
    scratch = Scratch(fragments.sparkSession, "anchors")
    keyed = fragments.withColumn("__g", F.to_json(F.struct(*group)))  # never null
    heights = keyed.filter(F.col(y).isNotNull()).select("__g", F.col(y).cast("double").alias("__y")).distinct()
    heights = heights.withColumn("__bucket", F.floor(-F.col("__y") / F.lit(tolerance)))
    # heights of one bucket are never cut, so only the buckets' edges meet in a window
    edges = heights.groupBy("__g", "__bucket").agg(F.max("__y").alias("__top"), F.min("__y").alias("__low"))
    down = Window.partitionBy("__g").orderBy("__bucket")
    edges = edges.withColumn("__cut", F.coalesce(F.lag("__low").over(down) - F.col("__top") > tolerance, F.lit(True)).cast("int"))
    edges = edges.withColumn("__seg", F.sum("__cut").over(down))
    heights = scratch.save(heights.join(edges.select("__g", "__bucket", "__seg"), ["__g", "__bucket"]).select("__g", "__seg", "__y"), "heights")
    segment = ["__g", "__seg"]
    # each height and the place where its tolerance ends, in one order: the next height after that place
    ends = heights.withColumn("__at", F.col("__y")).withColumn("__end", F.lit(0)).unionByName(heights.withColumns({"__at": lowest_within("__y", F.lit(float(tolerance))), "__end": F.lit(1)}))
    below = Window.partitionBy(*segment).orderBy(F.col("__at").desc(), "__end").rowsBetween(1, Window.unboundedFollowing)
    to = F.first(F.when(F.col("__end") == 0, F.col("__y")), True).over(below)
    points = ends.withColumn("to", to).filter("__end = 1").select(*segment, F.col("__y").alias("from"), "to").filter("to is not null")
    points = scratch.save(points, "points")
    tops = heights.groupBy(*segment).agg(F.max("__y").alias("from"))
    reached = scratch.save(tops, "reached")
    while not points.isEmpty():
        step = reached.join(points, [*segment, "from"]).select(*segment, F.col("to").alias("from"))
        reached = scratch.save(reached.unionByName(step).distinct(), "reached")
        further = points.select(*segment, F.col("from").alias("to"), F.col("to").alias("more"))
        points = scratch.save(points.join(further, [*segment, "to"]).select(*segment, "from", F.col("more").alias("to")), "points")
    # lines count within a segment and go on from those of the segments above
    counted = reached.groupBy(*segment).agg(F.count("*").alias("n"))
    above = counted.withColumn("__before", F.sum("n").over(Window.partitionBy("__g").orderBy("__seg")) - F.col("n"))
    marked = heights.join(reached.select(*segment, F.col("from").alias("__y"), F.lit(1).alias("__first")), [*segment, "__y"], "left")
    inside = F.count("__first").over(Window.partitionBy(*segment).orderBy(F.col("__y").desc()))
    lines = marked.withColumn("__in", inside).join(above, segment)
    lines = lines.select("__g", "__y", (F.col("__before") + F.col("__in") - 1).cast("int").alias("line"))
    return keyed.withColumn("__y", F.col(y).cast("double")).join(lines, ["__g", "__y"], "left").select(*fragments.columns, "line")


def reject_placeholders(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows that no placeholder pattern matches (O-120)."""
    return df.filter(~F.coalesce(F.col(column), F.lit("")).rlike("|".join(f"(?:{p})" for p in patterns)))


def wiki_section(pages: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """Lines of a wikitext section up to the next heading of its level or higher (O-122)."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    marks = F.regexp_extract("line", r"^(=+)[^=].*?=+\s*$", 1)
    named = F.trim(F.regexp_extract("line", r"^=+\s*([^=].*?)\s*=+\s*$", 1))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("__l", F.when(marks != "", F.length(marks))).withColumn("__hit", F.when((marks != "") & (named == heading), F.length(marks)))
    # a section ends where a heading of its level or higher follows its start
    rows = rows.withColumn("__start", F.last(F.when(F.col("__hit").isNotNull(), F.col("n")), True).over(w)).withColumn("__level", F.last("__hit", True).over(w))
    ended = F.max(F.when((F.col("n") > F.col("__start")) & (F.col("__l") <= F.col("__level")), 1)).over(Window.partitionBy(key, "__start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__end", ended)
    return rows.filter("__start is not null and __end is null and n > __start").select(key, "n", "line")


def strip_references(text: Column) -> Column:
    """Wikitext without its reference tags and what they hold."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<ref\b[^>]*/>", ""), r"(?is)<ref\b[^>]*>.*?</ref>", "")


# Beginnings of templates with their names, and ends.
_BRACES = re.compile(r"\{\{\s*([^|{}\s]*)|\}\}", re.ASCII)


def without_templates(text: str, names: tuple[str, ...]) -> str:
    """A text without all templates, or without those of these names. Inside a removed template only the
    depth counts; outside, every brace that begins none is text."""
    kept, begin, depth = [], 0, 0
    for mark in _BRACES.finditer(text):
        name = mark.group(1)
        if depth:
            depth += -1 if name is None else 1
            begin = mark.end()
        elif name is not None and (not names or name.lower() in names):
            kept.append(text[begin : mark.start()])
            depth = 1
    return "".join(kept) if depth else "".join([*kept, text[begin:]])


def strip_templates(pages: DataFrame, key: str, text: str, names: tuple[str, ...] = ()) -> DataFrame:
    """pages with references and templates removed from a text (O-123): all templates, or those of these
    names, each with what it nests at any depth. An end without a beginning is text; a beginning without
    an end removes the rest.

    Regular expressions do not count depth, so each text is read once from brace to brace where it lies;
    no row moves.
    """

    @F.pandas_udf(T.StringType())
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else without_templates(t, names))

    return pages.withColumn(text, stripped(strip_references(F.col(text))))


def wiki_links(text: Column) -> Column:
    """Array of (target, label) of link markup (O-124)."""
    found = F.regexp_extract_all(text, F.lit(r"(\[\[[^\[\]]+\]\])"), 1)
    return F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\[\[([^|\]]+)", 1)).alias("target"), F.trim(F.regexp_extract(x, r"([^|\[]+)\]\]$", 1)).alias("label")))


def infobox_year(text: Column, field: str) -> Column:
    """The year of an infobox field (O-128)."""
    return F.regexp_extract(text, rf"\|\s*{field}\s*=\s*(\d{{4}})", 1).try_cast("int")


def rule_scan(df: DataFrame, key: str, text: str, rules: dict[str, str], before: int = 30, after: int = 40) -> DataFrame:
    """Hits of named patterns with a snippet from `before` characters ahead of the first match to `after`
    behind its end, each snippet once (O-129)."""
    hits = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_instr(text, F.lit(p)).alias("at"), F.regexp_extract(text, p, 0).alias("hit")) for name, p in rules.items()))
    rows = df.select(key, text, F.explode(hits).alias("h")).filter("h.at > 0")
    start = F.greatest(F.col("h.at") - before, F.lit(1))
    length = F.col("h.at") + F.length("h.hit") + after - start
    return rows.select(key, "h.rule", F.substring(text, start, length).alias("snippet")).dropDuplicates([key, "rule", "snippet"])


def rule_report(hits: DataFrame, group: str, rules: list[str]) -> DataFrame:
    """Hits per group and rule, one column per rule."""
    return hits.groupBy(group).pivot("rule", rules).agg(F.count("snippet")).na.fill(0)


def unsafe_markup(html: Column) -> Column:
    """Script or frame tags, event attributes or script URLs (O-130)."""
    return F.coalesce(html, F.lit("")).rlike(r"(?i)<\s*(?:script|iframe)\b|\son[a-z]+\s*=|(?:href|src)\s*=\s*[\"']?\s*javascript:")
