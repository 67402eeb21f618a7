"""Queries over community events, messages and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import community as C
from tallywick.operators import extract as X
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.plans.search_queries import _POLLS, polls
from tallywick.session import table

_EVT = B.cte("evt")


@query(_EVT + "SELECT target, visitor, event_id FROM evt WHERE action = 'click' QUALIFY row_number() OVER (PARTITION BY target, visitor ORDER BY ts, event_id) = 1")
def unique_cheers(spark: SparkSession, d: str) -> DataFrame:
    return C.unique_presses(B.events(spark, d).filter("action = 'click'"), "target", "visitor", ["ts", "event_id"]).select("target", "visitor", "event_id")


@query(_EVT + ", s AS (SELECT target, ts, event_id, sum(CASE action WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY target ORDER BY ts, event_id) AS s FROM evt) SELECT target, (arg_max(s, (ts, event_id)) - least(0, min(s)))::BIGINT AS n FROM s GROUP BY 1")
def saturating_counter(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("action") == "signup", 1).when(F.col("action") == "error", -1).otherwise(0)
    return C.saturating_counter(B.events(spark, d), "target", delta, ["ts", "event_id"])


@query(_EVT + "SELECT event_id, target FROM evt WHERE target IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)")
def guarded_targets(spark: SparkSession, d: str) -> DataFrame:
    ok = B.entities(spark, d).filter("balance > 2000").select(F.col("entity").alias("target"))
    return C.guard_target(B.events(spark, d), ok, "target").select("event_id", "target")


_GUARD = _POLLS + """, g AS (SELECT e.event_id, e.target, e.visitor, e.ts, CASE WHEN p.target IS NULL THEN 'no poll' WHEN e.target % 6 = 0 THEN 'not published' WHEN e.ts < starts THEN 'not started' WHEN e.ts > ends THEN 'ended' WHEN e.action = 'error' THEN 'foreign option' END AS rejected
 FROM evt e LEFT JOIN (SELECT * FROM polls WHERE target % 11 <> 0) p USING (target))"""


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d)
    p = polls(spark, d).filter("target % 11 <> 0").withColumn("published", F.col("target") % 6 != 0)
    options = e.filter("action <> 'error'").select("target", "action").distinct()
    return C.guard_votes(e, p, options, "target", "action", "ts")


@query(_EVT + "," + _GUARD + "SELECT event_id, rejected FROM g")
def vote_guard(spark: SparkSession, d: str) -> DataFrame:
    return _guarded(spark, d).select("event_id", "rejected")


@query(_EVT + "," + _GUARD + "SELECT target, visitor, event_id FROM g WHERE rejected IS NULL QUALIFY row_number() OVER (PARTITION BY target, visitor ORDER BY ts, event_id) = 1")
def accepted_votes(spark: SparkSession, d: str) -> DataFrame:
    return C.accepted_votes(_guarded(spark, d), "target", "visitor", ["ts", "event_id"]).select("target", "visitor", "event_id")


@query("""WITH m AS (SELECT conv_id, turn, trim(text, ' ') AS body, trim(role, ' ') AS who FROM (SELECT conv_id, turn, text, role FROM conversations UNION ALL SELECT conv_id, turn + 100, '  ' || role || ' ', ' ' FROM conversations UNION ALL SELECT conv_id, turn + 200, '   ', role FROM conversations))
 SELECT conv_id, turn, length(body)::BIGINT AS chars, nullif(who, '') AS name, 'draft' AS status, CASE WHEN body = '' THEN 'blank' WHEN length(body) > 200 THEN 'too long' WHEN length(who) > 20 THEN 'name too long' END AS rejected FROM m""")
def message_intake(spark: SparkSession, d: str) -> DataFrame:
    """T-05 over the whole texts, over short messages in blanks without a name, and over blank ones."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("body"), F.col("role").alias("name"))
    short = c.select("conv_id", (F.col("turn") + 100).alias("turn"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("body"), F.lit(" ").alias("name"))
    blank = c.select("conv_id", (F.col("turn") + 200).alias("turn"), F.lit("   ").alias("body"), "name")
    rows = C.message_intake(c.unionByName(short).unionByName(blank), "body", "name")
    return rows.select("conv_id", "turn", F.length("body").cast("long").alias("chars"), "name", "status", "rejected")


@query(_EVT.replace("WITH ", "WITH RECURSIVE ") + """, o AS (SELECT event_id, visitor, ts, row_number() OVER (PARTITION BY visitor ORDER BY ts, event_id) AS rn FROM evt WHERE visitor IS NOT NULL),
 r AS (SELECT event_id, visitor, rn, [ts] AS acc, true AS accepted FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.visitor, o.rn, CASE WHEN len(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2 THEN list_append(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR), o.ts) ELSE list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR) END,
   len(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2 FROM r JOIN o ON o.visitor = r.visitor AND o.rn = r.rn + 1)
 SELECT event_id, accepted FROM r""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).select("event_id", "visitor", "ts")
    return C.rate_limit(e, "visitor", "ts", "event_id", 2, 24 * 3600).select("event_id", "accepted")


@query(_EVT + ", c AS (SELECT *, CASE WHEN action = 'purchase' THEN 'published' ELSE 'draft' END AS status FROM evt), w AS (SELECT *, lag(status) OVER (PARTITION BY target ORDER BY ts, event_id) AS was FROM c) SELECT target, min(ts)::VARCHAR AS published_at FROM w WHERE status = 'published' AND was = 'draft' GROUP BY 1")
def moderation_publish(spark: SparkSession, d: str) -> DataFrame:
    c = B.events(spark, d).withColumn("status", F.when(F.col("action") == "purchase", "published").otherwise("draft"))
    return C.first_published(c, "target", "status", "ts", ["ts", "event_id"]).withColumn("published_at", F.col("published_at").cast("string"))


@query(_EVT + "SELECT action, max(ts)::DATE::VARCHAR AS newest, datediff('day', max(ts)::DATE, (SELECT max(ts)::DATE FROM evt))::INT AS days_behind FROM evt GROUP BY 1")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return C.freshness(B.events(spark, d), "action", "ts").select("action", F.to_date("newest").cast("string").alias("newest"), "days_behind")


_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query("SELECT page_id, md5(" + _PLAIN.format("html") + ") AS text_md5, length(" + _PLAIN.format("html") + ")::BIGINT AS chars FROM pages")
def strip_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.strip_markup(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars"))


_LINKED = """WITH p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000, url, '<a class=k href=''sub.html''>S</a><A HREF="../up?q=1#f">U &amp; V</A><a href="//cdn.example/x">C</a><a href="?only">Q</a><a href="sub.html">again</a>' FROM pages),
 a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o, split_part(split_part(url, '#', 1), '?', 1) AS bare, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*href=(?:"[^"]*"|''[^'']*'')[^>]*>.*?</a>)', 1)) AS a, unnest(range(len(regexp_extract_all(html, '(?is)(<a\\s[^>]*href=(?:"[^"]*"|''[^'']*'')[^>]*>.*?</a>)', 1)))) AS p FROM p),
 h AS (SELECT *, trim(regexp_extract(a, '(?i)href=["'']([^"'']*)', 1)) AS h, """.replace("\\\\", "\\") + _PLAIN.format("a") + """ AS label FROM a),
 b AS (SELECT *, CASE WHEN bare = o THEN o || '/' ELSE regexp_extract(bare, '^(.*/)', 1) END AS folder FROM h),
 l AS (SELECT page_id, o, p, label, CASE WHEN starts_with(h, '//') THEN split_part(o, '//', 1) || h WHEN starts_with(h, '/') THEN o || h WHEN starts_with(h, '?') THEN bare || h WHEN starts_with(h, '../') THEN CASE WHEN folder = o || '/' THEN folder ELSE regexp_replace(folder, '[^/]*/$', '') END || substr(h, 4) ELSE folder || h END AS href FROM b)
 """


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """The pages, and each again with links relative to it in other quotes."""
    p = table(spark, d, "pages").select("page_id", "url", "html")
    more = """<a class=k href='sub.html'>S</a><A HREF="../up?q=1#f">U &amp; V</A><a href="//cdn.example/x">C</a><a href="?only">Q</a><a href="sub.html">again</a>"""
    return p.unionByName(p.select((F.col("page_id") + 1000000).alias("page_id"), "url", F.lit(more).alias("html")))


@query(_LINKED + "SELECT page_id, href, arg_min(label, p) AS label, min(p)::INT AS place FROM l WHERE starts_with(href, o || '/') OR starts_with(href, o || '?') GROUP BY ALL")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return X.links(_linked(spark, d), "page_id", "url", "html")


@query(r"""WITH n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS source, (page_id * 7 + 13 * place + 5) % n AS page_id, place FROM pages, n, (SELECT unnest(range(6))::INT AS place)),
 o AS (SELECT min(page_id) AS page_id FROM pages GROUP BY regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)), i AS (SELECT DISTINCT source, page_id, place FROM e),
 k AS (SELECT source, page_id, row_number() OVER (PARTITION BY source ORDER BY place, page_id) AS rn FROM i),
 r1 AS (SELECT DISTINCT p.page_id FROM k JOIN o ON k.source = o.page_id JOIN pages p ON p.page_id = k.page_id WHERE rn <= 3 AND p.page_id NOT IN (SELECT page_id FROM o)),
 r2 AS (SELECT DISTINCT p.page_id FROM k JOIN r1 ON k.source = r1.page_id JOIN pages p ON p.page_id = k.page_id WHERE rn <= 5 AND p.page_id NOT IN (SELECT page_id FROM o UNION SELECT page_id FROM r1))
 SELECT page_id, 0 AS round FROM o UNION ALL SELECT page_id, 1 FROM r1 UNION ALL SELECT page_id, 2 FROM r2""")
def page_follow(spark: SparkSession, d: str) -> DataFrame:
    """O-121: from each site's first page two rounds of links, three and five a page in their order."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("origin"))
    start = p.groupBy("origin").agg(F.min("page_id").alias("page_id"))
    size = p.agg(F.count("*").alias("n"))
    to = (F.col("page_id") * 7 + 13 * F.col("place") + 5) % F.col("n")
    edges = p.crossJoin(F.broadcast(size)).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(F.col("page_id").alias("source"), to.alias("href"), "place").distinct()
    return X.follow_rounds(start, edges, p, "page_id", "source", "href", "place", [3, 5])


@query(r"""SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<\s*(?:script|iframe)\b|\son[a-z]+\s*=|(?:href|src)\s*=\s*["'']?\s*javascript:')""")
def unsafe_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(X.unsafe_markup(F.col("html"))).select("page_id")


# The scan's rules.
RULES = {"licence": "(?i)licen[cs]ed? under", "mail": "[a-z0-9._]+@[a-z0-9.]+", "symbols": r"[%$#&*]{3}", "reserved": "All rights reserved", "phrase": "(?:[a-z]+ ){14}[a-z]+"}


@query("WITH h AS (" + " UNION ALL ".join(f"SELECT doc_id, source, '{k}' AS rule, text, regexp_extract(text, '{v}') AS hit, instr(text, regexp_extract(text, '{v}')) AS pos FROM documents WHERE regexp_matches(text, '{v}')" for k, v in RULES.items()) + ") SELECT doc_id, rule, substr(text, greatest(pos - 30, 1), pos + length(hit) + 40 - greatest(pos - 30, 1)) AS snippet FROM h")
def rule_scan(spark: SparkSession, d: str) -> DataFrame:
    return X.rule_scan(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", RULES)


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{v}')) AS {k}" for k, v in RULES.items()) + " FROM documents GROUP BY 1 HAVING " + " + ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{v}'))" for v in RULES.values()) + " > 0")
def rule_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = X.rule_scan(docs.select("doc_id", "text"), "doc_id", "text", RULES).join(docs.select("doc_id", "source"), "doc_id")
    return X.rule_report(hits, "source", list(RULES))


@query(_EVT + """, s AS (SELECT *, count(CASE WHEN action = 'signup' THEN value END) OVER (PARTITION BY target ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg, CASE WHEN action = 'signup' THEN value END AS day, CASE WHEN action = 'click' THEN event_id END AS venue FROM evt)
 SELECT event_id, last_value(day IGNORE NULLS) OVER w AS day, last_value(venue IGNORE NULLS) OVER w AS venue FROM s WINDOW w AS (PARTITION BY target, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).withColumns({"day": F.when(F.col("action") == "signup", F.col("value")), "venue": F.when(F.col("action") == "click", F.col("event_id"))})
    return X.carry_forward(e, ["target"], ["ts", "event_id"], ["venue"], reset="day").select("event_id", "day", "venue")


@query(_EVT.replace("WITH ", "WITH RECURSIVE ") + """, o AS (SELECT event_id, target, value AS y, row_number() OVER (PARTITION BY target ORDER BY value DESC, event_id) AS rn FROM evt WHERE value IS NOT NULL),
 r AS (SELECT event_id, target, rn, y AS anchor, 0 AS line FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.target, o.rn, CASE WHEN r.anchor - o.y > 3 THEN o.y ELSE r.anchor END, CASE WHEN r.anchor - o.y > 3 THEN r.line + 1 ELSE r.line END FROM r JOIN o ON o.target = r.target AND o.rn = r.rn + 1)
 SELECT event_id, line FROM r""")
def fragment_rows(spark: SparkSession, d: str) -> DataFrame:
    e = B.events(spark, d).filter("value is not null").select("event_id", "target", "value")
    return X.anchored_rows(e, ["target"], "value", 3.0).select("event_id", "line")


@query("SELECT slot, arg_min(doc_id, p) AS doc_id FROM (SELECT doc_id % 120 AS slot, doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END * 1000000 + doc_id AS p FROM documents WHERE n_chars > 1000) GROUP BY 1 UNION ALL SELECT s, NULL FROM (SELECT DISTINCT doc_id % 120 AS s FROM documents) WHERE s NOT IN (SELECT doc_id % 120 FROM documents WHERE n_chars > 1000)")
def ordered_title_pick(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select((F.col("doc_id") % 120).alias("slot"), "doc_id", "lang", "n_chars")
    place = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    plan = docs.select("slot", (place * 1000000 + F.col("doc_id")).alias("place"), F.col("doc_id").alias("title"))
    landed = docs.select(F.col("doc_id").alias("title"), F.col("n_chars").alias("size"))
    return X.first_landed(plan, landed, "slot", "place", "title", "size", 1000).select("slot", F.col("title").alias("doc_id"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY CASE WHEN doc_id % 10 = length(text) % 10 THEN 0 ELSE 1 END, doc_id) = 1")
def version_pick(spark: SparkSession, d: str) -> DataFrame:
    """O-07: of the records of one text the one whose number its length names, else the first."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10 == F.length("text") % 10).alias("own"))
    return X.pick_version(docs, "text", F.col("own"), "doc_id").select("doc_id")
