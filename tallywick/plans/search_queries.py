"""Queries for visibility, joins, search and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.operators import joins, ranking, search
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.session import Scratch, table
from tallywick.sources import files


@query("SELECT n_nationkey, n_name FROM nation")
def narrow_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name")


@query("SELECT d.doc_id, lang, source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1")
def published_documents(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return joins.published(labelled, F.col("quality") == 1).select("doc_id", "lang", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def visible_children(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_acctbal > 0")
    orders = joins.visible_children(table(spark, d, "orders").filter("o_orderstatus = 'F'"), [(customers, "o_custkey", "c_custkey")])
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.visible_children(lines, [(orders, "l_orderkey", "o_orderkey"), (table(spark, d, "part").filter("p_size <= 25"), "l_partkey", "p_partkey")]).drop("l_partkey")


@query("SELECT c_custkey AS id, c_name AS title, coalesce(n, 0) AS orders, coalesce(s, 'none') AS latest_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def summary_projection(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    rows = table(spark, d, "customer").join(counts, "c_custkey", "left")
    return search.summary(rows, {"c_custkey": "id", "c_name": "title", "n": "orders", "s": "latest_status"}, {"n": 0, "s": "none"})


@query("SELECT entity, name, balance FROM (SELECT c_custkey AS entity, c_name AS name, c_acctbal AS balance FROM customer) WHERE name = 'Customer#000000007' OR entity = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.point_lookup(B.entities(spark, d).select("entity", "name", "balance"), "entity", 7)


@query("SELECT k.place, c_custkey AS entity, c_name AS name FROM (SELECT unnest([42, 7, 99999999, 7, 1]) AS entity, unnest(range(5))::INT AS place) k JOIN customer ON c_custkey = k.entity")
def ordered_key_fetch(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered_fetch(B.entities(spark, d).select("entity", "name"), "entity", [42, 7, 99999999, 7, 1]).select("place", "entity", "name")


@query(r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%' ORDER BY p_partkey LIMIT 500")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], " RE ", [F.col("p_partkey")], 500)


@query("SELECT doc_id, lang FROM documents WHERE contains(text, '%%%') OR contains(source, '%%%') ORDER BY doc_id LIMIT 100")
def two_column_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "documents").select("doc_id", "lang", "text", "source"), ["text", "source"], "%%%", [F.col("doc_id")], 100).select("doc_id", "lang")


@query(B.cte("ent", "app") + """, f AS (SELECT * FROM ent WHERE kind = 'BUILDING' AND district = 3 AND name ILIKE '%0%' AND entity IN (SELECT entity FROM app))
 SELECT *, (SELECT count(*) FROM f) AS total, greatest(1, (SELECT ceil(count(*) / 10) FROM f))::BIGINT AS pages FROM (SELECT entity, name, balance FROM f ORDER BY balance DESC, entity LIMIT 10 OFFSET 0)""")
def faceted_search_page(spark: SparkSession, d: str) -> DataFrame:
    rows = search.faceted(B.entities(spark, d), (["name"], " 0 "), kind="BUILDING", district=3)
    rows = rows.join(B.appearances(spark, d).select("entity").distinct(), "entity", "left_semi")
    return ranking.page_slice(rows.select("entity", "name", "balance"), [F.col("balance").desc(), F.col("entity")], 1, 10)


@query("SELECT doc_id, lang, source, (SELECT count(*) FROM documents WHERE lang = 'de') AS total, (SELECT ceil(count(*) / 20)::BIGINT FROM documents WHERE lang = 'de') AS pages FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def filtered_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = search.faceted(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), lang="de", source=None)
    return ranking.page_slice(rows, [F.col("n_chars").desc(), F.col("doc_id")], 2, 20).drop("n_chars")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1996 AND o_orderpriority = '2-HIGH') AS total, (SELECT greatest(1, ceil(count(*) / 25))::BIGINT FROM orders WHERE year(o_orderdate) = 1996 AND o_orderpriority = '2-HIGH') AS pages FROM orders WHERE year(o_orderdate) = 1996 AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def yearly_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = search.faceted(table(spark, d, "orders").withColumn("year", F.year("o_orderdate")), year=1996, o_orderpriority="2-HIGH")
    return ranking.page_slice(rows.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 0, 25).drop("o_orderdate")


@query(B.cte("evt") + "SELECT event_id, target FROM evt WHERE target IS NULL OR target = 7")
def equal_or_global(spark: SparkSession, d: str) -> DataFrame:
    return B.events(spark, d).filter(search.equal_or_null("target", 7)).select("event_id", "target")


_POLLS = "polls AS (SELECT target, CASE WHEN target % 5 = 0 THEN NULL ELSE min(ts) END AS starts, CASE WHEN target % 7 = 0 THEN NULL ELSE max(ts) FILTER (WHERE action <> 'view') END AS ends FROM evt GROUP BY 1)"


def polls(spark: SparkSession, d: str) -> DataFrame:
    """A poll per target: open from its first event (fifths: from ever) to its last (sevenths: for ever)."""
    g = B.events(spark, d).groupBy("target").agg(F.min("ts").alias("s"), F.max(F.when(F.col("action") != "view", F.col("ts"))).alias("e"))
    return g.select("target", F.when(F.col("target") % 5 != 0, F.col("s")).alias("starts"), F.when(F.col("target") % 7 != 0, F.col("e")).alias("ends"))


@query(B.cte("evt") + "," + _POLLS + ", mid AS (SELECT to_timestamp((epoch(min(ts)) + epoch(max(ts)))::BIGINT // 2)::TIMESTAMP AS now FROM evt) SELECT target FROM polls, mid WHERE (starts IS NULL OR starts <= now) AND (ends IS NULL OR ends >= now)")
def active_polls(spark: SparkSession, d: str) -> DataFrame:
    mid = B.events(spark, d).agg(F.timestamp_seconds(F.floor(F.floor(F.unix_micros(F.min("ts")) / 1000000 + F.unix_micros(F.max("ts")) / 1000000 + 0.5) / 2)).alias("now"))
    return polls(spark, d).crossJoin(F.broadcast(mid)).filter(search.active_at("starts", "ends", F.col("now"))).select("target")


@query("SELECT doc_id, quality FROM (SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality FROM labels) WHERE quality IS NOT NULL ORDER BY quality, doc_id LIMIT 30")
def highlight_slots(spark: SparkSession, d: str) -> DataFrame:
    slots = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"))
    return search.highlights(slots, "quality", "doc_id", 30)


@query("SELECT c_custkey AS entity FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def indexable_keys(spark: SparkSession, d: str) -> DataFrame:
    return search.indexable(B.entities(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("entity")), "entity")


@query(B.cte("ent") + "SELECT entity FROM ent WHERE kind IN ('BUILDING', 'MACHINERY') AND district < 20 AND balance > 0 AND length(name) >= 8")
def eligible_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    tests = {"kind": c("kind").isin("BUILDING", "MACHINERY"), "region": c("district") < 20, "open": c("balance") > 0, "width": F.length("name") >= 8}
    return search.eligible(B.entities(spark, d), tests).select("entity")


@query(B.cte("ent") + """SELECT coalesce(reason, 'ready') AS bucket, count(*) AS n FROM (SELECT CASE WHEN NOT kind IN ('BUILDING', 'MACHINERY') THEN 'kind' WHEN NOT district < 20 THEN 'district' WHEN NOT balance > 0 THEN 'closed' END AS reason FROM ent) GROUP BY 1""")
def fail_soft_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    why = search.reason({"kind": c("kind").isin("BUILDING", "MACHINERY"), "district": c("district") < 20, "closed": c("balance") > 0})
    return B.entities(spark, d).groupBy(F.coalesce(why, F.lit("ready")).alias("bucket")).agg(F.count("*").alias("n"))


@query(B.cte("ent", "dim") + "SELECT entity, district, district_name, region FROM ent LEFT JOIN (SELECT * FROM dim WHERE district <> 4) USING (district)")
def embed_dimension(spark: SparkSession, d: str) -> DataFrame:
    out = joins.embed_one(B.entities(spark, d), B.districts(spark, d).filter("district <> 4"), "district", ["district_name", "region"], "place")
    return out.select("entity", "district", "place.district_name", "place.region")


@query("SELECT o_orderkey, coalesce(lines, '') AS lines, coalesce(total, 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    out = joins.embed_many(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber"], ["l_partkey", "l_linenumber"], "lines", total="l_linenumber")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return out.select("o_orderkey", text.alias("lines"), F.col("lines_total").alias("total"))


@query("SELECT l_orderkey, arg_min(l_suppkey, (CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY 1")
def role_pick(spark: SparkSession, d: str) -> DataFrame:
    return joins.main_link(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_returnflag") == "A", ["l_linenumber", "l_suppkey"])


@query("SELECT p_partkey, l_orderkey, l_linenumber, l_suppkey FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7")
def through_link(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey")
    far = table(spark, d, "supplier").filter("s_nationkey = 7").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.through_link(table(spark, d, "part").select("p_partkey"), links, far, "p_partkey", "l_suppkey")


@query(B.cte("ent") + "SELECT a.district, a.entity, b.entity AS sibling, row_number() OVER (PARTITION BY a.entity ORDER BY b.balance DESC, b.entity)::INT AS place FROM ent a JOIN ent b ON a.district = b.district AND a.entity <> b.entity QUALIFY place <= 6")
def siblings_topk(spark: SparkSession, d: str) -> DataFrame:
    return joins.siblings(B.entities(spark, d), "district", "entity", [F.col("balance").desc(), F.col("entity")], 6)


@query("""SELECT c.conv_id, c.turn, r.r_name, n.n_name FROM conversations c LEFT JOIN region r ON r.r_regionkey = c.conv_id % 7 LEFT JOIN nation n ON n.n_nationkey = c.conv_id % 40
 WHERE role = 'user' ORDER BY CASE WHEN turn > 2 THEN NULL ELSE length(text) END DESC NULLS LAST, c.conv_id, c.turn LIMIT 200""")
def message_listing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("conv_id") % 7).alias("rk"), (F.col("conv_id") % 40).alias("nk"), F.when(F.col("turn") <= 2, F.length("text")).alias("at"))
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("rk"), "r_name")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name")
    return joins.two_refs(c, region, nation, ("rk", "nk")).orderBy(F.col("at").desc_nulls_last(), "conv_id", "turn").limit(200).select("conv_id", "turn", "r_name", "n_name")


@query(B.cte("ent") + "SELECT entity, name, balance FROM ent WHERE district = 7")
def partition_read(spark: SparkSession, d: str) -> DataFrame:
    """One district of a table partitioned by district; no other partition is opened."""
    path = f"{Scratch(spark, 'entities').root}/by-district"
    files.write_partitions(B.entities(spark, d), path, "district", ["entity"])
    return files.read_partition(spark, path, "district", 7).select("entity", "name", "balance")


@query("SELECT page_id, octet_length(encode(html)) AS bytes, regexp_matches(html, '(?is)<meta[^>]*charset') AS named FROM pages")
def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Landed bodies decoded by the charset that their own head names."""
    raw = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("header"))
    decoded = files.decode_pages(raw, "content", "header")
    return decoded.select("page_id", F.octet_length("text").alias("bytes"), F.col("text").rlike("(?is)<meta[^>]*charset").alias("named"))
