"""Queries of sources, sinks and streams: given rows are written, landed or streamed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.operators import resolve, search
from tallywick.plans import bindings as B
from tallywick.plans.catalog import query
from tallywick.plans.document_queries import text
from tallywick.session import Scratch, table
from tallywick.sources import files
from tallywick.streaming import events as streams


@query("""SELECT p_partkey::VARCHAR AS key, '"山' || p_name || '", ' || chr(10) || p_brand AS name FROM part""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """O-02: a national encoding, doubled quotes, line ends in fields, a header row per file."""
    name = text('"山', F.col("p_name"), '", \n', F.col("p_brand")).alias("name")
    path = f"{Scratch(spark, 'csv').root}/parts"
    files.allow_legacy_charsets(spark)
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), name)
    rows.write.csv(path, header=True, quoteAll=True, escape='"', encoding="Shift_JIS")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "name")])
    return files.read_csv(spark, path, schema, "Shift_JIS", skip=1)


@query("SELECT 'k' || c_custkey % 100 AS key, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def dictionary_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """O-03: keys that a dictionary states more than once."""
    path = f"{Scratch(spark, 'dictionary').root}/lines"
    pair = text('  "k', F.col("c_custkey") % 100, '": "', F.col("c_name"), '",')
    lines = table(spark, d, "customer").select(pair.alias("value"))
    ends = spark.range(2, numPartitions=1).select(F.when(F.col("id") == 0, "{").otherwise("}").alias("value"))
    lines.unionByName(ends).write.text(path)
    return files.read_dictionary(spark, path)[1]


@query("""SELECT page_id, strlen(html)::BIGINT AS bytes, md5(html) AS text_md5, 200 + (page_id % 3)::INT AS status, sha256(html) AS digest, true AS intact, true AS packed FROM pages""")
def raw_landing(spark: SparkSession, d: str) -> DataFrame:
    """O-06: bodies landed in containers, every third a second time, read back by their newest and decoded;
    no more files than tasks wrote them."""
    path = f"{Scratch(spark, 'landing').root}/bodies"
    k = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", "html", text("p", k).alias("url"), (200 + k % 3).cast("int").alias("status"))
    at = F.timestamp_seconds(F.lit(86400))
    old = pages.filter(k % 3 == 0).withColumns({"content": F.encode(text("old ", k), "UTF-8"), "fetched_at": at})
    new = pages.withColumns({"content": F.encode("html", "UTF-8"), "fetched_at": at + F.expr("INTERVAL 1 DAY")})
    tasks = 0
    for part in (old, new):
        files.land_pages(part, path)
        tasks += part.rdd.getNumPartitions()
    packed = len(spark.read.parquet(path).inputFiles()) <= tasks
    decoded = files.decode_pages(files.read_landed(spark, path).withColumn("header", F.lit(None).cast("string")), "content", "header")
    page = F.substring("url", 2, 20).cast("long")
    return decoded.select(page.alias("page_id"), "bytes", F.md5("text").alias("text_md5"), "status", "digest", "intact", F.lit(packed).alias("packed"))


@query("SELECT DISTINCT c_nationkey AS district, true AS same FROM customer")
def deterministic_sink(spark: SparkSession, d: str) -> DataFrame:
    """O-10: the same rows in another order and dealing give the same bytes."""
    root, rows = Scratch(spark, "sink").root, B.entities(spark, d)
    found = []
    for i, df in enumerate((rows, rows.repartition(7).orderBy(F.col("balance")))):
        files.write_partitions(df, f"{root}/{i}", "district", ["entity"])
        body = files.read_pages(spark, f"{root}/{i}").select(F.regexp_extract("path", r"district=(\d+)", 1).cast("int").alias("district"), F.sha2("content", 256).alias(f"d{i}"))
        found.append(body.groupBy("district").agg(F.array_sort(F.collect_list(f"d{i}")).alias(f"d{i}")))
    return found[0].join(found[1], "district", "full").select("district", F.col("d0").eqNullSafe(F.col("d1")).alias("same"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'u' || s_suppkey || '|' || s_name || '|' || CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE '' END END AS image FROM supplier")
def image_refs(spark: SparkSession, d: str) -> DataFrame:
    """O-15: a struct of address, credit and source, null without an address."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 > 0, text("u", k)).alias("url"), F.col("s_name").alias("credit"), F.when(k % 2 == 0, "own").alias("source"))
    image = rows.select("s_suppkey", search.image_ref("url", "credit", "source").alias("i"))
    shown = F.concat("i.url", F.lit("|"), "i.credit", F.lit("|"), F.coalesce("i.source", F.lit("")))
    return image.select("s_suppkey", F.when(F.col("i").isNotNull(), shown).alias("image"))


@query("""WITH l AS (SELECT c_nationkey AS scope, 'N' || c_custkey % 40 AS label, c_custkey AS target FROM customer WHERE c_acctbal > 0),
 a AS (SELECT c_nationkey AS scope, 'N' || c_custkey % 60 AS label, c_custkey + CASE WHEN c_custkey % 9 = 0 THEN 10000000 ELSE 0 END AS target FROM customer WHERE c_acctbal <= 0)
 SELECT 'label' AS kind, * FROM l UNION ALL SELECT 'label', a.* FROM a WHERE target < 10000000 AND NOT EXISTS (SELECT 1 FROM l WHERE l.scope = a.scope AND l.label = a.label) UNION ALL SELECT 'unknown', * FROM a WHERE target >= 10000000""")
def manual_aliases(spark: SparkSession, d: str) -> DataFrame:
    """O-44: aliases where a label is free, and those of unknown targets."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    scope = F.col("c_nationkey").alias("scope")
    labels = c.filter("c_acctbal > 0").select(scope, text("N", k % 40).alias("label"), k.alias("target"))
    aliases = c.filter("c_acctbal <= 0").select(scope, text("N", k % 60).alias("label"), (k + F.when(k % 9 == 0, 10000000).otherwise(0)).alias("target"))
    found, unknown = resolve.add_aliases(labels, aliases, c.select(k.alias("target")), "scope", "label", "target")
    return found.select(F.lit("label").alias("kind"), "*").unionByName(unknown.select(F.lit("unknown").alias("kind"), "scope", "label", "target"))


@query("""WITH e AS (SELECT event_type, event_id, event_id % 3 AS part, event_id < 7 AND event_id % 3 = 2 AS stale FROM events)
 SELECT event_type, count(*) AS n, max(event_id) AS newest, count(DISTINCT part) FILTER (WHERE part < 2 OR stale) AS rewrites FROM e GROUP BY 1
 UNION ALL SELECT 'untouched', 5, 4, 0""")
def changed_partitions(spark: SparkSession, d: str) -> DataFrame:
    """T-08: three batches land in the same partitions, the third with rows that are there already but
    for two; each merges by key, so none loses the others' rows, a partition whose content stays is not
    rewritten, and another partition is not touched."""
    root = Scratch(spark, "changed").root
    e = table(spark, d, "events")
    old = e.filter("event_id < 5").withColumn("event_type", F.lit("untouched"))
    stale = e.filter("event_id < 7").withColumn("value", F.lit(-1.0))
    last = e.filter("event_id % 3 = 2 and event_id >= 7")
    old.unionByName(stale).unionByName(last).write.partitionBy("event_type").parquet(f"{root}/out")
    for part in range(3):
        e.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{root}/landed")
        landed = streams.read_events(spark, f"{root}/landed", e.schema)
        streams.write_changed_partitions(landed, f"{root}/out", f"{root}/checkpoint", "event_type", ["event_id"], log=f"{root}/log").awaitTermination()
    out = spark.read.schema(e.schema).parquet(f"{root}/out")
    log = spark.read.schema("event_type string, digest string, batch int").parquet(f"{root}/log/*").groupBy("event_type").agg(F.count("*").alias("rewrites"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("newest")).join(log, "event_type", "left").na.fill(0, ["rewrites"])


#: Batches of a stream, each landed before a run of its own from the checkpoint of the run before.
RUNS = 3


def _stream(spark: SparkSession, d: str, name: str, make, mode: str) -> DataFrame:
    """What a stream over the landed events emits, with the batch's number.

    The events land in RUNS parts by time, and the query runs to its end and starts again after each. A
    last event of a visitor and target of its own, long after all others, moves the watermark past them;
    it passes the filter, which Spark may take before the watermark.
    """
    root = Scratch(spark, name).root
    e = B.events(spark, d).filter("ts is not null")
    span = e.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    micros = F.unix_micros("ts") - F.unix_micros("first")
    width = F.unix_micros("last") - F.unix_micros("first") + 1
    parted = e.crossJoin(F.broadcast(span)).withColumn("part", F.floor(micros * RUNS / width).cast("int"))
    tick = span.select(F.lit(-1).cast("long").alias("event_id"), (F.col("last") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    own = {"event_id": F.col("event_id"), "ts": F.col("ts"), "visitor": F.lit(-1), "target": F.lit(-1)}
    tick = tick.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema))
    rows = None
    for part in range(RUNS + 1):
        landing = parted.filter(F.col("part") == part).select(e.columns) if part < RUNS else tick
        landing.write.mode("append").parquet(f"{root}/landed")
        rows = make(streams.with_event_time(streams.read_events(spark, f"{root}/landed", e.schema), "ts", "1 hour").filter("target is not null and visitor is not null"))

        def save(batch: DataFrame, i: int) -> None:
            batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/{i:06d}")

        q = rows.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/out/*")


_EVT = B.cte("evt")


@query(_EVT + ", s AS (SELECT target, ts, event_id, sum(CASE action WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY target ORDER BY ts, event_id) AS s FROM evt WHERE visitor IS NOT NULL AND target IS NOT NULL AND ts IS NOT NULL) SELECT target, (arg_max(s, (ts, event_id)) - least(0, min(s)))::BIGINT AS n FROM s GROUP BY 1")
def streamed_counter(spark: SparkSession, d: str) -> DataFrame:
    """T-02 on a stream of several batches and runs: the last value of each counter."""
    delta = F.when(F.col("action") == "signup", 1).when(F.col("action") == "error", -1).otherwise(0)
    out = _stream(spark, d, "counter", lambda s: streams.saturating_counts(s, "target", delta, "ts", "event_id"), "update")
    return out.groupBy("target").agg(F.max_by("n", "batch").alias("n"))


@query(_EVT.replace("WITH ", "WITH RECURSIVE ") + """, o AS (SELECT event_id, visitor, ts, row_number() OVER (PARTITION BY visitor ORDER BY ts, event_id) AS rn FROM evt WHERE visitor IS NOT NULL AND target IS NOT NULL),
 r AS (SELECT event_id, visitor, rn, [ts] AS acc, true AS accepted FROM o WHERE rn = 1
  UNION ALL SELECT o.event_id, o.visitor, o.rn, CASE WHEN len(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2 THEN list_append(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR), o.ts) ELSE list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR) END,
   len(list_filter(r.acc, lambda x: x > o.ts - INTERVAL 24 HOUR)) < 2 FROM r JOIN o ON o.visitor = r.visitor AND o.rn = r.rn + 1)
 SELECT event_id, accepted FROM r""")
def streamed_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """T-06 on a stream of several batches and runs: the verdict on every event, by its key."""
    out = _stream(spark, d, "limit", lambda s: streams.rate_limit(s, "visitor", "ts", "event_id", 2, 24 * 3600), "append")
    return out.select("event_id", "accepted")


_STATUS = "CASE action WHEN 'purchase' THEN 'published' WHEN 'view' THEN 'draft' ELSE 'hidden' END"


@query(_EVT + f""", c AS (SELECT target, ts, event_id, {_STATUS} AS status FROM evt WHERE visitor IS NOT NULL AND target IS NOT NULL AND ts IS NOT NULL),
 w AS (SELECT *, lag(status) OVER (PARTITION BY target ORDER BY ts, event_id) AS was FROM c)
 SELECT target, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS published_at, 1 AS stamps FROM w WHERE status = 'published' AND was <> 'published' GROUP BY 1""")
def streamed_publication(spark: SparkSession, d: str) -> DataFrame:
    """T-07 on a stream of several batches and runs: each target's first change to published, stamped once."""
    status = F.expr(_STATUS)
    out = _stream(spark, d, "publication", lambda s: streams.first_published(s.withColumn("status", status), "target", "status", "ts", "event_id"), "append")
    return out.groupBy("target").agg(F.date_format(F.min("published_at"), "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.count("*").cast("int").alias("stamps"))
