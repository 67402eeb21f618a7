"""Files in: CSV with national encodings, JSON dictionaries, raw pages; partitioned tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Charsets that raw pages are decoded by; any other counts as UTF-8.
CHARSETS = ("utf-8", "shift_jis", "euc-jp", "iso-8859-1", "windows-1252", "utf-16")


def allow_legacy_charsets(spark: SparkSession) -> None:
    """Let Spark decode by the JVM's charsets, Shift_JIS among them."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """Quoted CSV with doubled quotes and line ends inside fields (O-02). `skip` header rows are left
    out by their place in each file, so a file must not be split: multi-line files are not."""
    allow_legacy_charsets(spark)
    rows = spark.read.csv(path, schema=schema, multiLine=True, escape='"', encoding=encoding, header=False)
    if not skip:
        return rows
    # a multi-line file is one task in file order, so ids count its rows
    numbered = rows.withColumns({"__f": F.input_file_name(), "__n": F.monotonically_increasing_id()})
    first = numbered.groupBy("__f").agg(F.min("__n").alias("__first"))
    return numbered.join(first, "__f").filter(F.col("__n") >= F.col("__first") + skip).select(rows.columns)


def read_dictionary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A JSON object of strings, one pair per line, as (key, value), and its duplicate keys (O-03).

    Read as text, since a JSON reader keeps only one of equal keys.
    """
    pair = r'^\s*"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,?\s*$'
    lines = spark.read.text(path).filter(F.col("value").rlike(pair))
    rows = lines.select(F.regexp_extract("value", pair, 1).alias("key"), F.regexp_extract("value", pair, 2).alias("value"))
    return rows, rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


#: Columns of a container of landed bodies.
LANDED = "url string, status int, content_type string, fetched_at timestamp, bytes long, digest string, content binary"


def land_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Fetched bodies packed into container files, as many as there are tasks (O-06): url, status,
    content_type, fetched_at and content, with the length and digest of each body.

    A container is Parquet with one row per body, so a reader takes the columns it needs, splits large
    files, and skips bodies by their url or status without opening them.
    """
    content = F.col("content").cast("binary")
    given = [F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in (("status", "int"), ("content_type", "string"), ("fetched_at", "timestamp"))]
    rows = pages.select("url", *given, F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("digest"), content.alias("content"))
    rows.write.mode(mode).parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed bodies, the newest of each url, with `intact`: whether length and digest still hold (O-06).

    Equal times take the greater digest; rows without a time come behind those with one.
    """
    rows = spark.read.schema(LANDED).parquet(path)
    newest = F.struct(F.coalesce(F.col("fetched_at"), F.lit(0).cast("timestamp")).alias("t"), F.col("digest").alias("d"))
    keys = rows.groupBy("url").agg(F.max(newest).alias("newest")).select(F.col("url").alias("__url"), "newest.*")
    own = F.col("url").eqNullSafe(F.col("__url")) & (F.coalesce(F.col("fetched_at"), F.lit(0).cast("timestamp")) == F.col("t")) & F.col("digest").eqNullSafe(F.col("d"))
    found = rows.join(keys, own).dropDuplicates(["url"]).select(rows.columns)
    intact = (F.octet_length("content") == F.col("bytes")) & (F.sha2("content", 256) == F.col("digest"))
    return found.withColumn("intact", F.coalesce(intact, F.lit(False)))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Bodies that stand in files of their own, with their paths (O-06)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_pages(pages: DataFrame, content: str, header: str) -> DataFrame:
    """Text of raw bytes (O-06b): charset of the header, else of a meta tag in the first 4 KB, else
    UTF-8; an unknown charset is decoded as UTF-8 and flagged."""
    allow_legacy_charsets(pages.sparkSession)
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    named = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col(header), F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?is)<meta[^>]*charset=[\"']?([\w-]+)", 1), F.lit("")), F.lit("utf-8"))
    charset = F.lower(F.regexp_replace(F.regexp_replace(named, "(?i)^x-sjis$|^sjis$", "shift_jis"), "(?i)^utf8$", "utf-8"))
    out = pages.withColumn("charset", charset)
    text = F.decode(content, "UTF-8")
    for c in CHARSETS:
        text = F.when(F.col("charset") == c, F.decode(content, c)).otherwise(text)
    return out.withColumn("text", text).withColumn("charset_known", F.col("charset").isin(*CHARSETS))


def write_partitions(df: DataFrame, path: str, partition: str, order: list[str], file_rows: int = 5_000_000) -> None:
    """Rewrite the partitions that df has rows for; the others stay (O-08). Rows are in a total order
    within each file, so equal input gives equal files (O-10).

    A partition of more than `file_rows` rows is dealt to several tasks and files by a hash of the order's
    columns, so a large one is no task of its own.
    """
    shares = df.groupBy(F.col(partition).alias("__of")).agg(F.ceil(F.count("*") / F.lit(file_rows)).alias("__shares"))
    sized = df.join(shares, F.col(partition).eqNullSafe(F.col("__of"))).withColumn("__share", F.pmod(F.xxhash64(*order), F.col("__shares")))
    dealt = sized.repartition(partition, "__share").sortWithinPartitions(partition, "__share", *order).select(df.columns)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_partition(spark: SparkSession, path: str, partition: str, value: object) -> DataFrame:
    """One partition, pruned before any file is opened; an unknown value gives no rows (O-09)."""
    return spark.read.parquet(path).filter(F.col(partition) == F.lit(value))
