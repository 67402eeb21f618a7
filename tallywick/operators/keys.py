"""Key allocation and publishing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.session import Scratch


def allocate_keys(rows: DataFrame, row_id: str, priority: str, candidates: Column) -> DataFrame:
    """Unique keys in order of priority: every row takes its first candidate that is still free (O-131).

    The greedy order is the stable outcome of deferred acceptance, as all keys rank their proposers
    by one priority. Only what is in motion moves: a round takes the rows that lost their place and the
    holders of the keys that they ask for next, and writes the new holders and those turned down. A
    key's holder is the proposer of best priority of all rounds. Rows that run out of candidates end
    with a null key; null candidates are none. row_id and priority must be unique.
    """
    spark = rows.sparkSession
    root = Scratch(spark, "keys").root
    asking = rows.select(F.col(row_id).alias("row"), F.col(priority).alias("rank"), F.array_compact(candidates).alias("forms"), F.lit(0).alias("place"))
    schema, turn = None, 0
    while True:
        asked = asking.withColumn("key", F.get("forms", "place")).filter("key is not null").withColumn("new", F.lit(True))
        if turn:
            held = spark.read.schema(schema).parquet(f"{root}/*").filter("won").join(asked.select("key").distinct(), "key", "left_semi")
            held = held.groupBy("key").agg(F.min_by(F.struct("row", "rank", "forms", "place"), "rank").alias("h"))
            asked = asked.unionByName(held.select("h.*", "key", F.lit(False).alias("new")))
        # the best per key is pre-aggregated, so a key that many ask for is no task of its own
        best = asked.groupBy("key").agg(F.min("rank").alias("best"))
        met = asked.join(best, "key").withColumn("won", F.col("rank") == F.col("best")).filter("new or not won").drop("new", "best")
        met.write.parquet(f"{root}/{turn:06d}")
        schema = met.schema
        lost = spark.read.schema(schema).parquet(f"{root}/{turn:06d}").filter("not won and place + 1 < size(forms)")
        if lost.isEmpty():
            break
        asking, turn = lost.select("row", "rank", "forms", (F.col("place") + 1).alias("place")), turn + 1
    holders = spark.read.schema(schema).parquet(f"{root}/*").filter("won").groupBy("key").agg(F.min_by("row", "rank").alias("__row"))
    return rows.join(holders, F.col(row_id) == F.col("__row"), "left").drop("__row")


def key_forms(stem: Column, kind: Column, district: Column, numbered: int = 3) -> Column:
    """Candidate keys: plain, with kind, with district, with both, and numbered."""
    plain = F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-")
    forms = [plain, F.concat_ws("-", plain, kind), F.concat_ws("-", district, plain), F.concat_ws("-", district, plain, kind)]
    return F.array(*forms, *(F.concat_ws("-", plain, F.lit(str(i + 2))) for i in range(numbered)))


def publish_decision(entries: DataFrame, key: str, district: str, roster_districts: DataFrame, members: DataFrame, by_name: Column) -> DataFrame:
    """publish or draft, and why (O-132): by the roster where the district has one, else by the name rule."""
    out = entries.join(roster_districts.select(district).distinct().withColumn("__r", F.lit(True)), district, "left")
    out = out.join(members.select(key).distinct().withColumn("__m", F.lit(True)), key, "left")
    rostered, member = F.col("__r").isNotNull(), F.col("__m").isNotNull()
    yes = F.when(rostered, member).otherwise(F.coalesce(by_name, F.lit(False)))
    return out.select(*entries.columns, F.when(yes, "published").otherwise("draft").alias("status"), F.when(rostered, "roster").otherwise("name").alias("by"))
