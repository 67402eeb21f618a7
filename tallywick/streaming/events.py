"""The community operators on streams; the batch forms in operators.community are their twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tallywick.operators import community
from tallywick.session import Scratch


def read_events(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Files that land in a folder, each taken once."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def with_event_time(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark on the event time; times without zone are cast, as a watermark needs an instant (T-09)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def unique_presses(events: DataFrame, keys: list[str], within_watermark: bool = False) -> DataFrame:
    """First press per key (T-01). The state keeps every key; with within_watermark only those of the
    watermark's delay, so that a press repeated later than that counts again."""
    return events.dropDuplicatesWithinWatermark(keys) if within_watermark else events.dropDuplicates(keys)


def guard_target(events: DataFrame, published: DataFrame, target: str) -> DataFrame:
    """Stream-static semi join (T-03)."""
    return events.join(published.select(target), target, "left_semi")


def guard_votes(votes: DataFrame, polls: DataFrame, options: DataFrame, poll: str, option: str, ts: str) -> DataFrame:
    """Stream-static guards with reasons (T-04); the batch function holds on streams as it is."""
    return community.guard_votes(votes, polls, options, poll, option, ts)


def keyed_state(spark: SparkSession) -> None:
    """The store that keyed list state and timers need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Lots that keys are dealt to for state. Checkpoints hold state by lot, so this is no setting.
LOTS = 1024
#: Rows of a packed chunk of state.
CHUNK = 10_000


def pack(rows: list[tuple]) -> list[tuple[bytes]]:
    """Rows of one width as chunks of Arrow columns, values of list state."""
    chunks = []
    for i in range(0, len(rows), CHUNK):
        part = pa.table([pa.array(c) for c in zip(*rows[i : i + CHUNK], strict=True)], [str(c) for c in range(len(rows[i]))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as out:
            out.write_table(part)
        chunks.append((sink.getvalue().to_pybytes(),))
    return chunks


def unpack(state: Any) -> Iterator[tuple]:
    """The rows of a list state of packed chunks."""
    for (chunk,) in state.get() if state.exists() else ():
        yield from zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(chunk)).read_all().columns), strict=True)


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of (time, rank) over all batches.

    State and timers are those of a lot of keys, as a call of the store costs about the same for one row
    as for a chunk: calls grow with lots and rows, not with keys. Rows stream frame by frame into list
    state, packed; a timer wakes the lot when the watermark has passed its first one, and what the watermark
    has passed is taken in order. So memory holds a lot's rows of one watermark delay or batch, and a batch's
    cut through the events does not show in the results. Rows that come later than the delay are dropped,
    as by any event-time operator. A wake reads and writes what its lot's keys keep.
    """

    #: Names of the results' columns.
    columns: list[str]

    def __init__(self, key: str, ts: str, rank: str, value: str | None):
        self.key, self.ts, self.rank, self.value = key, ts, rank, value

    def step(self, key: str | None, rows: list[tuple], kept: Any) -> tuple[list[tuple], Any]:
        """Results of a key's rows (time in microseconds, rank, value) that are due, in order, and what it keeps."""
        raise NotImplementedError

    def expire(self, kept: dict[str | None, Any], now: int) -> int | None:
        """Drop what has ended of the keys' state and say when (microseconds) all the rest will have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.kept = handle.getListState("kept", "rows binary")

    def wake(self, micros: int, now: int) -> None:
        self.handle.registerTimer(max(-(-micros // 1000), now + 1))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame[self.ts].to_numpy("datetime64[us]").astype("int64").tolist()
            keys, values = ([None if pd.isna(v) else str(v) for v in frame[c]] if c else [None] * len(at) for c in (self.key, self.value))
            self.pending.appendList(pack(list(zip(at, frame[self.rank].tolist(), keys, values, strict=True))))
            first = min(at if first is None else [first, *at])
        if first is not None:
            self.wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for row in unpack(self.pending):
            (due if row[0] <= now * 1000 else later).append(row)
        if later:
            if due:
                self.pending.put(pack(later))
            self.wake(min(r[0] for r in later), now)
        elif due:
            self.pending.clear()
        by_key: dict[str | None, list[tuple]] = {}
        for at, rank, who, value in sorted(due, key=lambda r: r[:2]):
            by_key.setdefault(who, []).append((at, rank, value))
        before = dict(unpack(self.kept))
        kept, results = dict(before), []
        for who, rows in by_key.items():
            found, kept[who] = self.step(who, rows, kept.get(who))
            results += found
        end = self.expire(kept, now)
        if kept:
            if kept != before:
                self.kept.put(pack(list(kept.items())))
            if end is not None:
                self.wake(end, now)
        elif before:
            self.kept.clear()
        if results:
            frame = pd.DataFrame(results, columns=self.columns)
            for c in {self.ts, "published_at"} & set(self.columns):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            yield frame

    def close(self) -> None:
        pass


class Counter(InOrder):
    """Sums that never fall below zero."""

    def __init__(self, key: str, ts: str, rank: str, value: str):
        super().__init__(key, ts, rank, value)
        self.columns = [key, "n"]

    def step(self, key: str | None, rows: list[tuple], kept: int | None) -> tuple[list[tuple], int]:
        n = kept or 0
        for _, _, delta in rows:
            n = max(n + int(delta), 0)
        return [(key, n)], n


class RateLimit(InOrder):
    """Verdicts by the times that were accepted within the window."""

    def __init__(self, visitor: str, ts: str, rank: str, limit: int, seconds: int):
        super().__init__(visitor, ts, rank, None)
        self.columns = [rank, visitor, ts, "accepted"]
        self.limit, self.window = limit, seconds * 1_000_000

    def step(self, key: str | None, rows: list[tuple], kept: list[int] | None) -> tuple[list[tuple], list[int]]:
        recent, verdicts = deque(kept or ()), []
        for at, rank, _ in rows:
            while recent and at - recent[0] >= self.window:
                recent.popleft()
            accepted = len(recent) < self.limit
            if accepted:
                recent.append(at)
            verdicts.append((rank, key, at, accepted))
        return verdicts, list(recent)

    def expire(self, kept: dict[str | None, list[int]], now: int) -> int | None:
        """State of a visitor who stays away ends with the window."""
        for who, times in list(kept.items()):
            kept[who] = [x for x in times if now * 1000 - x < self.window]
            if not kept[who]:
                del kept[who]
        return max((times[-1] + self.window for times in kept.values()), default=None)


class FirstPublished(InOrder):
    """The time of a key's first change to published, once."""

    def __init__(self, key: str, ts: str, rank: str, value: str):
        super().__init__(key, ts, rank, value)
        self.columns = [key, "published_at"]

    def step(self, key: str | None, rows: list[tuple], kept: dict[str, Any] | None) -> tuple[list[tuple], dict[str, Any]]:
        kept, stamps = kept or {"status": None, "stamped": False}, []
        was, stamped = kept["status"], kept["stamped"]
        for at, _, status in rows:
            if status == "published" and was not in (None, "published") and not stamped:
                stamped = True
                stamps.append((key, at))
            was = status
        return stamps, {"status": was, "stamped": stamped}


def in_order(rows: DataFrame, processor: InOrder, out: T.StructType, mode: str) -> DataFrame:
    """What a processor makes of the rows, dealt to lots by their key. A key goes as a string, null as
    null, since pandas rounds whole numbers beside nulls."""
    key = processor.key
    dealt = rows.withColumns({"__lot": F.pmod(F.xxhash64(key), F.lit(LOTS)).cast("int"), key: F.col(key).cast("string")})
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in out])
    done = dealt.groupBy("__lot").transformWithStateInPandas(processor, text, mode, "EventTime")
    return done.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in out))


def saturating_counts(events: DataFrame, key: str, delta: Column, ts: str, rank: str) -> DataFrame:
    """Counter per key that never falls below zero, for update mode (T-02): its value whenever the
    watermark has passed changes of it, which are taken in order of ts and rank. Needs a watermark on ts."""
    keyed_state(events.sparkSession)
    rows = events.select(key, ts, F.col(rank).cast("long").alias(rank), delta.cast("long").alias("delta"))
    out = T.StructType([T.StructField(key, events.schema[key].dataType), T.StructField("n", T.LongType())])
    return in_order(rows, Counter(key, ts, rank, "delta"), out, "Update")


def rate_limit(events: DataFrame, visitor: str, ts: str, key: str, limit: int, seconds: int) -> DataFrame:
    """Accepted and rejected events by their key (T-06), in order of ts and key over all batches; state of
    at most `limit` times per visitor besides the rows that the watermark has not passed."""
    keyed_state(events.sparkSession)
    rows = events.select(visitor, ts, F.col(key).cast("long").alias(key))
    out = T.StructType([T.StructField(key, T.LongType()), events.schema[visitor], T.StructField(ts, T.TimestampType()), T.StructField("accepted", T.BooleanType())])
    return in_order(rows, RateLimit(visitor, ts, key, limit, seconds), out, "Append")


def first_published(changes: DataFrame, key: str, status: str, ts: str, rank: str) -> DataFrame:
    """key and published_at, emitted once at the first change to published after another status (T-07)."""
    keyed_state(changes.sparkSession)
    rows = changes.select(key, ts, F.col(rank).cast("long").alias(rank), F.col(status).cast("string").alias(status))
    out = T.StructType([T.StructField(key, changes.schema[key].dataType), T.StructField("published_at", T.TimestampType())])
    return in_order(rows, FirstPublished(key, ts, rank, status), out, "Append")


def content_digest(rows: DataFrame, partition: str) -> DataFrame:
    """(partition, digest): a digest of a partition's rows that does not depend on their order."""
    every = F.xxhash64(*(F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(rows.columns)))
    hashed = rows.groupBy(partition).agg(F.count("*").alias("n"), F.sum(every.cast("decimal(38,0)")).alias("s"), F.bit_xor(every).alias("x"))
    return hashed.select(partition, F.concat_ws(":", "n", "s", "x").alias("digest"))


def merge_partitions(batch: DataFrame, path: str, partition: str, keys: list[str], scratch: Scratch) -> DataFrame:
    """Merge rows by key into a partitioned table and say which partitions changed (T-08).

    Rows of the batch replace those of their key in the same partition, other rows stay. A partition
    whose content comes out the same, by its digest, is not rewritten. A batch that is taken again after
    a failure changes nothing. Returns (partition, digest) of the partitions written.
    """
    spark = batch.sparkSession
    batch = scratch.save(batch.withColumn("__new", F.lit(1)), "batch")
    own = batch.drop("__new")
    touched = own.select(partition).distinct()
    rows = batch
    before = content_digest(own.limit(0), partition)
    if _exists(spark, path):
        there = spark.read.schema(own.schema).parquet(path).join(touched, partition, "left_semi").select(own.columns)
        rows = rows.unionByName(there.withColumn("__new", F.lit(0)))
        before = content_digest(there, partition)
    # of a key's rows that of the batch; equal rows count once, of different ones the least by its values
    order = [F.col("__new").desc(), F.to_json(F.struct(*(c for c in own.columns)))]
    first = F.row_number().over(Window.partitionBy(partition, *keys).orderBy(*order))
    merged = scratch.save(rows.withColumn("__rn", first).filter("__rn = 1").select(own.columns), "merged")
    after = content_digest(merged, partition)
    changed = after.join(before.withColumnRenamed("digest", "was"), partition, "left").filter(~F.col("digest").eqNullSafe(F.col("was")))
    changed = scratch.save(changed.select(partition, "digest"), "changed")
    written = merged.join(changed.select(partition), partition, "left_semi")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return changed


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_changed_partitions(
    stream: DataFrame, path: str, checkpoint: str, partition: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None, log: str | None = None
) -> StreamingQuery:
    """Each batch is merged by key into the partitions it has rows for; only those whose content changes
    are rewritten, and no other (T-08). `log`: a folder that gets (partition, digest, batch) per rewrite."""

    def save(batch: DataFrame, number: int) -> None:
        scratch = Scratch(batch.sparkSession, "merge")
        changed = merge_partitions(prepare(batch) if prepare else batch, path, partition, keys, scratch)
        if log:
            changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/{number:06d}")
        scratch.clear()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
