"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least-hashed of its s-mers stands at one of its
ends. Whether it is depends on the k-mer alone, so the anchors of a passage are the same wherever it
stands, and every run of k - s + 1 k-mers has at least one. The fingerprint keeps the `size` anchors
of least hash with their positions: base64 of (hash, position) pairs of 32 bits in text order.

Likeness of two fingerprints (0 to 1): of the `size` least anchors of both together, the share that
both have and whose positions ascend in both texts (the longest such chain). It estimates the
Jaccard similarity of the anchor sets; equal texts have equal fingerprints and the likeness 1.

chained pairs every document with the next one in ascending id order without a global window: ids
are cut at bounded quantiles, texts are dealt once by range, and each range also gets the first
document of the next one.

Defined results: null is the empty text; a text of fewer than k code points has one anchor, itself;
two empty texts are alike (1), an empty and another are not (0); documents with equal ids follow
each other by text; rows with a null id come first; a single document is its own next; other columns
are ignored; an empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.textcore import mix, slices

#: Length of the k-mers and of their inner s-mers, and anchors in a fingerprint.
K, S, SIZE = 20, 8, 64
#: Most ranges into which ids are cut: the bound of what the driver holds of them.
MOST_RANGES = 20_000

_M = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _windows(points: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all windows of the given lengths, by doubling."""
    out, one = {}, points.astype(np.uint64) + np.uint64(1)
    power, size, factor = {1: one}, 1, {1: _M}
    while size * 2 <= max(sizes):
        half = power[size]
        power[size * 2] = half[:-size] * factor[size] + half[size:] if len(half) > size else half[:0]
        with np.errstate(over="ignore"):
            factor[size * 2] = factor[size] * factor[size]
        size *= 2
    for want in sizes:
        have, at = None, 0
        n = len(points) - want + 1
        for bit in sorted((b for b in power if b & want), reverse=True):
            part = power[bit][at : at + n]
            have = part if have is None else have * factor[bit] + part
            at += bit
        out[want] = mix(have)
    return out


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers."""
    if len(points) < k:
        whole = _windows(points, (len(points),))[len(points)] if len(points) else np.zeros(0, np.uint64)
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(len(whole), np.int64)
    hashed = _windows(points, (s, k))
    inner, span = (hashed[s] >> np.uint64(32)).astype(np.uint32), k - s + 1
    least, size = inner, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    return (hashed[k][at] >> np.uint64(32)).astype(np.uint32), at


def sketch(points: np.ndarray, size: int = SIZE, k: int = K, s: int = S) -> np.ndarray:
    """The anchors of least hash, each with its first position, ordered by hash: rows (hash, position)."""
    hashes, at = anchors(points, k, s)
    if len(hashes) > 4 * size:  # fewer to sort; repeated anchors may leave too few, then all are sorted
        few = hashes <= np.partition(hashes, 2 * size)[2 * size]
        if len(np.unique(hashes[few])) >= size:
            hashes, at = hashes[few], at[few]
    hashes, first = np.unique(hashes, return_index=True)
    return np.stack([hashes[:size], at[first[:size]].astype(np.uint32)], axis=1)


def to_text(rows: np.ndarray) -> str:
    return base64.b64encode(rows[np.argsort(rows[:, 1], kind="stable")].astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the least anchors of both that both have in the same order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a[:, 0], b[:, 0])[:size]
    both, ia, ib = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    ia, ib = ia[both <= union[-1]], ib[both <= union[-1]]
    ends: list[int] = []
    for x in b[ib[np.argsort(a[ia, 1], kind="stable")], 1].tolist():
        i = bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends) / len(union)


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, halo, id, text) dealt so that a document's next one follows it in its task.

    Sorted by range, own rows before halo rows, id and text; the last own row of a range is followed
    by the first document of the next range (after the last range: of the first).
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4 * width, MOST_RANGES)
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = np.unique(np.array(ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) or [], dtype=np.int64))

    def range_of(values: pd.Series) -> np.ndarray:
        return np.where(values.isna(), 0, np.searchsorted(cuts, values.fillna(0).to_numpy().astype(np.int64), "right"))

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(range_of(values), dtype="int32")

    # one row per range: its first id
    lowest = ids.groupBy(place("id").alias("r")).agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nulls")).orderBy("r").collect()
    before = {(None if x.nulls else x["first"]): lowest[i - 1].r for i, x in enumerate(lowest)}

    @F.pandas_udf("array<int>")
    def places(values: pd.Series) -> pd.Series:
        own = range_of(values)
        return pd.Series([[int(r), before[k]] if (k := None if pd.isna(v) else int(v)) in before else [int(r)] for v, r in zip(values, own, strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("places", places("id")).select(F.posexplode("places").alias("halo", "r"), "id", "text")
    return rows.select("r", "halo", "id", "text").repartition(width, "r").sortWithinPartitions("r", "halo", F.col("id").asc_nulls_first(), "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_chars, its edited text's digest, both fingerprints and the two likenesses."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the row before, with its sketch; a halo row only serves the last own row of its range
        last: tuple | None = None
        for batch in slices(batches):
            done: list[tuple] = []
            for r, halo, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if halo and (last is None or last[0] != r or last[1]):
                    continue
                mine = sketch(code_points(text))
                if last is not None and not last[1] and last[0] == r:
                    changed = edited(last[3], text)
                    other = sketch(code_points(changed))
                    done.append((last[2], len(last[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_text(last[4]), to_text(other), likeness(last[4], other), likeness(last[4], mine)))
                last = (r, halo, key, text, mine)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, to) for x, to in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=schema.names)

    return chained(docs, id_col, text_col).mapInArrow(apply, schema)
