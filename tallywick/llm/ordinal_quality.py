"""Ordinal quality classifier: cumulative-link (proportional odds) regression on graded ratings.

All grades share one weight vector over hashed text features; ordered thresholds t1 < t2 < ... turn
the score s into P(grade >= k) = sigmoid(s - t_k). The expected grade is the sum of these tail
probabilities, and a document is selected by its tail probability at the wanted grade.

Defined results: a null or empty text has no features and gets the score 0, so its probabilities
come from the thresholds alone; repeated rows each get a row; ratings with a null grade or id are
not used, of several grades of one id the lowest counts, and of several texts the least. Where all ratings have one grade, every
document gets that grade's side of each threshold; without any ratings nothing can be told and every
document is kept (all tail probabilities 1). Other columns of the input pass through; an input column
with the name of an output column is replaced by it in `score`, and kept as it is in `selected`. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.textcore import slices, texts
from tallywick.session import Scratch

_TOKEN = re.compile(r"\w+|[^\w\s]+")

#: Width of the hashed feature space.
BITS = 20
#: Most rated documents and most of their features used for fitting: the documented bounds of the
#: training sample.
MAX_TRAIN, MAX_FEATURES = 20_000, 1 << 24
OUTPUTS = ("score", "expected_grade", "tail_probability", "keep")


def capitals(text: str) -> int:
    """Characters of the whole text that lower-casing changes."""
    low = text.lower()
    if len(low) != len(text):
        return sum(c != c.lower() for c in text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, low))
    return int((a != b).sum())


class Features:
    """Distinct hashed features of a text: lower-cased words, runs of punctuation, a mark for capitals."""

    def __init__(self, bits: int, limit: int = 300_000):
        self.mask, self.limit = (1 << bits) - 1, limit
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        known, mask = self.known, self.mask
        found = set(_TOKEN.findall(text.lower()))
        if text.isupper():
            found.add("\x00upper")
        elif capitals(text) * 3 > len(text):
            found.add("\x00capitals")
        out = []
        for t in found:
            h = known.get(t)
            if h is None:
                if len(known) > self.limit:
                    known.clear()
                h = known[t] = xxhash.xxh32_intdigest(t.encode("utf-8", "surrogatepass")) & mask
            out.append(h)
        return np.unique(np.array(out, dtype=np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; falls with k as the thresholds ascend."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def informative(rows: np.ndarray, ids: np.ndarray, grades: np.ndarray, width: int, min_z: float) -> np.ndarray:
    """Which features' documents differ from all documents by min_z standard errors in their share
    above any grade. Rare words that only look telling by chance get no weight, so long documents
    do not drift with the number of their words."""
    seen, best = np.bincount(ids, minlength=width).astype(float), np.zeros(width)
    for k in range(1, int(grades.max()) + 1):
        above = grades >= k
        share = above.mean()
        excess = np.abs(np.bincount(ids[above[rows]], minlength=width) - seen * share)
        best = np.maximum(best, excess / np.sqrt(seen * share * (1 - share) + 0.5))
    return best >= min_z


def train_ordinal(offsets: np.ndarray, ids: np.ndarray, grades: np.ndarray, bits: int, levels: int | None = None, rounds: int = 150, l2: float = 2e-4, min_z: float = 4.5) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood of the cumulative logit model.

    offsets, ids: the documents' feature ids, one after another.
    """
    n, width, levels = len(grades), 1 << bits, levels or int(grades.max()) + 1
    all_rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    used = np.flatnonzero(informative(all_rows, ids, grades, width, min_z))
    counts = np.bincount(grades, minlength=levels).astype(float)
    above = np.cumsum(counts[::-1])[::-1][1:] / n
    start = -np.log(np.clip(above, 1e-3, 1 - 1e-3) / np.clip(1 - above, 1e-3, 1))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    place = np.full(width, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    cols = place[ids]
    keep = cols >= 0
    rows, cols = all_rows[keep], cols[keep]
    del all_rows, ids, keep, place
    w, free = np.zeros(len(used)), np.concatenate([start[:1], gaps])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[cols], minlength=n)
        cut = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        # P(grade = k) = sigmoid(score - edge_k) - sigmoid(score - edge_{k+1})
        with np.errstate(over="ignore"):
            lower, upper = (1 / (1 + np.exp(-(score - e))) for e in (edge[grades], edge[grades + 1]))
        prob = np.maximum(lower - upper, 1e-9)
        d_lower, d_upper = lower * (1 - lower) / prob / n, upper * (1 - upper) / prob / n
        g_w = np.bincount(cols, weights=(d_upper - d_lower)[rows], minlength=len(used)) + l2 * w
        d_edge = np.bincount(grades, weights=d_lower, minlength=levels)[1:] - np.bincount(grades, weights=d_upper, minlength=levels)[:-1]
        back = np.cumsum(d_edge[::-1])[::-1]
        g_free = np.concatenate([back[:1], back[1:] * np.exp(free[1:])])
        for x, g, m, v in ((w, g_w, *state[:2]), (free, g_free, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(width, dtype=np.float32)
    weights[used] = w
    return OrdinalModel(weights, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]), bits)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Lists of these lengths, cut from the values one after another."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values, pa.int32()))


def _telling(sample: DataFrame, levels: int, min_z: float) -> np.ndarray:
    """The features of the sample (rows of f, g) that `informative` keeps, counted by Spark: at most as
    many as there are slots."""
    steps = range(1, levels)
    whole = sample.agg(*(F.avg((F.col("g") >= k).cast("double")).alias(f"share{k}") for k in steps))
    seen = sample.select("g", F.explode("f").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), *(F.count_if(F.col("g") >= k).alias(f"n{k}") for k in steps))
    z = []
    for k in steps:
        share = F.col(f"share{k}")
        z.append(F.abs(F.col(f"n{k}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 0.5))
    # a hair lower than the fit's own test, which decides
    telling = seen.crossJoin(F.broadcast(whole)).filter(F.greatest(F.lit(0.0), *z) >= min_z - 1e-6)
    return telling.select("feature").toArrow().column("feature").to_numpy()


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", levels: int = 3, bits: int = BITS, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, min_z: float = 4.5) -> OrdinalModel:
    """Fit on at most max_train rated documents with at most max_features features, taken by a hash of
    their id. Of rows that repeat an id, the one with the least text is used.

    Only the ids of the sample (bounded by max_train) are broadcast. Its features are a table in the
    shared folder, where Spark counts which of them tell grades apart; those alone are gathered for
    the fit.
    """
    spark = docs.sparkSession
    sample = ratings.select(F.col(id_col), grade.cast("int").alias("__grade")).dropna().groupBy(id_col).agg(F.min("__grade").alias("__grade"))
    sample = sample.orderBy(F.xxhash64(id_col), id_col).limit(max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(bits)
        for batch in slices(batches):
            found = [make.of(t) for t in texts(batch.column(0))]
            lists = _lists(np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(f) for f in found], np.int64))
            yield pa.record_batch([lists, *batch.columns[1:]], names=["f", "g", "h"])

    rated = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text")).join(F.broadcast(sample), id_col)
    # one row of every id of the sample, so the gathered rows are bounded by it
    rated = rated.groupBy(id_col, "__grade").agg(F.min("__text").alias("__text"))
    rows = rated.select("__text", "__grade", F.xxhash64(id_col)).mapInArrow(features, "f array<int>, g int, h long")
    upto = F.sum(F.size("f")).over(Window.orderBy("h", "g", "f").rowsBetween(Window.unboundedPreceding, 0))
    rows = Scratch(spark, "quality").save(rows.withColumn("upto", upto).filter(F.col("upto") <= max_features), "sample")

    wanted = np.zeros(1 << bits, bool)
    wanted[_telling(rows, levels, min_z)] = True
    shared = spark.sparkContext.broadcast(wanted)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for batch in batches:
            kept, found = mask[batch.column(0).flatten().to_numpy()], batch.column(0).flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())
            yield pa.record_batch([_lists(found[kept], np.diff(np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])])), *batch.columns[1:]], names=["f", "g", "h", "upto"])

    # one task orders the bounded sample by hash and content: the fit does not depend on how rows were dealt
    rows = rows.mapInArrow(screened, rows.schema).coalesce(1).sortWithinPartitions("upto", "h", "g").select("f", "g").toArrow()
    grades = rows.column("g").to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        cuts = np.arange(1, levels)
        return OrdinalModel(np.zeros(1 << bits, np.float32), np.where(cuts <= (grades[0] if len(grades) else levels), -30.0, 30.0), bits)
    found = rows.column("f").combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
    return train_ordinal(offsets, found.flatten().to_numpy(), grades, bits, levels, min_z=min_z)


def _scorer(docs: DataFrame, model: OrdinalModel, text_col: str):
    """A function of an Arrow batch of docs: scores and tail probabilities of its rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))
    at = docs.columns.index(text_col)

    def start():
        weights, thresholds, bits = shared.value
        made, make = OrdinalModel(weights, thresholds, bits), Features(bits)

        def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            raw = np.array([float(weights[make.of(t)].sum()) for t in texts(batch.column(at))])
            return raw, made.tails(raw)

        return of

    return start


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """docs with score, expected_grade, tail_probability = P(rating >= grade) and keep."""
    start, k = _scorer(docs, model, text_col), grade - 1
    passed = [i for i, c in enumerate(docs.columns) if c not in OUTPUTS or c == text_col]
    schema = T.StructType([*(docs.schema.fields[i] for i in passed), *(T.StructField(c, T.DoubleType()) for c in OUTPUTS[:3]), T.StructField(OUTPUTS[3], T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in slices(batches):
            raw, tails = of(batch)
            new = [pa.array(raw), pa.array(tails.sum(axis=1)), pa.array(tails[:, k]), pa.array(tails[:, k] >= min_tail)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in passed), *new], names=schema.names)

    return docs.mapInArrow(apply, schema)


def selected(docs: DataFrame, model: OrdinalModel, text_col: str = "text", grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """The rows of docs whose tail probability reaches min_tail, as they are."""
    start, k = _scorer(docs, model, text_col), grade - 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in slices(batches):
            yield batch.filter(pa.array(of(batch)[1][:, k] >= min_tail))

    return docs.mapInArrow(apply, docs.schema)


def rated_grade() -> Column:
    """Grades from the labels table: 0 toxic, 1 poor but harmless, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
