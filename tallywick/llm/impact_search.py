"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents become postings of the terms that the items ask for, once, in a table; the corpus counts N, L
and df are sums over all of them. A task turns its documents, some thousands at a time, into one impact
list per term: documents by falling contribution. For an item it reads its lists in step from the top.
A document met first in one list is looked up in all others at once, which also marks its positions
there as seen. A list's best position is the end of its unbroken run of seen positions, wherever they
were seen from; no document that is still unseen can score more than the sum of the contributions at
these positions. The item stops when that sum is strictly below its kth best score, which the task
carries from one lot of documents to the next; equality goes on, as ties are ranked by id.

Each task's best k per item meet in two ranks, the first of them salted. Items are taken in blocks whose
distinct terms are bounded, so what the tasks and the driver hold of the items is bounded too.

Defined results: null and empty texts have no terms, and count neither for N nor as results; every row
of documents is a document, also when its id or its whole row repeats, and a null id ranks first among
equal scores; rows of one item id (or of the null one) are one item with the terms of all of them; an
item without a scoring document has no rows; terms are counted in whole texts; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywick.llm.textcore import slices
from tallywick.session import Scratch

#: Bytes of terms; all other bytes part them. Capitals of ASCII fold.
_KEPT = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in _KEPT)
#: Terms of a block of items, postings that a task holds at a time, and salts of the first rank.
BLOCK_TERMS, LOT_POSTINGS, SALTS = 200_000, 1_000_000, 64
#: Positions read from every list in the first step; each further step reads twice as many.
FIRST_STEP = 16


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(FOLD).split()


class Items:
    """A block of items: their terms, numbered, and per item term numbers and repeats."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]]):
        self.number: dict[bytes, int] = {}
        of: dict[int | None, tuple[list[int], list[int]]] = {}
        for item, term, asked in rows:
            numbers, repeats = of.setdefault(item, ([], []))
            numbers.append(self.number.setdefault(term, len(self.number)))
            repeats.append(asked)
        self.ids = list(of)
        self.terms = [np.array(x[0], np.int64) for x in of.values()]
        self.repeats = [np.array(x[1], np.int64) for x in of.values()]


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term, asked): how often each item asks for each term."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = Counter(terms(text or b""))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "term", "asked"])

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, "item long, term binary, asked long").groupBy("item", "term").agg(F.sum("asked").alias("asked"))


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, size, terms, counts) of every document that has a term: its length and the numbered terms in it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text or b"")
                if words:
                    found = [(number[t], n) for t, n in Counter(words).items() if t in number]
                    done.append((key, len(words), [t for t, _ in found], [n for _, n in found]))
            if done:
                key, size, numbers, counts = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "size", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, "id long, size long, terms array<int>, counts array<int>")


class ImpactLists:
    """Per term the documents of a lot by falling contribution, with direct access by (term, document)."""

    def __init__(self, size: list[int], doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, n_terms: int, weights: np.ndarray):
        m = np.array([100 - 75 + (75 * n * n_docs) // n_terms for n in size], np.int64)
        gain = weights[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))
        order = np.lexsort((doc, -gain, term))
        self.doc, self.gain, term = doc[order], gain[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        # direct access: sorted (term, document) pairs and where they stand in the lists
        self.width = len(size)
        pair = term * self.width + self.doc
        self.at = np.argsort(pair, kind="stable")
        self.pair = pair[self.at]

    def places(self, term: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places of the documents (columns) in the lists of the terms (rows); -1 where they are not in them."""
        want = term[:, None] * self.width + docs[None, :]
        found = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[found] == want, self.at[found], -1)


def best_positions(lists: ImpactLists, term: np.ndarray, repeats: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, list positions read) of an item; complete for scores of at least the kth best.

    known: a kth best score reached elsewhere, or 0.
    """
    some = lists.start[term + 1] > lists.start[term]
    term, repeats = term[some], repeats[some]
    lo, hi = lists.start[term], lists.start[term + 1]
    seen_doc = np.zeros(lists.width, bool)
    base = np.concatenate([[0], np.cumsum(hi - lo)])
    seen = np.zeros(int(base[-1]), bool)
    best = np.zeros(len(term), np.int64)
    docs, scores = [], []
    top = np.zeros(0, np.int64)
    read, step = 0, FIRST_STEP
    while True:
        ends = [lists.doc[a + read : min(a + read + step, b)] for a, b in zip(lo, hi, strict=True)]
        new = np.unique(np.concatenate([*ends, np.zeros(0, np.int64)]))
        new = new[~seen_doc[new]]
        seen_doc[new] = True
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            place = lists.places(term, part)
            held = place >= 0
            score = (np.where(held, lists.gain[place], 0) * repeats[:, None]).sum(0)
            seen[(place - lo[:, None] + base[:-1, None])[held]] = True
            docs.append(part)
            scores.append(score)
            top = np.concatenate([top, score])
            if len(top) > k:
                top = np.partition(top, len(top) - k)[-k:]
        read, step = read + step, step * 2
        bound = 0
        for i in range(len(term)):
            ahead = seen[base[i] + best[i] : base[i + 1]]
            best[i] += len(ahead) if ahead.all() else int(np.argmin(ahead))
            # unseen documents lie beyond the best position: at most the contribution there
            if best[i] < hi[i] - lo[i]:
                bound += int(repeats[i]) * int(lists.gain[lo[i] + max(best[i] - 1, 0)])
        kth = max(known, int(top.min()) if len(top) >= k else 0)
        if bound < kth or bound == 0:
            break
    return np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*scores, np.zeros(0, np.int64)]), int(best.sum())


def _search_block(found: DataFrame, items: Items, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item, id, score): the best k of every task's documents for every item of the block."""
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((items.ids, items.terms, items.repeats, weights))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, term_of, repeats_of, weights = shared.value
        best: list[list[tuple]] = [[] for _ in ids]

        def lot(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            key, lengths = whole.column("id").to_pylist(), whole.column("terms").combine_chunks()
            number = lengths.flatten().to_numpy().astype(np.int64)
            count = whole.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(key)), lengths.value_lengths().to_numpy())
            if not len(number):
                return
            lists = ImpactLists(whole.column("size").to_pylist(), doc, number, count, n_docs, n_terms, weights)
            for i, (term, repeats) in enumerate(zip(term_of, repeats_of, strict=True)):
                known = best[i][-1][0] if len(best[i]) >= k else 0
                docs, scores, _ = best_positions(lists, term, repeats, k, -known if known else 0)
                kept = scores > 0
                docs, scores = docs[kept], scores[kept]
                if len(scores) > k:  # ties with the kth stay
                    kept = scores >= np.partition(scores, len(scores) - k)[-k]
                    docs, scores = docs[kept], scores[kept]
                mine = [(-s, key[d] is not None, key[d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                best[i] = sorted(best[i] + mine)[:k]

        parts, held = [], 0
        for batch in slices(batches, 1024):
            parts.append(batch)
            held += len(batch.column("terms").flatten())
            if held >= LOT_POSTINGS:
                lot(parts)
                parts, held = [], 0
        if parts:
            lot(parts)
        out = [(ids[i], x[2] if x[1] else None, -x[0]) for i, rows in enumerate(best) for x in rows]
        if out:
            item, key, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, pa.int64()), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return found.mapInArrow(apply, "item long, id long, score long")


def _blocks(asked: DataFrame, most: int) -> Iterator[Items]:
    """The items, dealt by a hash of their id to blocks of about `most` terms."""
    n = max(1, math.ceil(asked.count() / most))
    for block in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == block)
        yield Items([(r.item, bytes(r.term), r.asked) for r in rows.orderBy(F.col("item").asc_nulls_first(), "term").toLocalIterator()])


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents, ties by id."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = scratch.save(item_terms(items, item_col, text_col), "asked")
    found: DataFrame | None = None
    for block in _blocks(asked, block_terms):
        if not block.ids:
            continue
        held = scratch.save(postings(docs, block.number, id_col, text_col), "postings")
        totals = held.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("l")).first()
        if not totals.n:
            continue
        df = np.zeros(len(block.number), np.int64)
        for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[r.t] = r["count"]
        part = _search_block(held, block, totals.n, totals.l, df, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long")
    order = (F.col("score").desc(), F.col("id").asc_nulls_first())
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
