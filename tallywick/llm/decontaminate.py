"""Benchmark decontamination by greedy string tiling.

Documents and test items are token sequences (lower-cased runs of letters and digits). Seeds, the
hashed runs of `seed` tokens that a document shares with an item, join the two; for each pair with
seeds, running Karp-Rabin string tiling repeatedly marks the longest non-overlapping common runs of
at least `min_match` tokens, whatever their order, so reordered passages still add up. A document is
contaminated by an item whose tiles cover at least `min_coverage` of the item's tokens.

A benchmark of at most `broadcast_tokens` words, counted by a job of its own, is sent to every task and
meets all documents in one pass without a shuffle. A larger one is never collected: its seeds stay in
Spark, a bitmap of fixed size made of them in the tasks drops most of the documents' other runs, and
what passes is joined with the seeds by shuffle, reduced to pairs of document and item, and tiled pair
by pair. Both ways give the same rows.

Defined results: one row per contaminated document row and item: id, item id, coverage, n_tiles and
longest (tokens). Null and empty texts have no tokens and give no rows. Items of fewer than `seed` tokens
are too short to tell a passage by: they contaminate a document only where its tokens are the item's,
all and in order. Seeds that several items share lead to all of them. Repeated document rows each give
rows, repeated items likewise; other columns are ignored; an empty benchmark or document table gives no
rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallywick.llm.textcore import WordHasher, gram_hashes, slices, texts
from tallywick.session import Scratch

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) of running Karp-Rabin greedy string tiling.

    The search length starts at the item's length and halves down to min_match; at each length, runs
    of unmarked tokens meet by their hashes, are extended, and the longest are marked first. A run
    much longer than the search length restarts the search at its own length, as the method has it.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(doc), len(item)))
    while True:
        found = _runs(doc, item, free_doc, free_item, length)
        if found and found[0][0] > 2 * length:
            length = found[0][0]
            continue
        clashed = False
        for size, at_doc, at_item in found:
            if free_doc[at_doc : at_doc + size].all() and free_item[at_item : at_item + size].all():
                free_doc[at_doc : at_doc + size] = False
                free_item[at_item : at_item + size] = False
                tiles.append((at_doc, at_item, size))
            else:
                clashed = True
        if clashed and found:
            continue  # what is left of the overlapped runs may still be long enough
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


def _runs(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of unmarked tokens of at least `length`, longest first."""
    if length > len(doc) or length > len(item):
        return []
    starts_doc = np.flatnonzero(_all_free(free_doc, length))
    starts_item = np.flatnonzero(_all_free(free_item, length))
    if not len(starts_doc) or not len(starts_item):
        return []
    of_item: dict[int, list[int]] = defaultdict(list)
    for i, h in zip(starts_item.tolist(), gram_hashes(item, length)[starts_item].tolist(), strict=True):
        of_item[h].append(i)
    hashes = gram_hashes(doc, length)[starts_doc]
    hits = np.isin(hashes, np.fromiter(of_item, np.uint64, len(of_item)))
    found = []
    for d, h in zip(starts_doc[hits].tolist(), hashes[hits].tolist(), strict=True):
        for i in of_item[h]:
            if d and i and free_doc[d - 1] and free_item[i - 1] and doc[d - 1] == item[i - 1]:
                continue  # part of a run that starts earlier
            size = 0
            while d + size < len(doc) and i + size < len(item) and free_doc[d + size] and free_item[i + size] and doc[d + size] == item[i + size]:
                size += 1
            if size >= length:
                found.append((size, d, i))
    return sorted(found, key=lambda x: (-x[0], x[1], x[2]))


def _all_free(free: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return total[length:] - total[:-length] == length


class Benchmark:
    """A bounded set of items with its seed table."""

    def __init__(self, items: list[tuple[object, np.ndarray]], seed: int):
        self.items, self.seed = items, seed
        # a text of fewer tokens than a seed has one run, all of it, whose hash holds its length
        grams = [np.unique(gram_hashes(words, seed)) for _, words in items]
        owners = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        grams = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order], owners[order]

    def met(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each item with a seed in the document: the positions of its seeds."""
        out: dict[int, np.ndarray] = {}
        if len(words) and len(self.grams):
            found = gram_hashes(words, self.seed)
            low = np.searchsorted(self.grams, found)
            hit = np.flatnonzero(self.grams[np.minimum(low, len(self.grams) - 1)] == found)
            if len(hit):
                high = np.searchsorted(self.grams, found[hit], "right")
                many = high - low[hit]
                at = np.repeat(hit, many)
                step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                owner = self.owners[np.repeat(low[hit], many) + step]
                for k in np.unique(owner).tolist():
                    out[k] = at[owner == k]
        return out


def near_seeds(words: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The document's tokens within reach of a seed; gaps become one token that matches nothing.

    Tiles hold at least one seed, and none is longer than the item, so nothing outside can be tiled.
    """
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.maximum(at - reach, 0), 1)
    np.add.at(change, np.minimum(at + reach, len(words)), -1)
    inside = np.cumsum(change[:-1]) > 0
    kept, gap = words.copy(), ~inside
    kept[gap] = 0
    return kept[inside | np.concatenate([[False], inside[:-1]])]


def _found(known: Benchmark, words: np.ndarray, min_match: int, min_coverage: float) -> Iterator[tuple]:
    """(item id, coverage, tiles, longest tile) of every item that contaminates a document."""
    for k, at in known.met(words).items():
        item_id, item = known.items[k]
        tiles = greedy_tiles(near_seeds(words, at, len(item) + known.seed), item, min(min_match, len(item)))
        covered = sum(t[2] for t in tiles) / len(item)
        if covered >= min_coverage:
            yield item_id, covered, len(tiles), max(t[2] for t in tiles)


#: Words of a benchmark that is sent to every task; log2 of the bits of a larger one's bitmap.
BROADCAST_TOKENS, BITMAP_BITS = 2_000_000, 27


def _collected(benchmark: DataFrame, item_col: str, item_text: str, most: int) -> list[tuple[object, np.ndarray]] | None:
    """The items and their words where they are at most `most`, else None. Measured in the tasks before
    anything is collected."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([pa.array([len(tokens(t)) for t in texts(batch.column(0))], pa.int64())], names=["n"])

    size = benchmark.select(item_text).mapInArrow(measure, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if size[0] > most or size[1] > most:
        return None
    hasher = WordHasher()
    rows = benchmark.select(F.col(item_col), F.col(item_text)).collect()
    items = [(r[0], hasher.ids(tokens(r[1] or ""))) for r in rows]
    return [x for x in items if len(x[1])]


def _check(seed: int, min_match: int) -> None:
    if min_match < seed:
        raise ValueError("a tile of min_match tokens must hold a seed")


def _schema(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str) -> T.StructType:
    ids = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType)]
    return T.StructType([*ids, T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.IntegerType()), T.StructField("longest", T.IntegerType())])


def _rows(found: list[tuple], first: list[pa.Array], item_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """A batch of (row, item id, coverage, tiles, longest), with the columns of `first` taken by row."""
    at, items, covered, tiles, longest = zip(*found, strict=True)
    taken = [c.take(pa.array(at)) for c in first]
    return pa.RecordBatch.from_arrays([*taken, pa.array(items, item_type), pa.array(covered, pa.float64()), pa.array(tiles, pa.int32()), pa.array(longest, pa.int32())], names=names)


def _grams(rows: DataFrame, key: str, text: str, seed: int, bitmap: Broadcast | None = None) -> DataFrame:
    """(key, gram), each once per row; with a bitmap only grams whose bit is set there."""
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("gram", T.LongType())])
    shift = np.uint64(64 - BITMAP_BITS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in slices(batches, 256):
            sets = []
            for t in texts(batch.column(1)):
                grams = np.unique(gram_hashes(hasher.ids(tokens(t)), seed))
                if bits is not None:
                    place = grams >> shift
                    grams = grams[bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0]
                sets.append(grams.view(np.int64))
            of = pa.array(np.repeat(np.arange(len(sets)), [len(g) for g in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.concatenate(sets))], names=["key", "gram"])

    return rows.select(key, text).mapInArrow(apply, schema)


def _bitmap(grams: DataFrame) -> bytes:
    """One bit per leading BITMAP_BITS of a gram: 16 MB however many grams there are. The set bits are
    gathered as words of 64, one row each, which bounds what reaches the driver."""
    place = F.shiftrightunsigned("gram", 64 - BITMAP_BITS)
    words = grams.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - BITMAP_BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def _joined(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, seed: int, min_match: int, min_coverage: float) -> DataFrame:
    """Contaminated rows as in `contaminated`, with the digest of their text (`text_md5`), for a
    benchmark of any size."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    schema = _schema(docs, benchmark, id_col, item_col)
    # items and texts under keys of their own: ids may repeat or be null
    items = scratch.save(benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("item")).groupBy("item_id", "item").agg(F.count("*").alias("times")).withColumn("item_key", F.xxhash64("item_id", "item")), "items")
    seeds = scratch.save(_grams(items, "item_key", "item", seed).distinct(), "seeds")
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.md5(F.coalesce(text_col, F.lit(""))).alias("text_md5"))
    # copies of a text bring their grams once
    met = _grams(rows, "text_md5", "text", seed, bitmap).distinct().join(seeds.select("gram", F.col("key").alias("item_key")), "gram")
    pairs = scratch.save(met.select(F.col("key").alias("text_md5"), "item_key").distinct(), "pairs")
    held = rows.join(pairs.select("text_md5").distinct(), "text_md5", "left_semi")
    one = held.groupBy("text_md5").agg(F.first("text").alias("text"))
    item_type = to_arrow_type(schema["item_id"].dataType)
    names = ["text_md5", "times", *schema.names[1:]]
    tiled = T.StructType([T.StructField("text_md5", T.StringType()), T.StructField("times", T.LongType()), *schema.fields[1:]])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches, 128):
            found = []
            for r, (text, item, item_id) in enumerate(zip(texts(batch.column(2)), texts(batch.column(3)), batch.column(4).to_pylist(), strict=True)):
                known = Benchmark([(item_id, hasher.ids(tokens(item)))], seed)
                found += [(r, *x) for x in _found(known, hasher.ids(tokens(text)), min_match, min_coverage)]
            if found:
                yield _rows(found, [batch.column(0), batch.column(1)], item_type, names)

    whole = pairs.join(one, "text_md5").join(items, "item_key").select("text_md5", "times", "text", "item", "item_id")
    hits = scratch.save(whole.mapInArrow(tile, tiled), "hits")
    out = rows.select("doc_id", "text_md5").join(hits, "text_md5").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select("text_md5", *schema.names)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = 5, min_match: int = 5, min_coverage: float = 0.5, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row per contaminated document and item (see the module). min_match must be at least seed."""
    _check(seed, min_match)
    items = _collected(benchmark, item_col, item_text, broadcast_tokens)
    if items is None:
        return _joined(docs, benchmark, id_col, text_col, item_col, item_text, seed, min_match, min_coverage).drop("text_md5")
    schema, shared = _schema(docs, benchmark, id_col, item_col), docs.sparkSession.sparkContext.broadcast(items)
    item_type = to_arrow_type(schema["item_id"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Benchmark(shared.value, seed), WordHasher()
        for batch in slices(batches):
            found = [(r, *x) for r, text in enumerate(texts(batch.column(1))) for x in _found(known, hasher.ids(tokens(text)), min_match, min_coverage)]
            if found:
                yield _rows(found, [batch.column(0)], item_type, schema.names)

    return docs.select(id_col, text_col).mapInArrow(apply, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seed: int = 5, min_match: int = 5, min_coverage: float = 0.5, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """docs without the rows that any item contaminates; a bounded benchmark is one pass, no shuffle."""
    _check(seed, min_match)
    items = _collected(benchmark, item_col, item_text, broadcast_tokens)
    if items is None:
        gone = _joined(docs, benchmark, text_col, text_col, item_col, item_text, seed, min_match, min_coverage).select(F.col("text_md5").alias("__gone"))
        return docs.join(gone, F.md5(F.coalesce(text_col, F.lit(""))) == F.col("__gone"), "left_anti")
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(items)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Benchmark(shared.value, seed), WordHasher()
        for batch in slices(batches):
            clean = [next(_found(known, hasher.ids(tokens(t)), min_match, min_coverage), None) is None for t in texts(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)
