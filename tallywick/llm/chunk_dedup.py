"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes (the last 32 decide); a chunk ends where its masked bits are
zero, on a character boundary, or at `most` bytes. Cuts depend on the bytes around them alone, so an
insertion moves the chunks after it without changing them. Chunks are deduplicated by their 128-bit
digest: the documents of a digest are counted with partial aggregation first, and chunks that more
than one document holds join back to their places. Runs of such chunks in a document are repeated
passages, which count from `min_words` words in whole chunks on. A run is split into spans by whether
a document of lesser id holds the chunks: a stretch of `min_words` words that one does is a span of its
own, and chunks that this document is the first to hold are never in it. Shorter stretches (chunks of
a few bytes repeat by chance) stay with the chunks around them, which the document keeps.

A chunk at either end of a repeat is cut differently, so a span is on average two thirds of a chunk
to two chunks shorter than the repeat: with chunks of 32 bytes, 24 words in whole chunks stand for
repeats of about 35 words, and repeats of over 50 words are missed in under 4 of 100 at 51 words and
under 1 of 100 from 60 words on.

Defined results: null and empty texts have no chunks; rows with equal ids count as documents of their
own, where their texts differ told apart by the text's hash, which orders them behind the id; a passage that repeats in one document only is no span; texts of any length are chunked whole;
rows with a null id are left out; other columns are ignored; an empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.textcore import mix, slices, texts
from tallywick.session import Scratch

#: log2 of the mean chunk, and the longest chunk, in bytes.
MEAN_BITS, MOST = 5, 512
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At every byte, sum of gear[byte i back] << i over the last 32 bytes, by doubling the window."""
    h, size = _GEAR[data], 1
    while size < 32:
        more = h.copy()
        more[size:] += h[:-size] << np.uint32(size)
        h, size = more, size * 2
    return h


def cut_points(data: np.ndarray, mean_bits: int = MEAN_BITS, most: int = MOST) -> np.ndarray:
    """Ends of the chunks, the last being the end of the data; every cut is before a character."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.concatenate([(data[1:] & 0xC0) != 0x80, [True]])
    ends = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - mean_bits) == 0) & starts) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > most:
        # long chunks are cut every `most` bytes from their start, moved on to the next character
        at = np.flatnonzero(starts) + 1
        extra = np.concatenate([np.arange(e - g + most, e, most) for e, g in zip(ends[gaps > most], gaps[gaps > most], strict=True)])
        ends = np.union1d(ends, at[np.searchsorted(at, extra)])
    return ends


def text_hash(text_col: str) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, chunk number, character and word offsets of its ends, digest, and whether the row had it before."""
    fields = [docs.schema[id_col], T.StructField("text_hash", T.LongType()), *(T.StructField(c, t) for c, t in (("k", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("words", T.IntegerType()), ("high", T.LongType()), ("low", T.LongType()), ("again", T.BooleanType())))]
    schema = T.StructType(fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            parts: list[list[np.ndarray]] = []
            for row, text in enumerate(texts(batch.column(1))):
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = cut_points(data)
                if not len(ends):
                    continue
                begins = np.concatenate([[0], ends[:-1]])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                blanks = np.concatenate([[0], np.cumsum((data == 32) | (data == 10))])
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                order = np.lexsort((digests[:, 1], digests[:, 0]))
                same = np.zeros(len(order), bool)
                same[order[1:]] = (digests[order[1:]] == digests[order[:-1]]).all(axis=1)
                parts.append([np.full(len(ends), row), np.arange(len(ends), dtype=np.int32), chars[begins], chars[ends], (blanks[ends] - blanks[begins]).astype(np.int32), digests[:, 0], digests[:, 1], same])
            if parts:
                row, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in (0, 2)), *(pa.array(np.ascontiguousarray(x)) for x in rest)], names=schema.names)

    return docs.mapInArrow(apply, schema)


def _told_apart(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """id, text and text_hash, which is 0 where all rows of the id have one text."""
    rows = docs.select(id_col, text_col, text_hash(text_col).alias("text_hash")).filter(F.col(id_col).isNotNull())
    several = rows.groupBy(id_col).agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).filter("a <> b")
    several = scratch.save(several.select(id_col, F.lit(True).alias("b")), "several")
    part = F.when(F.col("b"), F.col("text_hash")).otherwise(F.lit(0).cast("long"))
    return rows.join(several, id_col, "left").select(id_col, text_col, part.alias("text_hash"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24) -> DataFrame:
    """Spans that other documents repeat: id, text_hash, start, end (code points), n_words, n_chunks,
    n_docs, first_doc, repeat.

    n_docs is the number of documents that share its longest chunk, first_doc the least id of them;
    repeat says whether that first holder is another row, one of lesser id or text hash: then every
    chunk of the span has an earlier holder. Words are counted over the spans of a run: where a run is
    split, n_words of a span can be below min_words.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    told = _told_apart(docs, id_col, text_col, scratch)
    chunks = _chunks(told, id_col, text_col)
    row, chunk = [id_col, "text_hash"], ["high", "low"]
    shared = chunks.filter("not again").groupBy(*chunk).agg(F.count("*").alias("n_docs"), F.min(id_col).alias("first_doc")).filter("n_docs > 1")
    # the least text hash matters only among rows that share the first holder's id
    parts = _chunks(told.filter("text_hash <> 0"), id_col, text_col).groupBy(*chunk, id_col).agg(F.min("text_hash").alias("first_part"))
    parts = scratch.save(parts.withColumnRenamed(id_col, "first_doc"), "parts")
    shared = shared.join(parts, [*chunk, "first_doc"], "left").na.fill(0, ["first_part"])
    shared = scratch.save(shared, "shared")
    places = scratch.save(chunks.drop("again").join(shared, ["high", "low"]).drop("high", "low"), "places")
    # a row that is there twice holds its chunks twice
    runs = places.dropDuplicates([*row, "k"])
    runs = runs.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*row).orderBy("k")))
    runs = runs.withColumn("run_words", F.sum("words").over(Window.partitionBy(*row, "run"))).withColumn("earlier", (F.col("first_doc") < F.col(id_col)) | ((F.col("first_doc") == F.col(id_col)) & (F.col("first_part") < F.col("text_hash"))))
    runs = runs.withColumn("stretch", F.col("k") - F.row_number().over(Window.partitionBy(*row, "run", "earlier").orderBy("k")))
    runs = runs.withColumn("cut", F.col("earlier") & (F.sum("words").over(Window.partitionBy(*row, "run", "earlier", "stretch")) >= min_words))
    runs = runs.withColumn("stretch", F.col("k") - F.row_number().over(Window.partitionBy(*row, "run", "cut").orderBy("k")))
    # the longest chunk speaks for its span, in a span that is kept the longest that has no earlier holder
    size = F.struct(F.col("cut") | ~F.col("earlier"), F.col("end") - F.col("start"), -F.col("k"))
    spans = runs.filter(F.col("run_words") >= min_words).groupBy(*row, "run", "cut", "stretch").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").alias("n_words"),
        F.count("*").alias("n_chunks"),
        F.max_by("n_docs", size).alias("n_docs"),
        F.max_by("first_doc", size).alias("first_doc"),
        F.max_by("earlier", size).alias("repeat"),
        F.max(F.col("end") - F.col("start")).alias("longest"),
    )
    # what a cut leaves of a run is a span where it has the words, or a chunk too long for chance
    kept = spans.filter(F.col("cut") | (F.col("n_words") >= min_words) | (F.col("longest") >= 1 << MEAN_BITS))
    return kept.drop("run", "cut", "stretch", "longest")


def without_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with those spans cut out of their texts that an earlier row holds first."""
    cuts = spans.filter("repeat").groupBy(id_col, "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    names = docs.columns
    at = names.index(text_col)
    extra, key = "__cuts", "__hash"
    while {extra, key, f"{key}id"} & set(names):
        extra, key = f"{extra}_", f"{key}_"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, spans_of in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                kept, last = [], 0
                for s in spans_of or []:
                    kept.append((text or "")[last : s["start"]])
                    last = max(last, s["end"])
                out.append("".join(kept) + text[last:] if spans_of and text is not None else text)
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    cuts = cuts.select(F.col(id_col).alias(f"{key}id"), F.col("text_hash").alias(key), F.col("cuts").alias(extra))
    mine = (F.col(id_col) == F.col(f"{key}id")) & ((F.col(key) == 0) | (F.col(key) == text_hash(text_col)))
    return docs.join(cuts, mine, "left").select(*names, extra).mapInArrow(apply, docs.schema)
