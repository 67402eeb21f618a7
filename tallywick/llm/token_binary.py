"""Token-ID output: whole texts to ids, ids to range-coded binary frames in id order, and back.

write_ids deals the documents to partitions by ranges of their id, sorts each, encodes every whole
text, appends the end id and packs the ids of consecutive documents into frames. A frame is one
self-contained record of a file: magic, version, block size, counts, the length and CRC-32 of all that
lies before the payloads, per document its number of ids, per block its payload length and CRC-32 (of ids and payload),
the coder's model of the frame, then the range-coded payloads of independently reset blocks
(tallywick.llm.range_coder). Frames are rows of Parquet files that Spark's
commit protocol writes, so a lost executor leaves no half-written shard and any Hadoop file system
will do; shard and frame number give the order.

read_ids decodes the frames, checks the CRCs and returns one row per document with the position of
its first id among all ids; positions come from prefix sums over frames within shards and over shards.

Defined results: null and empty texts give the end id alone; documents with equal ids are ordered by
their text; rows with a null id come first; other columns are ignored; an empty table writes no
frames and reads back as an empty table. A frame whose checksums fail raises ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallywick.llm.range_coder import decode_blocks, encode_blocks
from tallywick.llm.textcore import slices, texts

MAGIC, VERSION = b"TWID", 2
#: magic, version, ids of a block, documents, ids, blocks, bytes of the coder's model; then a CRC-32 of
#: this and of everything up to the payloads
_HEAD, _SUM = struct.Struct("<4sHIIQII"), struct.Struct("<I")
#: Ids of a block, and ids at which a frame is closed (a longer document has a frame of its own size).
BLOCK, FRAME = 1024, 1 << 22

# The pieces into which byte-level BPE files of this kind part a text, letters first as
# no other piece starts with them; for texts of Latin-1 characters with the letters spelt out, which is
# faster. Python's classes agree with the tokenizer's on the characters of _PLAIN: ASCII without control
# characters, Latin, Greek and Cyrillic letters, general punctuation, kana and Han.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LATIN = "\t\n\r -~\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00ff"
_OTHER = "\u0100-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u0527\u2010-\u2027\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcb"
_PLAIN_LATIN, _PLAIN = re.compile(f"[{_LATIN}]*"), re.compile(f"[{_LATIN}{_OTHER}]*")
_LATIN_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_PIECES = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Every byte as the printable character that stands for it in such a file's vocabulary: itself where
#: it is printable, otherwise one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_BLANK = chr(_BYTES[32])


class _Pieces(dict[str, bytes]):
    """Packed ids by piece, learnt when first asked for. Two generations of at most `limit` pieces each:
    a full one becomes the old one, from which pieces in use come back."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.model, self.limit, self.old = tokenizer.model, limit, {}
        self.model._resize_cache(0)  # a table of its own would only repeat this one

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
                shown = _BLANK + piece[1:]
            else:
                shown = piece.encode("utf-8").decode("latin-1").translate(_BYTES)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class PieceTokenizer:
    """Ids of whole texts from a byte-level BPE file, equal to Tokenizer.encode(text,
    add_special_tokens=False) of the file as it is.

    Texts of plain characters are parted into pieces as the file's own first step does, and the file's
    model is asked once per piece, of which a task keeps a bounded table. Texts that hold other
    characters or an added token's string go through the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer, limit)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def encode(self, text: str) -> bytes:
        if not self.added.search(text):
            parts = _LATIN_PIECES if _PLAIN_LATIN.fullmatch(text) else _PIECES if _PLAIN.fullmatch(text) else None
            if parts:
                return b"".join(map(self.pieces.__getitem__, parts.findall(text)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def tokenizer_of(path: str) -> PieceTokenizer:
    """The tokenizer of a file, one per Python worker, so that its tasks share what it has learnt."""
    return PieceTokenizer(path)


def _block_sum(ids: np.ndarray, k: int, block: int, payload: bytes) -> int:
    """CRC-32 of the ids of block k and of its payload."""
    return zlib.crc32(payload, zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()))


def pack_frame(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """The frame of consecutive documents' ids."""
    model, payloads = encode_blocks(ids, block)
    sums = [_block_sum(ids, k, block, p) for k, p in enumerate(payloads)]
    head = _HEAD.pack(MAGIC, VERSION, block, len(lengths), len(ids), len(payloads), len(model))
    table = b"".join([
        lengths.astype("<u8").tobytes(),
        np.array([len(p) for p in payloads], "<u4").tobytes(),
        np.array(sums, "<u4").tobytes(),
        model,
    ])
    return b"".join([head, _SUM.pack(zlib.crc32(table, zlib.crc32(head))), table, *payloads])


def unpack_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per document); ValueError where the frame is damaged."""
    if len(frame) < _HEAD.size + _SUM.size:
        raise ValueError("a frame ends early")
    magic, version, block, n_docs, n_ids, n_blocks, n_model = _HEAD.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of this format")
    at = _HEAD.size + _SUM.size
    payload = at + 8 * n_docs + 8 * n_blocks + n_model
    if zlib.crc32(frame[at:payload], zlib.crc32(frame[: _HEAD.size])) != _SUM.unpack_from(frame, _HEAD.size)[0]:
        raise ValueError("the head of a frame fails its checksum")
    lengths = np.frombuffer(frame, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    sizes = np.frombuffer(frame, "<u4", n_blocks, at).tolist()
    sums = np.frombuffer(frame, "<u4", n_blocks, at + 4 * n_blocks).tolist()
    model = frame[payload - n_model : payload]
    payloads = []
    for size in sizes:
        payloads.append(frame[payload : payload + size])
        payload += size
    try:
        ids = decode_blocks(model, payloads, n_ids, block)
    except IndexError as e:  # a damaged payload can run past its end
        raise ValueError("a block ends early") from e
    for k, crc in enumerate(sums):
        if _block_sum(ids, k, block, payloads[k]) != crc:
            raise ValueError(f"block {k} fails its checksum")
    return ids, lengths


def write_ids(docs: DataFrame, path: str, tokenizer: Callable[[], PieceTokenizer], end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, frame_ids: int = FRAME, partitions: int | None = None) -> None:
    """Write the frames of all documents to `path`, in ascending order of id by (shard, frame)."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    end = np.array([end_id], "<u4").tobytes()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, held, size, make = TaskContext.get().partitionId(), 0, [], 0, None

        def close() -> pa.RecordBatch:
            data = b"".join(b for _, b in held)
            lengths = np.array([len(b) // 4 for _, b in held])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.int32()), pa.array([[k for k, _ in held]], pa.list_(id_type)), pa.array([len(data) // 4], pa.int64()), pa.array([pack_frame(np.frombuffer(data, "<u4"), lengths, block)], pa.binary())], names=schema.names)

        for batch in slices(batches, 256):
            make = make or tokenizer()
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = make.encode(text)
                held.append((key, ids + end))
                size += len(ids) // 4 + 1
                if size >= frame_ids:
                    yield close()
                    made, held, size = made + 1, [], 0
        if held:
            yield close()

    rows = docs.select(id_col, text_col)
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), F.col(id_col).asc_nulls_first())
    dealt.sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col).mapInArrow(apply, schema).write.option("compression", "none").parquet(path)


def read_ids(frames: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a table of frames: id, start, n_tokens and the CRC-32 of its ids."""
    key_type = frames.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    counts = frames.groupBy("shard", "frame").agg(F.sum("n_ids").alias("n_ids"))
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard, that is per written file: a running sum over them stays small at any size
    bases = shards.withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "base")
    inside = counts.withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_ids"))
    places = inside.join(bases, "shard").select("shard", "frame", (F.col("base") + F.col("before")).alias("first"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = unpack_frame(batch.column(1)[i].as_py())
                end = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(batch.column(2)[i].as_py() + end - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=schema.names)

    return frames.join(places, ["shard", "frame"]).select("doc_ids", "data", "first").mapInArrow(apply, schema)
