"""SimHash near-duplicates by a self join of binary tries.

A document's fingerprint is the majority, bit by bit, of the 64-bit hashes of its word shingles.
Different fingerprints are the leaves of a binary trie. The join starts from pairs of its nodes and
goes down both nodes of a pair at once: equal bits keep the number of differing bits, unequal bits
add one, and a pair whose number exceeds the budget is dropped with all that lies below it.

Two fingerprints that differ in at most three bits agree in one of their four blocks of 16 bits. So
there are four tries, each with another block on top, whose budget is zero for those 16 bits: only
nodes paired with themselves are left at that depth, and they are dealt to the tasks. A node with more
than `most` leaves is cut eight bits deeper into pairs of its subtries whose prefixes are within the
budget, again and again, so no task meets more than a bounded part of a hot node. Within a task all
nodes go down together, level by level in arrays, with a bounded number of pairs at a time.

A task emits for each fingerprint at most one link, to the least one that it reaches there; whole
components come from joins over those links. Copies of a text are one leaf.

Defined results: null and empty texts have no words, fingerprint zero, and link like any other; texts
with fewer words than a shingle are one shingle; rows of one id are documents of their own, as are
repeated rows, and all are returned; a null id is returned and never names a component, which is null
only where all its ids are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywick.llm.components import connected_components
from tallywick.llm.textcore import slices
from tallywick.session import Scratch

SHINGLE_WORDS, SEED, BUDGET = 3, 42, 3
BITS, BLOCK, STEP = 64, 16, 8
#: Leaves of a node above which it is cut deeper, and those that a task holds at a time besides.
MOST_LEAVES, TASK_LEAVES = 1_000_000, 250_000
#: Node pairs that go down together.
MOST_PAIRS = 1_000_000
#: Hashes whose bits are counted at a time.
COUNTED = 65_536

NODE = ("turn", "depth", "a", "b")


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(SHINGLE_WORDS, len(words))
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), COUNTED):
        part = h[i : i + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): every row's fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            whole = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"") for t in whole], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(apply, "id long, fp long")


def _turned(turn: int) -> Column:
    """The fingerprint with block `turn` on top, then the blocks before it, then those after it."""
    order = [turn, *range(turn), *range(turn + 1, BITS // BLOCK)]
    out = F.lit(0).cast("long")
    for place, block in enumerate(order):
        bits = F.shiftrightunsigned("fp", BITS - BLOCK * (block + 1)).bitwiseAND(F.lit((1 << BLOCK) - 1))
        out = out.bitwiseOR(F.shiftleft(bits, BITS - BLOCK * (place + 1)))
    return out


def nodes(leaves: DataFrame) -> DataFrame:
    """Every leaf below its node of each of the four tries, paired with itself: NODE, side, bits, fp."""
    each = F.array(*(F.struct(F.lit(t).alias("turn"), _turned(t).alias("bits")) for t in range(BITS // BLOCK)))
    top = F.shiftrightunsigned("x.bits", BITS - BLOCK)
    rows = leaves.select("fp", F.explode(each).alias("x"))
    return rows.select("x.turn", F.lit(BLOCK).alias("depth"), top.alias("a"), top.alias("b"), F.lit(0).alias("side"), "x.bits", "fp")


def deeper(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The same leaves below the pairs of subtries, STEP bits down, that are within the budget."""
    own = F.call_function("shiftrightunsigned", F.col("bits"), BITS - STEP - F.col("depth")).bitwiseAND(F.lit((1 << STEP) - 1))
    left = F.lit(budget) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << STEP) - 1).cast("long")), lambda q: F.bit_count(q.bitwiseXOR(F.col("own"))) <= F.col("left"))
    rows = rows.withColumns({"own": own, "left": left}).withColumn("q", F.explode(near))
    # a node paired with itself keeps each pair of its subtries once, the lesser prefix first
    first = F.when(F.col("a") == F.col("b"), F.col("own") <= F.col("q")).otherwise(F.col("side") == 0)
    mine = F.shiftleft(F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")), STEP).bitwiseOR(F.col("own"))
    other = F.shiftleft(F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")), STEP).bitwiseOR(F.col("q"))
    return rows.select("turn", (F.col("depth") + STEP).alias("depth"), F.when(first, mine).otherwise(other).alias("a"), F.when(first, other).otherwise(mine).alias("b"), F.when(first, 0).otherwise(1).alias("side"), "bits", "fp")


def bounded_nodes(leaves: DataFrame, scratch: Scratch, most: int = MOST_LEAVES, budget: int = BUDGET) -> DataFrame:
    """The node pairs of all tries, none with more than `most` leaves."""
    rows, done = nodes(leaves), []
    while True:
        large = scratch.save(rows.groupBy(*NODE).count().filter(F.col("count") > most).select(*NODE), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, [*NODE], "left_anti").select(rows.columns))
        rows = scratch.save(deeper(rows.join(large, [*NODE], "left_semi").select(rows.columns), budget), "deeper")
    for part in done:
        rows = rows.unionByName(part)
    return rows


class _Forest:
    """Leaves of some node pairs, in order of pair, side and bits, and the components found so far."""

    def __init__(self, turn: np.ndarray, bits: np.ndarray, budget: int):
        self.turn, self.bits, self.budget = turn, bits, budget
        self.label = np.arange(len(bits))
        self._ones: dict[int, np.ndarray] = {}

    def ones(self, depth: int) -> np.ndarray:
        """Running number of leaves whose bit at this depth is set."""
        if depth not in self._ones:
            bit = (self.bits >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        return self._ones[depth]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        self.label = label

    def traverse(self, depth: int, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, errors: np.ndarray) -> None:
        """Go down from node pairs of one depth, given as ranges of leaves with their differing bits."""
        stack = [(depth, al, ah, bl, bh, errors)]
        while stack:
            depth, *pairs = stack.pop()
            if len(pairs[0]) > MOST_PAIRS:
                half = len(pairs[0]) // 2
                stack += [(depth, *(x[half:] for x in pairs)), (depth, *(x[:half] for x in pairs))]
                continue
            below = self._down(depth, *pairs)
            if len(below[0]) and depth + 1 < BITS:
                stack.append((depth + 1, *below))

    def _down(self, depth: int, al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray, errors: np.ndarray) -> list[np.ndarray]:
        ones, same = self.ones(depth), (al == bl) & (ah == bh)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        across = ~same
        children = [
            np.concatenate(x)
            for x in zip(
                (al, am, bl, bm, errors), (am, ah, bm, bh, errors), (al, am, bm, bh, errors + 1), (am[across], ah[across], bl[across], bm[across], errors[across] + 1),
                strict=True,
            )
        ]
        al, ah, bl, bh, errors = children
        kept = (al < ah) & (bl < bh) & (errors <= self.budget) & ~((al == bl) & (ah - al == 1))
        # the blocks below the one on top that an earlier trie has on top must differ, or it finds the pair
        blocks = (depth + 1) // BLOCK - 1
        if blocks > 0 and (depth + 1) % BLOCK == 0:
            kept &= errors >= np.minimum(self.turn[np.minimum(al, len(self.turn) - 1)], blocks)
        al, ah, bl, bh, errors = (x[kept] for x in (al, ah, bl, bh, errors))
        ends = (ah - al == 1) & (bh - bl == 1)
        if ends.any():
            i, j = al[ends], bl[ends]
            near = np.bitwise_count(self.bits[i] ^ self.bits[j]) <= self.budget
            self.link(i[near], j[near])
            al, ah, bl, bh, errors = (x[~ends] for x in (al, ah, bl, bh, errors))
        return [al, ah, bl, bh, errors]


def trie_links(turn: np.ndarray, depth: np.ndarray, a: np.ndarray, b: np.ndarray, side: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For every leaf the place of the leaf that names its component among these node pairs.

    Leaves come in order of node pair, side and bits, the bits unsigned.
    """
    n = len(bits)
    if not n:
        return np.zeros(0, np.int64)
    forest = _Forest(turn, bits, budget)
    new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    seconds = np.concatenate([[0], np.cumsum(side, dtype=np.int64)])
    mid = hi - (seconds[hi] - seconds[lo])
    same = a[lo] == b[lo]
    errors = np.bitwise_count(a[lo] ^ b[lo]).astype(np.int64)
    ah, bl = np.where(same, hi, mid), np.where(same, lo, mid)
    some = (hi - lo > 1) & (ah > lo) & (hi > bl)
    for d in np.unique(depth[lo][some]):
        at = some & (depth[lo] == d)
        pairs = (lo[at], ah[at], bl[at], hi[at], errors[at])
        if d < BITS:
            forest.traverse(int(d), *pairs)
        else:
            forest.link(pairs[0], pairs[2])
    return forest.label


def local_links(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): at most one link per leaf and task round, to the leaf that names its component there."""

    def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of whole node pairs, some TASK_LEAVES leaves at a time."""
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
            if count >= TASK_LEAVES:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = np.ones(count, bool)
                for c in cols[:4]:
                    last &= c == c[-1]
                cut = int(count - last.sum())
                if cut:
                    yield [c[:cut] for c in cols]
                held, count = [[c[cut:] for c in cols]], count - cut
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, depth, a, b, side, bits, fp in whole_nodes(batches):
            label = trie_links(turn, depth, a, b, side, bits.view(np.uint64), budget)
            linked = fp != fp[label] if len(fp) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label][linked])], names=["a", "b"])

    # signed order of bits is unsigned order within a side: its leaves share the topmost bit
    return rows.repartition(*NODE).sortWithinPartitions(*NODE, "side", "bits").mapInArrow(apply, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, most: int = MOST_LEAVES) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row; budgets up to three bits."""
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError(f"a budget of 0 to {BITS // BLOCK - 1} bits leaves one of {BITS // BLOCK} blocks equal")
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.save(fingerprints(docs, id_col, text_col), "fingerprints")
    leaves = scratch.save(found.groupBy("fp").agg(F.min("id").alias("first")), "leaves")
    links = scratch.save(local_links(bounded_nodes(leaves.select("fp"), scratch, most, budget), budget), "links")
    labels = connected_components(links, scratch).withColumnRenamed("node", "fp")
    named = leaves.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    members = named.join(ids, "label").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0")
    return found.join(members, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
