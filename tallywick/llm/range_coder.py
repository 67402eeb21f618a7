"""Adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

Ids are first renamed to ranks: ids that a frame holds often, most frequent first, then all others in
their order. Every block is coded on its own: its contexts start empty, so any block decodes without
the others. For each rank three predictors speak: order-2 (the rank last confirmed after the same two),
order-1 (the same after one) and order-0 (class counts; ranks lie in classes of doubling width and are
uniform within a class). The mixture gives the order-2 and the order-1 rank a share each, by how often
their context has confirmed them, and the rest to order-0, whose counts start from the frame's and
follow the block's own. The interval of the mixture drives a range coder with 16-bit words and
carries; places within a class follow as plain bits. The blocks of one call advance together, one id
per step, so a step is some array operations over all blocks.

What the blocks of a frame share is its model: the frequent ids, the shares by confidence and the
starting counts. The range coder's numbers are whole and below 2^53, held as float64.

Payload of a block: count of range words (uint32, little-endian), range words and bit words (uint16).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: log2 of the slots of a block's order-1 and order-2 tables.
SLOT_BITS = 8
#: Steps between rebuilt order-0 tables; a frame's own counts weigh as much as PRIOR ids.
REBUILD, PRIOR = 256, 512
#: Ranks below 2^DIRECT are classes of their own; from there on each doubling has 2^SPLIT classes.
DIRECT, SPLIT, ID_BITS = 6, 2, 17
CLASSES = (1 << DIRECT) + (ID_BITS - DIRECT << SPLIT)
#: Sum of the order-0 frequencies; the mixture has 2^16, of which order-0 always keeps 2^12 or more.
WHOLE_BITS, MIX_BITS, MOST = 11, 16, (1 << 16) - (1 << 12)
MAX_ID = (1 << ID_BITS) - 1
#: Confirmations of a slot: 0 is an empty slot, and a filled one has 1 to TOP.
CONFIDENCE_BITS, TOP = 3, 7
#: An id is renamed where a frame holds it this often.
OFTEN = 4

WIDTH = np.array([0] * (1 << DIRECT) + [b - SPLIT for b in range(DIRECT, ID_BITS) for _ in range(1 << SPLIT)], np.int64)
BASE = np.concatenate([[0], np.cumsum(1 << WIDTH)[:-1]])
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.uint8), 1 << WIDTH)

_TWO16, _TWO32, _TWO48 = float(1 << 16), float(1 << 32), float(1 << 48)
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
_SHIFT = np.uint32(32 - SLOT_BITS)
#: Values that the contexts of a rank can say (see _predictions).
_SAID = 512
#: By confidence and hit: whether a slot keeps its rank (-1) or not (0), and how its confidence moves.
_KEPT = np.array([0, 0] + [-1] * (2 * TOP), np.int32)
_STEP = np.array([0, 0] + [-(c >> 1) for c in range(2, TOP + 1)] + [1] * TOP + [0], np.int32)
_SHARED = struct.Struct(f"<I{2 * (TOP + 1)}H{CLASSES}H")


@dataclass
class FrameModel:
    """What the blocks of a frame share: frequent ids, shares by confidence, starting class counts."""

    frequent: np.ndarray
    share_two: np.ndarray
    share_one: np.ndarray
    start: np.ndarray

    def by_rank(self) -> np.ndarray:
        """The id of every rank."""
        rare = np.ones(MAX_ID + 1, bool)
        rare[self.frequent] = False
        return np.concatenate([self.frequent, np.flatnonzero(rare)]).astype(np.uint32)

    def pack(self) -> bytes:
        wide = "<u4" if len(self.frequent) and int(self.frequent.max()) > 0xFFFF else "<u2"
        head = len(self.frequent) << 1 | (wide == "<u4")
        return _SHARED.pack(head, *self.share_two.tolist(), *self.share_one.tolist(), *self.start.tolist()) + self.frequent.astype(wide).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> FrameModel:
        head, *rest = _SHARED.unpack_from(data)
        rest, n = np.array(rest, np.int64), TOP + 1
        frequent = np.frombuffer(data, "<u4" if head & 1 else "<u2", head >> 1, _SHARED.size).astype(np.int64)
        return cls(frequent, rest[:n], rest[n : 2 * n], rest[2 * n :])


def frequent_ids(ids: np.ndarray) -> np.ndarray:
    """Ids of a frame that occur OFTEN or more, most frequent first."""
    counts = np.bincount(ids, minlength=1)
    held = np.flatnonzero(counts >= OFTEN)
    return held[np.argsort(-counts[held], kind="stable")]


class _Contexts:
    """The order-1 (row 0) and order-2 (row 1) tables of n blocks.

    A slot holds (rank + 1) << 3 | confidence.
    """

    def __init__(self, n: int):
        self.slots = np.zeros(2 * n << SLOT_BITS, np.int32)
        self.row = np.arange(2 * n, dtype=np.int64).reshape(2, n) << SLOT_BITS

    def look(self, at: np.ndarray) -> None:
        """Read the slots at these places: their ranks plus 1 and confidences."""
        self.at, self.e = at, self.slots.take(at, mode="clip")
        self.c, self.held = self.e & TOP, self.e >> CONFIDENCE_BITS

    def learn(self, coded: np.ndarray) -> np.ndarray:
        """Confirm, weaken or replace the slots read, by the coded ranks plus 1; returns confidence
        plus 8 for a hit."""
        hit = self.held == coded
        # the next slot by confidence and hit: a step up or down, or the coded rank at 1
        case = self.c + (hit << CONFIDENCE_BITS)
        fresh = coded << CONFIDENCE_BITS | 1
        self.slots[self.at] = fresh + ((self.e - fresh) & _KEPT.take(case)) + _STEP.take(case)
        return case


def _places(p1: np.ndarray, p2: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Slots of the contexts of the last rank and of the last two (stacked before the last axis)."""
    at = np.empty((*p1.shape[:-1], 2, p1.shape[-1]), np.uint32)
    one, two = at[..., 0, :], at[..., 1, :]
    np.multiply(p1.view(np.uint32), _A, out=one)
    np.multiply(p2.view(np.uint32), _B, out=two)
    two ^= one
    two *= _C
    at >>= _SHIFT
    return at + row


def _order_zero(counts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running class frequencies of every block, each at least 1 of 2^WHOLE_BITS."""
    weight = counts * start.sum() + start * PRIOR
    upto = np.cumsum(weight, axis=1)
    cum = np.zeros((len(counts), CLASSES + 1), np.int32)
    cum[:, 1:] = upto * ((1 << WHOLE_BITS) - CLASSES) // upto[:, -1:] + np.arange(1, CLASSES + 1)
    return cum


def _pack_bits(values: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Per row, the values' lowest `width` bits one after another, in 16-bit words."""
    n, used = len(values), np.flatnonzero(widths)
    words = (widths.sum(axis=1, dtype=np.int64) + 15 >> 4) + 1
    first = np.cumsum(words) - words
    # bits before each value: those of its row, after the words of the rows before
    width = widths.ravel()[used].astype(np.int32)
    end = np.cumsum(width, dtype=np.int64)
    rows = np.searchsorted(used, np.arange(n + 1) * widths.shape[1])
    ahead = np.concatenate([[0], end])[rows]
    start = end - width + np.repeat(first * 16 - ahead[:-1], np.diff(rows))
    whole = values.ravel()[used].astype(np.int64) << 32 - (start & 15) - width
    start >>= 4
    size = int(words.sum()) + 1
    out = np.bincount(start, weights=whole >> 16, minlength=size)
    out += np.bincount(start + 1, weights=whole & 0xFFFF, minlength=size)
    out = out.astype("<u2")
    return [out[first[k] : first[k] + words[k]].tobytes() for k in range(n)]


def _predictions(grid: np.ndarray) -> np.ndarray:
    """Of every rank, what its contexts said, as one number: order-2 confidence and hit, order-1
    confidence and hit (4 bits each), and whether both slots hold one rank."""
    block, n = grid.shape
    said = np.empty((block, n), np.int16)
    m, before = _Contexts(n), np.zeros((2, n), np.int32)
    for first in range(0, block, REBUILD):
        part = grid[first : first + REBUILD]
        known = np.concatenate([before, part])
        at = _places(known[1:-1], known[:-2], m.row)
        before, coded = known[-2:], part + 1
        cases, same = np.empty((len(part), 2, n), np.uint8), np.empty((len(part), n), bool)
        for k in range(len(part)):
            m.look(at[k])
            cases[k] = m.learn(coded[k])
            np.equal(m.held[0], m.held[1], out=same[k])
        said[first : first + REBUILD] = cases[:, 1] + (cases[:, 0].astype(np.int16) << 4) + (same.astype(np.int16) << 8)
    return said


def _share(seen: np.ndarray) -> np.ndarray:
    """Shares of 2^16 by confidence, from the counts of (confidence, hit)."""
    miss, hit = seen.reshape(2, TOP + 1)
    share = ((hit + 0.4) / (hit + miss + 1) * MOST).astype(np.int64)
    share[0] = 0  # empty slots
    return share


def encode_blocks(ids: np.ndarray, block: int) -> tuple[bytes, list[bytes]]:
    """The packed model and the payload of every block of `block` ids; a shorter last block is filled
    up with its last id."""
    if not len(ids):
        return b"", []
    if int(ids.max()) > MAX_ID or int(ids.min()) < 0:
        raise ValueError(f"ids must lie between 0 and {MAX_ID}")
    n = -(-len(ids) // block)
    block = min(block, len(ids))
    model = FrameModel(frequent_ids(ids), *(np.zeros(0, np.int64),) * 3)
    by_rank = model.by_rank()
    rank = np.empty(MAX_ID + 1, np.int32)
    rank[by_rank] = np.arange(MAX_ID + 1, dtype=np.int32)
    grid = np.full(n * block, rank[ids[-1]], np.int32)
    grid[: len(ids)] = rank[ids]
    grid = np.ascontiguousarray(grid.reshape(n, block).T)
    said = _predictions(grid)
    classes = CLASS_OF[grid]
    every = np.bincount(said.ravel(), minlength=_SAID)
    two, one, same = np.arange(_SAID) & 15, np.arange(_SAID) >> 4 & 15, np.arange(_SAID) >> 8
    open_ = (two <= TOP) & (same == 0)
    model.share_two = _share(np.bincount(two, every, 16))
    model.share_one = _share(np.bincount(one, every * open_, 16))
    rest_said = (two <= TOP) & ((one <= TOP) | (same == 1))
    by_rest = rest_said[said]
    start = np.bincount(classes.ravel(), weights=by_rest.ravel(), minlength=CLASSES)
    model.start = (start * 60_000 / max(start.max(), 1)).astype(np.int64) + 1
    s_two = model.share_two[two & TOP]
    edge = s_two + np.where(same, 0, (MOST - s_two) * model.share_one[one & TOP] >> MIX_BITS)
    # intervals of what order-2 or order-1 said, and how much is left for order-0
    low_said, size_said = np.where(two > TOP, 0, s_two).astype(float), np.where(two > TOP, s_two, edge - s_two).astype(float)
    edge, rest = edge.astype(np.int32), ((1 << MIX_BITS) - edge).astype(np.int32)
    packed = model.pack()

    out = np.zeros((n, block + 4), np.uint32)
    words, row = out.ravel(), np.arange(n) * (block + 4)
    at = row.copy()
    low, span, unit, more = np.zeros(n), np.full(n, _TWO48), np.empty(n), np.empty(n)
    lane = np.arange(n, dtype=np.int64)
    counts = np.zeros((n, CLASSES), np.int64)
    for first in range(0, block, REBUILD):
        part = slice(first, min(first + REBUILD, block))
        cum = _order_zero(counts, model.start).ravel()
        told = said[part].ravel()
        lo, size = low_said[told], size_said[told]
        free = np.flatnonzero(by_rest[part].ravel())
        told, c, on = told[free], classes[part].ravel()[free], free % n
        place = on * (CLASSES + 1) + c
        left, at_edge = rest[told], edge[told]
        begin = cum[place] * left >> WHOLE_BITS
        lo[free], size[free] = at_edge + begin, (cum[place + 1] * left >> WHOLE_BITS) - begin
        lo, size = lo.reshape(-1, n), size.reshape(-1, n)
        counts += np.bincount(on * CLASSES + c, minlength=n * CLASSES).reshape(n, CLASSES)
        for k in range(len(lo)):
            np.multiply(span, 1 / _TWO16, out=unit)
            np.floor(unit, out=unit)
            np.multiply(unit, lo[k], out=more)
            np.add(low, more, out=low)
            np.multiply(unit, size[k], out=span)
            over = np.flatnonzero(low >= _TWO48)
            if len(over):
                words[at[over] - 1] += 1
                low[over] -= _TWO48
            full = np.flatnonzero(span < _TWO32)
            if len(full):
                x = low[full]
                top = np.floor(x / _TWO32)
                spot = at[full]
                words[spot] = top
                at[full] = spot + 1
                low[full] = (x - top * _TWO32) * _TWO16
                span[full] *= _TWO16
    for k in (_TWO32, _TWO16, 1.0):
        top = np.floor(low / k)
        words[at] = top
        low -= top * k
        at += 1
    at -= row
    for j in range(int(at.max()) - 1, 0, -1):  # carries wait in the upper half of a word
        out[:, j - 1] += out[:, j] >> np.uint32(16)
    widths = WIDTH.astype(np.uint8)[classes] * by_rest
    bits = _pack_bits(np.ascontiguousarray((grid - BASE.astype(np.int32)[classes]).T), np.ascontiguousarray(widths.T))
    done = out.astype("<u2")
    return packed, [int(at[k]).to_bytes(4, "little") + done[k, : at[k]].tobytes() + bits[k] for k in range(n)]


def decode_blocks(packed: bytes, payloads: list[bytes], total: int, block: int) -> np.ndarray:
    """The `total` ids of the payloads that encode_blocks made with this model and block size."""
    if not payloads:
        return np.zeros(0, np.uint32)
    model = FrameModel.unpack(packed)
    n, block = len(payloads), min(block, total)
    size = max(map(len, payloads)) // 2 + 4
    stream, row = np.zeros(n * size, np.uint16), np.arange(n, dtype=np.int64) * size
    for k, p in enumerate(payloads):
        stream[row[k] : row[k] + (len(p) - 4) // 2] = np.frombuffer(p, "<u2", offset=4)
    at = row + 3
    bit = (row + np.array([int.from_bytes(p[:4], "little") for p in payloads])) * 16
    code = stream[row] * _TWO32 + stream[row + 1] * _TWO16 + stream[row + 2]
    # at every word, it and the next two as one number, from which the plain bits are cut
    pair = stream.astype(np.int64) << 16
    pair[:-1] |= stream[1:]
    last = len(stream) - 1
    span, lane = np.full(n, _TWO48), np.arange(n, dtype=np.int64)
    m, counts = _Contexts(n), np.zeros((n, CLASSES), np.int64)
    out, rest_of = np.empty((block, n), np.int32), np.empty((min(REBUILD, block), n), np.uint8)
    cum_row, slot_row = lane * CLASSES, (lane << WHOLE_BITS) - 1
    p1, p2 = np.zeros(n, np.int32), np.zeros(n, np.int32)
    # order-2 shares in the second row, as the contexts have them
    shares = np.concatenate([model.share_one, model.share_two]).astype(np.uint32)
    of_row = np.array([[0], [TOP + 1]], np.int32)
    spread = (BASE + 1 << 5 | WIDTH).astype(np.int32)
    mask_of, below = (1 << np.arange(32)) - 1, np.full(n, 32)
    for step in range(block):
        k = step % REBUILD
        if not k:
            if step:
                place = (lane * CLASSES + rest_of)[rest_of < CLASSES]
                counts += np.bincount(place, minlength=n * CLASSES).reshape(n, CLASSES)
            cum = _order_zero(counts, model.start)
            wide = np.diff(cum, axis=1)
            class_at = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), n), wide.ravel())
            ranges = (cum[:, :-1] << WHOLE_BITS + 1 | wide).ravel()
        m.look(_places(p1, p2, m.row))
        s_one, s_two = shares.take(m.c + of_row, mode="clip")
        held_one, held_two = m.held
        s_one *= held_one != held_two
        edge = (s_two + ((MOST - s_two) * s_one >> np.uint32(MIX_BITS))).view(np.int32)
        s_two = s_two.view(np.int32)
        rest = (1 << MIX_BITS) - edge
        unit = np.floor(span * (1 / _TWO16))
        value = (code / unit).astype(np.int32)
        two, one = -(value < s_two).astype(np.int32), -(value < edge).astype(np.int32)
        # the least x with x * rest >> WHOLE_BITS beyond the value lies in the class's upper part; where
        # order-1 or order-2 was right, any class will do
        x = (((value - edge + 1 << WHOLE_BITS) + (rest - 1)) / rest).astype(np.int32)
        c = class_at.take(x + slot_row, mode="clip")
        found = ranges.take(cum_row + c, mode="clip")
        lo = found >> WHOLE_BITS + 1
        hi = (lo + (found & (2 << WHOLE_BITS) - 1)) * rest >> WHOLE_BITS
        hi += edge
        lo = (lo * rest >> WHOLE_BITS) + edge
        # order-1 takes from s_two to edge, order-2 what lies before: chosen by masks of -1 and 0
        lo ^= (lo ^ s_two) & one
        hi ^= (hi ^ edge) & one
        lo &= ~two
        hi ^= (hi ^ s_two) & two
        code -= unit * lo
        span = unit * (hi - lo)
        short = np.flatnonzero(span < _TWO32)
        if len(short):
            ahead = at[short]
            code[short] = code[short] * _TWO16 + stream[np.minimum(ahead, last)]
            at[short] = ahead + 1
            span[short] *= _TWO16
        found = spread.take(c, mode="clip")
        width = found & 31 & ~one
        place = pair.take(bit >> 4, mode="clip") >> below - (bit & 15) - width & mask_of.take(width)
        bit += width
        i = (found >> 5) + place.astype(np.int32)
        i ^= (i ^ held_one) & one
        i ^= (i ^ held_two) & two
        np.bitwise_or(c, one & 255, out=rest_of[k], casting="unsafe")
        m.learn(i)
        p2, p1 = p1, i - 1
        out[step] = p1
    ranks = out.T.ravel()[:total]
    if len(ranks) and (int(ranks.min()) < 0 or int(ranks.max()) > MAX_ID):
        raise ValueError("a block holds no valid ids")
    return model.by_rank()[ranks]
