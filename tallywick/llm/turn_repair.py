"""Repair of conversation structure by depth-first branch and bound.

A conversation's rows get one code each: whether it must go (blank, or role and text seen earlier),
whether its text is cut off, and the initial of its role. The search looks for the cheapest edits that
leave role initials `(s?(ua)+)?`: Keep (0), Rerole to user or assistant (1), Delete (2) and Insert an
empty user or assistant turn (5), with 5 more for a cut-off row that stays. Ties take the edits whose
initials come first in ASCII. The initials name the result: a kept or inserted turn's place tells its
role.

The search is a node (rows passed, state of the pattern) at a time, on an explicit stack. Its parts:
a suffix lower bound from the relaxed pattern in which a system turn may stand alone; an incumbent (cost, audit), first from a dive along the least bounds; and a table of
the least cost with which each node was reached. Edits are tried in the order of their initials, so
prefixes arrive in the order of their audits, and one that reaches a node at no less cost than an
earlier one is worse in cost or audit, whatever follows. An empty stack proves the incumbent.

Rows are ordered and told apart by Spark; the search sees one byte a row, as long as the audit that it
returns. Conversations of equal codes are searched once per task. Texts stay rows: edits join back to
them, and the digest of a repaired conversation runs over its sorted rows.

Defined results: a null role, text or part of the damage key is one space; rows of one turn are in
order of role and text; a null turn comes first; rows of a null conversation are one conversation;
turns and texts of any length count whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.session import Scratch

RANGE = r"\x20\x09-\x0D"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Codes whose repair a task keeps before its table is emptied, and rows of edits that it emits at a time.
KNOWN, EDIT_ROWS = 50_000, 8_192
ROLES = {"u": "user", "a": "assistant"}

# states of the pattern: nothing yet, a system turn, a user turn, an assistant turn
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
WANTED = ("u", "u", "a", "u")
AFTER = (USER, USER, ASSISTANT, USER)
LAST = (NOTHING, ASSISTANT)


def lower_bounds(codes: str) -> list[tuple[int, int, int]]:
    """Per suffix: least costs with nothing yet, where a user and where an assistant turn comes next.

    Codes: x must go; u, a, s, o are the initials of complete rows, capitals of cut-off ones.
    """
    start, user, assistant = 0, 0, INSERT
    out = [(start, user, assistant)]
    for code in reversed(codes):
        extra, role = CUT_OFF if code.isupper() else 0, code.lower()
        if role == "x":
            start, user, assistant = start + DELETE, user + DELETE, assistant + DELETE
        else:
            keep_u, keep_a = (extra + (0 if role == r else REROLE) for r in "ua")
            start = min(DELETE + start, keep_u + assistant, *([extra + user] if role == "s" else []))
            user, assistant = min(DELETE + user, keep_u + assistant), min(DELETE + assistant, keep_a + user)
        user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
        start = min(start, INSERT + assistant)
        out.append((start, user, assistant))
    return out[::-1]


#: Which of the three bounds holds in which state.
_BOUND = (0, 1, 2, 1)


def _edits(codes: str, row: int, state: int, cost: int) -> list[tuple[str, int, int, int]]:
    """The edits at a node in the order of their initials: (initial, rows passed, state, cost)."""
    out = []
    code = codes[row] if row < len(codes) else ""
    role, extra = code.lower(), CUT_OFF if code.isupper() else 0
    if code:
        out.append(("D", row + 1, state, cost + DELETE))
    out.append(("I", row, AFTER[state], cost + INSERT))
    if code and role != "x":
        if role == WANTED[state]:
            out.append(("K", row + 1, AFTER[state], cost + extra))
        elif role == "s" and state == NOTHING:
            out.append(("K", row + 1, SYSTEM, cost + extra))
        if role != WANTED[state]:
            out.append(("R", row + 1, AFTER[state], cost + extra + REROLE))
    return out


def repair(codes: str) -> tuple[int, str]:
    """The least cost and, among the edits of that cost, the least audit."""
    bound = lower_bounds(codes)

    def dive() -> tuple[int, str]:
        row, state, cost, audit = 0, NOTHING, 0, []
        while row < len(codes) or state not in LAST:
            edit, row, state, cost = min(_edits(codes, row, state, cost), key=lambda e: (e[3] + bound[e[1]][_BOUND[e[2]]], e[0]))
            audit.append(edit)
        return cost, "".join(audit)

    best, audit = dive()
    proved = False  # whether the incumbent is the search's own, which precedes all that is still to come
    reached: dict[tuple[int, int], int] = {}
    path: list[str] = []
    stack = [(0, "", 0, NOTHING, 0)]
    while stack:
        depth, edit, row, state, cost = stack.pop()
        least = cost + bound[row][_BOUND[state]]
        if least > best or (proved and least == best):
            continue
        if reached.get((row, state), cost + 1) <= cost:
            continue
        reached[row, state] = cost
        del path[max(depth - 1, 0) :]
        if edit:
            path.append(edit)
        if row == len(codes) and state in LAST:
            found = "".join(path)
            if (cost, found) <= (best, audit):
                best, audit, proved = cost, found, True
            continue
        stack += [(depth + 1, *e) for e in reversed(_edits(codes, row, state, cost))]
    return best, audit


def row_edits(audit: str, codes: str) -> Iterator[tuple[int, str, str | None]]:
    """(row, initials of the turns before it, its new role's initial or none if it stays) of the audit.

    Deleted rows are left out; turns inserted at the end have the row number after the last one.
    """
    state, row, before = NOTHING, 0, ""
    for edit in audit:
        if edit == "I":
            before += WANTED[state]
            state = AFTER[state]
            continue
        if edit != "D":
            yield row, before, WANTED[state] if edit == "R" else None
            state, before = (SYSTEM if edit == "K" and codes[row].lower() != WANTED[state] else AFTER[state]), ""
        row += 1
    if before:
        yield row, before, None


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role, text after the damage; dropped ones stay, with `present` false."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), (F.col("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def coded(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text, present with `place`, `fault`, `code` and `illegal`."""
    order = [(~F.col("present")).asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "digest").orderBy("place")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(in_order), initial)
    rows = rows.withColumns({"place": F.row_number().over(in_order) - 1, "illegal": F.col("present") & ~F.coalesce(pair.isin("su", "ua", "au"), F.lit(True)), "digest": digest})
    last = F.regexp_extract("text", rf"([^{RANGE}])[{RANGE}]*\z", 1)
    fault = F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last.rlike("[.!?]"), "truncated")
    rows = rows.withColumn("fault", F.when(F.col("present"), fault))
    known = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return rows.withColumn("code", F.when(F.col("present"), code)).drop("digest")


def searched(groups: DataFrame) -> DataFrame:
    """Rows with `codes`, and the `cost` and `audit` of their repair."""

    def search(column: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[int, str]] = {}
        out = []
        for codes in column:
            if codes not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[codes] = repair(codes)
            out.append(known[codes])
        return pd.DataFrame(out, columns=["cost", "audit"])

    found = F.pandas_udf(search, "cost long, audit string")
    return groups.withColumn("found", found("codes")).select("*", "found.*").drop("found")


def edit_rows(found: DataFrame) -> DataFrame:
    """(conv, place, before, new_role) of every row that stays, from conv_id, codes and audit."""
    schema = "conv long, place int, before string, new_role string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, codes, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                edits = row_edits(audit, codes)
                while piece := list(islice(edits, EDIT_ROWS)):
                    place, before, role = zip(*piece, strict=True)
                    new_role = [ROLES.get(r) for r in role]
                    columns = [pa.array([conv] * len(piece), pa.int64()), pa.array(place, pa.int32()), pa.array(before), pa.array(new_role, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["conv", "place", "before", "new_role"])

    return found.select("conv_id", "codes", "audit").mapInArrow(apply, schema)


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the conversations that keep or gain a turn.

    A row's edit is sorted ahead of the row, so texts are dealt once and pass one at a time; a row
    without an edit was deleted, an edit without a row is of turns inserted at the end.
    """
    none = F.lit(None).cast("string")
    edits = edit_rows(found).select("conv", "place", F.lit(True).alias("edit"), "before", F.col("new_role").alias("role"), none.alias("text"))
    own = rows.select(F.col("conv_id").alias("conv"), "place", F.lit(False).alias("edit"), none.alias("before"), "role", "text")
    both = edits.unionByName(own).repartition("conv").sortWithinPartitions("conv", "place", F.col("edit").desc())
    schema = "conv long, repaired_sha256 string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edit, hasher, done = None, None, None, []

        def lines(role: str | None = None, text: str | None = None) -> None:
            nonlocal hasher, edit
            for line in [f"{ROLES[r]}:" for r in edit[1]] + ([] if role is None else [f"{edit[2] or role}:{text}"]):
                if hasher is None:
                    hasher = hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(line.encode("utf-8", "surrogatepass"))
            edit = None

        def close() -> None:
            nonlocal hasher
            if edit is not None:
                lines()
            if hasher is not None:
                done.append((now, hasher.hexdigest()))
            hasher = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["conv", "repaired_sha256"])

        for batch in batches:
            done = []
            for conv, place, is_edit, before, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    close()
                    now = conv
                if is_edit:
                    edit = (place, before, role)
                elif edit is not None and edit[0] == place:
                    lines(role, text)
            yield out()
        done = []
        close()
        yield out()

    return both.mapInArrow(apply, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal pairs, least cost, audit and the digest of the repair.

    `rows`: conv_id, turn, role, text, present; a conversation with no row present is empty.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    known = scratch.save(coded(rows), "coded")
    here = F.col("present")
    turn = F.when(here, F.col("turn"))
    counts = {k: F.coalesce(F.count_if(F.col("fault") == k), F.lit(0)).alias(k) for k in ("blank", "duplicate", "truncated")}
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("place", "code")))), lambda x: x["code"]), "")
    groups = known.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"),
        *counts.values(), F.count_if("illegal").alias("illegal"), codes.alias("codes"),
    )
    found = scratch.save(searched(groups), "searched")
    digests = repaired_digests(known.filter("present"), found)
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    return joined.select("conv_id", "gaps", *counts, "illegal", "cost", "audit", digest.alias("repaired_sha256"))
