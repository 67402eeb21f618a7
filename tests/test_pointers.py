"""Pointer trees by contraction, against a plain walk."""

import random

import pytest

from tallywick.operators import pointers
from tallywick.session import Scratch


def plain(rows):
    to = {(t, n): p for t, n, p in rows}
    out = {}
    for t, n in to:
        at, steps = n, 0
        while to[t, at] is not None:
            at, steps = to[t, at], steps + 1
        out[t, n] = (at, steps)
    return out


def shapes():
    rng = random.Random(1)
    rows = [("chain", i, i - 1 if i else None) for i in range(120)]
    rows += [("binary", i, (i - 1) // 2 if i else None) for i in range(200)]
    rows += [("star", i, 0 if i else None) for i in range(60)]
    rows += [("random", i, rng.randrange(i) if i and rng.random() > 0.03 else None) for i in range(150)]
    return rows + [("alone", 5, None)]


@pytest.mark.parametrize("most", [pointers.REMAINDER, 40, 0])
def test_ends_and_steps(spark, most):
    """All in one task, most by contraction, and all by contraction."""
    rows = shapes()
    df = spark.createDataFrame(rows, "tree string, node int, to int")
    got = pointers.ends_of(df, Scratch(spark, "test"), most).collect()
    assert len(got) == len(rows) and {(r.tree, r.node): (r.end, r.steps) for r in got} == plain(rows)


def test_no_nodes(spark):
    assert pointers.ends_of(spark.createDataFrame([], "tree string, node int, to int"), Scratch(spark, "test"), 0).collect() == []
