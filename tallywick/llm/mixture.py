"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights of the cells (one per combination of the categories) are raked until their marginals
meet the targets of every dimension. Targets are shares by category, given per dimension; what they
leave goes to the categories not named, by their own token shares to a power. Raking ends when no
cell's share still changes relative to itself by more than the tolerance, and `marginals` reports what is
left of the targets. A cell's ratio of raked to natural share then calibrates the sampling probability of its documents, min(1, c * ratio),
with c solved so that the expected tokens are the wanted share of all tokens. Documents are drawn by a
hash of their id, so the sample is reproducible and does not depend on partitioning.

All work on documents is one pre-aggregating groupBy and one join with the cells; raking runs on the
cells table as window sums per category. Defined results: a null category is the category "(none)";
null or empty texts count no tokens; a cell without tokens has the ratio 1; named categories that the
table lacks count nothing, and the shares of those it has are scaled down where they exceed 1; a
category whose target is 0 is not drawn; targets that no weights can meet end after `most` rounds; rows with equal ids are
kept or dropped together; rows with a null id are drawn as one id; other columns pass through; in
`mix` an input column named weight or probability is replaced, in `drawn` it stays; an empty table
gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywick.session import Scratch

OUTPUTS = ("weight", "probability")


def text_topic(text_col: str = "text") -> Column:
    """A topic from the form of the text: tables, symbol noise, or prose by its length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"[%$#&*]{3}"), "symbols")
        .when(F.length(text) < 1000, "short prose")
        .when(F.length(text) < 5000, "prose")
        .otherwise("long prose")
    )


def word_count(text_col: str = "text") -> Column:
    """Tokens of a text for the weights: runs between white space."""
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"[ \n\t\r]+"))).cast("long")


def _aimed(cells: DataFrame, dims: list[str], tempering: float, targets: dict[str, dict[str, float]]) -> DataFrame:
    """cells with all_tokens, the natural share as `raked`, and target_<dim> of every dimension."""
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    out = cells.crossJoin(F.broadcast(total)).withColumn("raked", F.col("tokens") / F.nullif("all_tokens", F.lit(0.0)))
    for d in dims:
        named = targets.get(d, {})
        given = F.lit(None).cast("double")
        for category, share in named.items():
            given = F.when(F.col(d) == category, F.lit(float(share))).otherwise(given)
        shares = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n")).withColumn("given", given)
        free = F.when(F.col("given").isNull(), F.pow("n", F.lit(tempering)))
        shares = shares.withColumn("free", free)
        sums = shares.agg(F.coalesce(F.sum("given"), F.lit(0.0)).alias("taken"), F.coalesce(F.sum("free"), F.lit(0.0)).alias("rest"))
        # without categories to take what is left, and beyond 1, the given shares are scaled
        scale = F.when((F.col("taken") > 1) | (F.col("rest") == 0), F.nullif("taken", F.lit(0.0))).otherwise(F.lit(1.0))
        left = F.greatest(1 - F.col("taken"), F.lit(0.0))
        target = F.coalesce(F.col("given") / scale, left * F.col("free") / F.nullif("rest", F.lit(0.0)))
        aims = shares.crossJoin(F.broadcast(sums)).select(F.col(d).alias(f"__{d}"), target.alias(f"target_{d}"))
        out = out.join(aims, F.col(d) == F.col(f"__{d}")).drop(f"__{d}")
    return out


def marginals(raked: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, category, target, reached and residual of raked cells."""
    parts = [raked.groupBy(F.col(d).alias("category")).agg(F.max(f"target_{d}").alias("target"), F.sum("raked").alias("reached")).select(F.lit(d).alias("dimension"), "category", "target", "reached") for d in dims]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.withColumn("residual", F.abs(F.col("reached") - F.col("target")))


def rake(cells: DataFrame, dims: list[str], tempering: float = 0.5, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 1e-11, most: int = 256) -> DataFrame:
    """cells (dims, tokens) with raked share, targets and `weight`: raked share over natural share.

    targets: shares by category of a dimension; categories without one get what is left by their token
    share to the power `tempering`: 1 keeps the natural mix, 0 makes them equal. Each round scales every
    dimension once; after every eight of them the largest relative change of a cell over the eight is
    measured, and the rounds end when it is within the tolerance. Targets that no weights meet never
    settle: after `most` rounds a warning tells the largest residual (see `marginals`).
    """
    scratch = Scratch(cells.sparkSession, "rake")
    out = scratch.save(_aimed(cells, dims, tempering, targets or {}), "aimed")
    for done in range(8, most + 8, 8):
        out = out.withColumn("was", F.col("raked"))
        for _ in range(8):
            for d in dims:
                of_category = F.sum("raked").over(Window.partitionBy(d))
                out = out.withColumn("raked", F.coalesce(F.col("raked") * F.col(f"target_{d}") / F.nullif(of_category, F.lit(0.0)), F.lit(0.0)))
        raked = scratch.save(out, "raked")
        out = raked.drop("was")
        change = F.abs(F.col("raked") - F.col("was")) / F.nullif("was", F.lit(0.0))
        if (raked.agg(F.max(change)).first()[0] or 0.0) <= tolerance:
            break
        if done >= most:
            residual = marginals(out, dims).agg(F.max("residual")).first()[0] or 0.0
            warnings.warn(f"weights still change after {done} rounds; largest residual of a target {residual:.3g}", stacklevel=2)
    ratio = F.coalesce(F.col("raked") * F.col("all_tokens") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("weight", ratio)


def calibrate(cells: DataFrame, keep_share: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = keep_share * sum(tokens), by Newton's steps.

    The sum is concave and increasing in c, so the steps rise to the solution and end once the set
    of capped cells stays; each is one aggregate over the cells.
    """
    c = 0.0
    for _ in range(100):
        capped = F.col("weight") * F.lit(c) >= 1
        row = cells.agg(F.sum("tokens").cast("double"), F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("tokens") * F.col("weight")))).first()
        tokens, full, slope = (x or 0.0 for x in row)
        new = (keep_share * tokens - full) / slope if slope > 0 else c
        if new <= c * (1 + 1e-15):
            return c
        c = new
    return c


def _free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def _draw(docs: DataFrame, dims: dict[str, Column], tokens: Column, id_col: str, keep_share: float, tempering: float, targets: dict[str, dict[str, float]] | None, seed: int) -> tuple[DataFrame, str, str]:
    scratch = Scratch(docs.sparkSession, "mixture")
    named = {_free(docs, f"__{d}"): F.coalesce(c.cast("string"), F.lit("(none)")) for d, c in dims.items()}
    weight, chance = _free(docs, "__weight"), _free(docs, "__chance")
    keyed = docs.withColumns(named)
    counted = docs.select(*(c.alias(n) for n, c in named.items()), tokens.alias("tokens"))
    cells = scratch.save(counted.groupBy(*named).agg(F.sum("tokens").alias("tokens")), "cells")
    aims = {n: (targets or {}).get(d, {}) for n, d in zip(named, dims, strict=True)}
    raked = rake(cells, list(named), tempering, aims)
    chances = raked.select(*named, F.col("weight").alias(weight), F.least(F.lit(1.0), F.col("weight") * F.lit(calibrate(raked, keep_share))).alias(chance))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return keyed.join(chances, list(named)).filter(draw < F.col(chance)), weight, chance


def mix(docs: DataFrame, dims: dict[str, Column], tokens: Column, id_col: str = "doc_id", keep_share: float = 0.8, tempering: float = 0.5, targets: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """The drawn rows of docs, with weight and probability; dims names a column for each dimension, and
    targets gives shares by category of some of them."""
    rows, weight, chance = _draw(docs, dims, tokens, id_col, keep_share, tempering, targets, seed)
    return rows.select(*(c for c in docs.columns if c not in OUTPUTS), F.col(weight).alias("weight"), F.col(chance).alias("probability"))


def drawn(docs: DataFrame, dims: dict[str, Column], tokens: Column, id_col: str = "doc_id", keep_share: float = 0.8, tempering: float = 0.5, targets: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """The drawn rows of docs as they are."""
    return _draw(docs, dims, tokens, id_col, keep_share, tempering, targets, seed)[0].select(docs.columns)
