"""Splits, samples, shuffles and random parameters, all keyed by a row id."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprov.functions.draws import draw, uniform, uniform_int, uniform_range
from textprov.operators.prefix import draw_cell, shuffled_positions

# Decoding parameters, drawn per example or constant.
SAMPLED_KNOBS = {
    "temperature": ("uniform", 0.5, 2.0),
    "top_k": ("int", 128, 256),
    "penalty_alpha": ("uniform", 0.0, 1.0),
    "guidance_scale": ("uniform", 1.0, 1.25),
    "eta_cutoff": ("uniform", 1e-4, 6e-4),
}
CONSTANT_KNOBS = {
    "temperature": ("const", 1.5),
    "top_k": ("const", 512),
    "penalty_alpha": ("const", 0.5),
    "guidance_scale": ("const", 1.1),
}


def hash_split(df: DataFrame, frac: float, seed, id: str = "id") -> DataFrame:
    """Add ``fold``: ``train`` with probability ``frac``, else ``valid``."""
    return df.withColumn(
        "fold",
        F.when(uniform(seed, F.col(id)) < F.lit(float(frac)), "train").otherwise("valid"),
    )


def sample_n(df: DataFrame, n: int, seed, id: str = "id") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) in random order, ``pos`` from 0.

    The ``n`` smallest draws are the sample. Counts per draw cell tell the last
    cell that is needed, so only about ``n`` rows are shuffled and none of them
    meets the others in a single task.
    """
    cell = draw_cell(df.sparkSession, draw(seed, F.col(id)))
    counts = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .where(F.col("before") < n)
        .agg(F.max("cell").alias("cell"))
    )
    near = df.where(cell <= needed.scalar())
    return shuffled_positions(near, id, seed).where(F.col("pos") < n)


def epoch_order(df: DataFrame, seed, epoch: int, id: str = "id") -> DataFrame:
    """Add ``pos``, the place of each row in the shuffled epoch."""
    return shuffled_positions(df, id, f"{seed}:{epoch}")


def draw_prompts(df: DataFrame, n: int, seed, id: str = "id") -> DataFrame:
    """``n`` draws with replacement over the rows: columns ``draw, id``.

    Every row is one entry, so prompts with more texts are drawn more often.
    """
    numbered = shuffled_positions(df.select(id), id, f"{seed}:order")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.floor(uniform(seed, "draw", F.col("id")) * total).cast("bigint").alias("pos"),
    )
    return draws.join(numbered, "pos").select("draw", id)


def knob(spec: tuple, seed, name: str, key: Column) -> Column:
    kind = spec[0]
    if kind == "const":
        return F.lit(spec[1])
    if kind == "int":
        return uniform_int(spec[1], spec[2], seed, name, key)
    return uniform_range(spec[1], spec[2], seed, name, key)


def record_id(seed, key: Column) -> Column:
    """``e_`` and 8 signs of a digest (hex digits, a subset of a-z0-9)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("record"), key.cast("string")))
    return F.concat(F.lit("e_"), F.substring(digest, 1, 8))


def sample_knobs(
    df: DataFrame, seed, key: str = "draw", spec: Mapping[str, tuple] = SAMPLED_KNOBS
) -> DataFrame:
    """Add ``record_id`` and one column per decoding parameter to each row."""
    k = F.col(key)
    return df.withColumns(
        {"record_id": record_id(seed, k), **{n: knob(s, seed, n, k) for n, s in spec.items()}}
    )
