"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys where a null equals a null, as in ``groupBy``; keys from the left."""
    on = list(on)
    theirs = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(theirs, same, how).drop(*[f"_right_{c}" for c in on])


def salted_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join a table with hot keys to one that has few rows per key.

    Rows of a key go to ``salts`` tasks by ``spread``, a column that varies inside
    the key; the other side is repeated once per salt. When the other side turns
    out small at run time it is broadcast and the salt plays no part.
    """
    on = list(on)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
