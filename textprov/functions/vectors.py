"""Vector columns (arrays of float or double), computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-12  # fixed value: smallest divisor of a normalised vector


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c) -> Column:
    return _col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    c = _doubles(v)
    norm = F.greatest(l2_norm(c), F.lit(NORM_FLOOR))
    # The norm is one value per row: bind it once, not once per dimension.
    return F.flatten(
        F.transform(F.array(norm), lambda n: F.transform(c, lambda x: x / n))
    )


def sigmoid(logit) -> Column:
    x = _col(logit).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
