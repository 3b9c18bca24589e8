"""Uniform draws that depend on a seed and a row key only.

The draw is a digest, so it is the same whatever the partitioning, the attempt
or the executor, and the same in every SQL engine that has MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DRAW_BITS = 52  # a 52-bit integer is exact as a double


def _text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def draw(seed, *parts) -> Column:
    """Integer in [0, 2**52) for the key ``seed:part:part...``.

    Strings are literals; columns must be given as ``Column``.
    """
    digest = F.md5(F.concat_ws(":", _text(seed), *[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Double in [0, 1)."""
    return draw(seed, *parts) / F.lit(float(1 << DRAW_BITS))


def uniform_range(lo: float, hi: float, seed, *parts) -> Column:
    """Double in [lo, hi)."""
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * uniform(seed, *parts)


def uniform_int(lo: int, hi: int, seed, *parts) -> Column:
    """Integer in [lo, hi], both ends included."""
    return F.lit(lo) + F.floor(uniform(seed, *parts) * F.lit(float(hi - lo + 1))).cast("int")


ROUNDS = 12


def permutation_keys(n: Column, seed, *parts) -> Column:
    """The keys of a permutation of ``0 .. n - 1``, one for each round: see ``permuted``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.pmod(draw(seed, "key", *parts, r), n)
    )


def permuted(i: Column, n: Column, keys: Column, seed, *parts) -> Column:
    """The place of ``i`` in a drawn permutation of ``0 .. n - 1``.

    Each round pairs every place with another one, by its key, and swaps a pair or not by a
    digest of its greater place. So any ``k`` numbers give ``k`` distinct places, with no sort
    and no list of all places, and other ``parts`` give an independent permutation.
    """
    def swapped(x: Column, r: Column) -> Column:
        other = F.pmod(F.get(keys, r) - x, n)
        digest = F.md5(F.concat_ws(":", _text(seed), F.lit("swap"), *[_text(p) for p in parts], _text(r), _text(F.greatest(x, other))))
        return F.when(F.substring(digest, 1, 1) >= "8", other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i.cast("bigint"), swapped)
