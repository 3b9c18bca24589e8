"""Token arrays: split, truncate, pad, mask."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words, or single signs that are neither separators nor control characters.
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\p{Z}\p{Cc}]"
IGNORE_INDEX = -100  # fixed value: label positions a loss skips
PAD_MULTIPLE = 64  # fixed value: padded lengths are multiples of it


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ints(value: int, times) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), times.cast("int"))


def words(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(WORD_PATTERN), F.lit(0))


def truncate_tokens(tokens, n: int, side: str = "left") -> Column:
    """At most ``n`` tokens; ``left`` drops the beginning, ``right`` the end."""
    c = _col(tokens)
    start = F.greatest(F.size(c) - F.lit(n) + 1, F.lit(1)) if side == "left" else F.lit(1)
    return F.slice(c, start, F.lit(n))


def input_length(tokens) -> Column:
    return F.size(_col(tokens))


def padded_length(longest, multiple: int = PAD_MULTIPLE) -> Column:
    return (F.ceil(_col(longest) / F.lit(float(multiple))) * multiple).cast("int")


def pad(values, length, value: int, side: str = "left") -> Column:
    c = _col(values)
    fill = _ints(value, F.greatest(_col(length) - F.size(c), F.lit(0)))
    return F.concat(fill, c) if side == "left" else F.concat(c, fill)


def attention_mask(tokens, length, side: str = "left") -> Column:
    n = F.size(_col(tokens))
    real, fill = _ints(1, n), _ints(0, F.greatest(_col(length) - n, F.lit(0)))
    return F.concat(fill, real) if side == "left" else F.concat(real, fill)


def mask_labels(tokens, source_length) -> Column:
    """Labels of a source+target sequence with the source positions ignored."""
    limit = _col(source_length)
    return F.transform(
        _col(tokens), lambda x, i: F.when(i < limit, F.lit(IGNORE_INDEX)).otherwise(x)
    )


def mask_augment(tokens, p: float, pad_id: int, special_ids, seed, key) -> Column:
    """Replace each ordinary token by the pad id with probability ``p``.

    One digest of ``seed:key:block`` serves five positions, six hex digits each; the
    digits are compared as text, which orders them as numbers.
    """
    special = [int(s) for s in special_ids]
    limit = F.lit("g" if p >= 1 else f"{round(p * (1 << 24)):06x}")
    c = _col(tokens)
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(c) - 1, F.lit(0)) / 5).cast("int"))
    digests = F.transform(
        blocks,
        lambda b: F.md5(F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string"), b.cast("string"))),
    )

    def masked(d, x, i):
        digits = F.substring(F.get(d, F.floor(i / 5).cast("int")), (i % 5) * 6 + 1, F.lit(6))
        return F.when((~x.isin(special)) & (digits < limit), F.lit(pad_id)).otherwise(x)

    # The digests are one value per row: bind them once, not once per position.
    return F.flatten(
        F.transform(F.array(digests), lambda d: F.transform(c, lambda x, i: masked(d, x, i)))
    )
