"""Quality rules by repetition coverage.

Each text's words are hashed once; hashes of word windows of several lengths roll over
them. A character counts as repeated when it lies in a word of a window, or in a line,
that occurs at least twice in the same text, however often windows overlap. Nothing
crosses texts, so the work is one pass without a shuffle.

Defined results: a null or empty text has no words, zero counts, and fails the base
rules; a row's result depends on its text alone, so repeated rows give equal rows; an
empty table gives an empty result; further columns pass through unless they carry the
name of a result column, which then holds the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textprov.llm import flat
from textprov.llm.arrow import lean

#: The largest share of characters inside repeated windows of n words.
LIMITS: Mapping[int, float] = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
SYMBOL_LIMIT = 0.10  # symbols by words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
WINDOW = 5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words",
)


def _measure(p: flat.Piece, lengths: list[int]) -> dict[str, np.ndarray]:
    n = p.n
    starts, ends = flat.words(p)
    owner = p.owner(starts)
    chars = np.zeros(len(p.data) + 1, np.int64)  # code points before each byte
    np.cumsum((p.data & 0xC0) != 0x80, out=chars[1:])
    word_chars = chars[ends] - chars[starts]
    sums = flat.prefix(p.data)
    h = flat.span_hashes(sums, starts, ends)
    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": flat.per_text(word_chars, owner, n),
    }
    symbols = np.flatnonzero(_SYMBOL[p.data])
    out["n_symbols"] = np.bincount(p.owner(symbols), minlength=n)

    ls, le, lo = flat.lines(p)
    first = np.searchsorted(starts, ls)  # a line has a word if the next word starts inside it
    has = np.zeros(len(ls), bool)
    ok = first < len(starts)
    has[ok] = starts[first[ok]] < le[ok]
    ls, le, lo = ls[has], le[has], lo[has]
    lh = flat.span_hashes(sums, ls, le)
    order = np.lexsort((ls, lh, lo))
    later = np.zeros(len(ls), bool)
    later[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (lo[order][1:] == lo[order][:-1])
    out["n_dup_lines"] = np.bincount(lo[later], minlength=n)
    out["dup_line_chars"] = flat.per_text(
        (chars[le] - chars[ls])[later], lo[later], n
    )

    for k in lengths:
        g = flat.grams(h, k)
        inside = flat.within(owner, k)
        at = np.flatnonzero(inside)
        at = at[flat.repeated(g[at], owner[at])]
        hit = flat.covered(at, at + k, len(h))
        if k == WINDOW:
            out["n_repeat_words"] = np.bincount(owner[hit], minlength=n)
        out[f"repeat_chars_{k}"] = flat.per_text(word_chars[hit], owner[hit], n)
    return out


def repetition(
    df: DataFrame, text: str = "text", lengths: tuple[int, ...] = tuple(LIMITS)
) -> DataFrame:
    """Add the counts of every text.

    ``n_words``, ``word_chars`` (code points inside words), ``n_symbols``,
    ``n_dup_lines`` and ``dup_line_chars`` (lines with a word that equal an earlier
    line), ``n_repeat_words`` (words in a 5-word window found twice or more, the first
    place included) and ``repeat_chars_<n>`` for each window length.
    """
    if WINDOW not in lengths:
        lengths = (WINDOW, *lengths)
    names = [*COUNTS, *[f"repeat_chars_{k}" for k in lengths]]
    kept = [c for c in df.columns if c not in names and c != text]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in names]
    )
    carried = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_measured_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for p in flat.pieces(texts):
                m = _measure(p, list(lengths))
                rest = b.slice(p.first, p.n).columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *[pa.array(m[c], pa.int64()) for c in names]], names=[*kept, *names]
                )

    return lean(carried).mapInArrow(run, schema)


def quality_rules(
    df: DataFrame,
    text: str = "text",
    limits: Mapping[int, float] = LIMITS,
    line_limit: float = LINE_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
) -> DataFrame:
    """``repetition`` with the verdicts ``base_failed`` and ``kept``.

    The base rules want ten words and at most a fifth of them in repeated 5-word
    windows. A text that meets them is kept unless more than ``limits[n]`` of its
    characters lie in repeated windows of n words, more than ``line_limit`` in lines
    seen before, or it has more than ``symbol_limit`` symbols a word.
    """
    counted = repetition(df, text, tuple(limits))
    base = (F.col("n_words") < 10) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words")
    )
    fine = (F.col("n_symbols") <= F.lit(symbol_limit) * F.col("n_words")) & (
        F.col("dup_line_chars") <= F.lit(line_limit) * F.col("word_chars")
    )
    for k, most in limits.items():
        fine = fine & (F.col(f"repeat_chars_{k}") <= F.lit(most) * F.col("word_chars"))
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine)
