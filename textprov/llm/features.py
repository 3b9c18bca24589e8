"""A fixed number of measures of a text's form, whatever its language or length.

Bytes fall in a few classes; the shares of the pairs of neighbouring classes say how
letters, capitals, digits, spaces, line breaks, punctuation, symbols and non-ASCII
bytes follow one another. A few measures of words and lines are added. All are shares
or logarithms, so texts of any length compare.
"""

from __future__ import annotations

import numpy as np

from textprov.llm import flat

# The classes of bytes.
_CLASS = np.full(256, 7, np.int64)  # other ASCII
_CLASS[128:] = 5
_CLASS[[9, 32, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[list(b".,;:!?'\"()-")] = 6
_CLASS[list(b"!?")] = 8
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 0
CLASSES = 9
EXTRA = 8
WIDTH = CLASSES * CLASSES + EXTRA


def text_features(p: flat.Piece) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text; an empty one has its mark alone."""
    n = p.n
    out = np.zeros((n, WIDTH))
    size = np.diff(p.offsets)
    x = CLASSES * CLASSES
    out[:, x + 7] = size == 0
    if len(p.data) == 0:
        return out
    kind = _CLASS[p.data]
    owner = np.repeat(np.arange(n), size)
    pair = kind[:-1] * CLASSES + kind[1:]
    own = owner[:-1] == owner[1:]
    cells = np.bincount(
        owner[:-1][own] * (CLASSES * CLASSES) + pair[own], minlength=n * CLASSES * CLASSES
    ).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(cells / np.maximum(size - 1, 1)[:, None])

    starts, ends = flat.words(p)
    word_of = p.owner(starts)
    count = np.bincount(word_of, minlength=n)
    many = np.maximum(count, 1)
    h = flat.span_hashes(flat.prefix(p.data), starts, ends)
    order = np.lexsort((h, word_of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
    distinct = np.bincount(word_of[order][fresh], minlength=n)
    length = ends - starts
    windows = flat.grams(h, 5)
    at = np.flatnonzero(flat.within(word_of, 5))
    at = at[flat.repeated(windows[at], word_of[at])]
    again = flat.covered(at, at + 5, len(h))
    mean = np.bincount(word_of, weights=length, minlength=n) / many
    square = np.bincount(word_of, weights=length.astype(float) ** 2, minlength=n) / many
    out[:, x] = np.log1p(count)
    out[:, x + 1] = np.log1p(mean)
    out[:, x + 2] = np.sqrt(np.maximum(square - mean**2, 0)) / (1 + mean)
    out[:, x + 3] = distinct / many
    out[:, x + 4] = np.bincount(word_of[again], minlength=n) / many
    out[:, x + 5] = np.log1p(np.bincount(p.owner(np.flatnonzero(p.data == 10)), minlength=n)) / (
        1 + np.log1p(count)
    )
    out[:, x + 6] = np.minimum(count, 10) / 10
    return out
