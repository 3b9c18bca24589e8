"""A batch of texts as one flat array of bytes.

Python tasks see texts as Arrow batches. The helpers here cut a batch into pieces of
bounded bytes (a piece is at least one whole text, never part of one) and find words,
lines and rolling hashes for all texts of a piece at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 19  # bytes of text worked on at once; working arrays take 8 times as much each
U = np.uint64

# The white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept and grown when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, U(base), U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * PIECE:
            _powers[base] = have
    return have[:n]


def inverse(base: int = BASE) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Piece:
    """Texts ``first .. first + len(offsets) - 2`` of a batch."""

    first: int
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> memoryview:
        return memoryview(self.data)[self.offsets[i] : self.offsets[i + 1]]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position belongs to."""
        return np.searchsorted(self.offsets, at, side="right") - 1


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """Cut a string or binary column; a null is an empty text."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Piece(i, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a text's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cut[:n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[1:]] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    return runs(~SPACE[piece.data], piece.offsets)


def lines(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one line more than line feeds."""
    feeds = np.flatnonzero(piece.data == 10)
    starts = np.concatenate([piece.offsets[:-1], feeds + 1])
    owner = np.concatenate([np.arange(piece.n), piece.owner(feeds)])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.empty(len(starts), bool)
    last[-1] = True
    last[:-1] = owner[1:] != owner[:-1]
    ends[last] = piece.offsets[1:][owner[last]]
    return starts, ends, owner


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any span follows in constant time."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for the bytes of each span, its length included."""
    back = powers(len(sums), inverse())
    h = (sums[ends] - sums[starts]) * back[starts]
    return mix64(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` consecutive hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(n), U)
    for k in range(n):
        out = out * U(0x9FB21C651E98DF25) + hashes[k : k + m]
    return mix64(out)


def within(owner: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` consecutive items lie inside one text."""
    m = len(owner) - n + 1
    return owner[:m] == owner[n - 1 :] if m > 0 else np.zeros(0, bool)


def repeated(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice in their own text."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie inside at least one span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by text."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def row_key(id, text) -> int:
    """One signed 64-bit number for a row's id and the bytes of its text."""
    seed = xxhash.xxh3_64_intdigest(repr(id).encode())
    return xxhash.xxh3_64_intdigest(text, seed) - (1 << 63)
