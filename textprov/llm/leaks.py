"""Benchmark passages in a corpus, edited ones included, by the q-gram lemma.

Benchmark items are cut into overlapping windows, so that a part of an item is found
too: windows of ``WINDOW`` bytes, every half of that, and windows of ``SHORT`` bytes, every
``STEP``, so that any excerpt of ``SHORT + STEP - 1`` bytes holds a whole one. If a stretch of a text equals a window of n bytes but for at most k edits, the two
share at least ``n - q + 1 - k*q`` q-grams whose positions differ by nearly the same
offset: all of them lie in one band of offsets (diagonals) k wide on either side. So for
every text the q-grams shared with the windows are counted by (window, band), bands
overlapping such that any run of 2k + 1 diagonals lies whole in one; bands with too few
are dropped, and what is left is verified by an alignment that allows k edits and is
computed only inside the band.

Texts and items are compared as bytes with ASCII letters in lower case and every run of
other ASCII characters than letters and digits as one blank.

Texts are read once and nothing is shuffled; only hits leave the tasks. The benchmark's
windows go to every task in blocks of ``BLOCK`` bytes of items, so the size sent at once
is bounded; a larger benchmark means more passes over the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textprov.llm import flat
from textprov.llm.arrow import lean
from textprov.llm.flat import BASE, U

Q = 10
WINDOW = 96  # bytes of an item that are looked for as one
SHORT = 64  # bytes of the windows that find shorter excerpts
STEP = 16  # bytes from one of those to the next
EDITS = 0.07  # edits allowed, as a share of a window's bytes
SHORTEST = 48  # bytes below which an item is looked for without edits
BLOCK = 1 << 20  # bytes of items whose index goes to the tasks, about 150 times as much
KNOWN = 1 << 12  # alignments that are remembered
PAIRS = 1 << 20  # places of a text times places of windows that are looked at together
SPREAD = 0x9E3779B97F4A7C15

HIT = "start long, end long, edits int"

# What counts as one kind of byte.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def plain(p: flat.Piece) -> tuple[flat.Piece, np.ndarray]:
    """Texts as compared, each with a blank at either end, and where each byte was."""
    size = np.diff(p.offsets)
    to = p.offsets[:-1] + 2 * np.arange(p.n) + 1  # room for a blank on both sides
    total = len(p.data) + 2 * p.n
    data = np.full(total, 32, np.uint8)
    at = np.zeros(total, np.int64)
    shift = np.repeat(to - p.offsets[:-1], size)
    place = np.arange(len(p.data)) + shift
    data[place] = _PLAIN[p.data]
    at[place] = np.arange(len(p.data)) - np.repeat(p.offsets[:-1], size)
    at[to - 1], at[to + size] = 0, np.maximum(size - 1, 0)
    offsets = np.r_[to - 1, total]
    keep = np.ones(total, bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1]] = True
    moved = np.r_[0, np.cumsum(keep)]
    return flat.Piece(p.first, data[keep], moved[offsets]), at[keep]


def _grams(data: np.ndarray) -> np.ndarray:
    """A number for every q bytes."""
    m = len(data) - Q + 1
    if m <= 0:
        return np.zeros(0, U)
    whole = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(U)[:, 0]
    return (whole[:m] ^ (whole[Q - 8 : Q - 8 + m] * U(BASE))) * U(SPREAD)


@dataclass
class Windows:
    """Windows of benchmark items, and where each of their q-grams stands."""

    items: np.ndarray  # item of each window
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray  # q-grams that a hit shares
    grams: np.ndarray  # sorted
    window: np.ndarray
    place: np.ndarray
    short: np.ndarray  # which windows are of SHORT bytes
    marks: np.ndarray  # bitmap of the grams, to pass over most bytes of a corpus quickly
    by_window: np.ndarray  # entries of the index by window,
    first: np.ndarray  # and where each window's begin

    @staticmethod
    def of(items: list[tuple[int, str]], window: int, share: float) -> Windows | None:
        owner, texts, edits, short = [], [], [], []
        for item, text in items:
            piece, _ = plain(next(flat.pieces(pa.array([text], pa.string()))))
            data = piece.data.tobytes()
            if not data.strip():
                continue
            if len(data) <= window:
                cuts = [0]
            else:
                cuts = [*range(0, len(data) - window, window // 2), len(data) - window]
            cuts = [(c, window) for c in cuts]
            if SHORT < min(window, len(data)):
                at = [*range(0, len(data) - SHORT, STEP), len(data) - SHORT]
                cuts += [(c, SHORT) for c in at]
            for c, size in cuts:
                part = data[c : c + size]
                if len(part) < Q:
                    continue
                k = int(share * len(part)) if len(part) >= SHORTEST else 0
                owner.append(item)
                texts.append(part)
                edits.append(k)
                short.append(size < window)
        if not texts:
            return None
        edits_ = np.array(edits)
        size = np.array([len(t) for t in texts])
        grams = [_grams(np.frombuffer(t, np.uint8)) for t in texts]
        where = np.concatenate([np.full(len(g), i) for i, g in enumerate(grams)])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        marks = np.zeros(1 << 22, bool)
        marks[_mark(every)] = True
        return Windows(
            np.array(owner), texts, edits_, size - Q + 1 - Q * edits_,
            every[order], where[order], place[order], np.array(short), marks,
            np.argsort(where[order], kind="stable"), np.r_[0, np.cumsum([len(g) for g in grams])],
        )


def _mark(grams: np.ndarray) -> np.ndarray:
    return (grams >> U(42)).astype(np.int64)


def _align(pattern: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """Best place of ``pattern`` in ``text`` with at most ``k`` edits: start, end, edits.

    ``text`` is the stretch that the band allows: the pattern's first byte lies on one
    of its first 2k + 1 bytes or so. Row by row, only cells whose diagonal lies in the
    band are computed, for all diagonals of a row at once.
    """
    n, width = len(pattern), len(text) - len(pattern) + 1
    width = max(width, 1) + 2 * k
    a = np.frombuffer(pattern, np.uint8)
    b = np.full(n + 2 * width + 2 * k, 0, np.uint8)
    b[k : k + len(text)] = np.frombuffer(text, np.uint8)
    valid = np.zeros(len(b) + 1, bool)
    valid[k : k + len(text) + 1] = True
    far = n + 1
    # cost[j]: edits to bring pattern[:i] to the text that ends at i + j - k.
    j = np.arange(width)
    cost = np.where(valid[j], 0, far)
    start = j.copy()
    for i in range(1, n + 1):
        sub = cost + (b[i - 1 + j] != a[i - 1])
        drop = np.r_[cost[1:], far] + 1  # a byte of the pattern is missing in the text
        came = np.r_[start[1:], 0]
        best = np.where(drop < sub, drop, sub)
        from_ = np.where(drop < sub, came, start)
        best = np.where(valid[i + j], best, far)
        # Further bytes of the text: the least of best[j'] + (j - j') over j' <= j.
        slope = best - j
        low = np.minimum.accumulate(slope)
        origin = np.maximum.accumulate(np.where(slope == low, j, 0))
        cost = np.minimum(low + j, far)
        start = from_[origin]
        if cost.min() > k:
            return None
    at = int(np.argmin(cost))
    if cost[at] > k:
        return None
    return int(start[at]) - k, n + at - k, int(cost[at])


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lo[i] .. lo[i] + n[i] - 1`` for every i, one after the other."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _hits(p: flat.Piece, w: Windows) -> Iterator[tuple[int, int, int, int, int]]:
    """Text, window, start, end (bytes of the text) and edits of every hit in a piece.

    A window is looked at in a text only if enough of its q-grams stand anywhere in it,
    each q-gram of the text counted once. Then places are multiplied by the window's, in
    slices of at most about ``PAIRS``, so a text that repeats itself takes no more memory.
    """
    clean, at = plain(p)
    grams = _grams(clean.data)
    if not len(grams):
        return
    seen = np.flatnonzero(w.marks[_mark(grams)])
    owner = clean.owner(seen)
    seen = seen[seen + Q <= clean.offsets[owner + 1]]
    lo = np.searchsorted(w.grams, grams[seen], "left")
    n = np.searchsorted(w.grams, grams[seen], "right") - lo
    seen, lo, n = seen[n > 0], lo[n > 0], n[n > 0]
    if not len(seen):
        return
    owner = clean.owner(seen)
    order = np.lexsort((lo, owner))
    own, low = owner[order], lo[order]
    once = order[np.r_[True, (own[1:] != own[:-1]) | (low[1:] != low[:-1])]]
    cell = np.repeat(owner[once], n[once]) * len(w.texts) + w.window[_ranges(lo[once], n[once])]
    cell, shared = np.unique(cell, return_counts=True)
    cell = cell[shared >= np.maximum(w.least[cell % len(w.texts)], 1)]
    known: dict = {}
    for own in np.unique(cell // len(w.texts)):
        windows = cell[cell // len(w.texts) == own] % len(w.texts)
        entry = np.sort(w.by_window[_ranges(w.first[windows], w.first[windows + 1] - w.first[windows])])
        places = seen[np.searchsorted(owner, own) : np.searchsorted(owner, own, "right")]
        for some, low, high in _slices(places, grams, w, entry, windows):
            yield from _banded(int(own), clean, at, grams, places, w, some, low, high, known)


def _slices(places, grams, w: Windows, entry: np.ndarray, windows: np.ndarray):
    """Entries of the index and a range of bands whose pairs are few enough at once."""
    keys = w.grams[entry]
    pairs = np.searchsorted(keys, grams[places], "right") - np.searchsorted(keys, grams[places], "left")
    if pairs.sum() <= PAIRS or not len(places):
        yield entry, None, None
        return
    for win in windows:
        own = entry[w.window[entry] == win]
        step = 2 * int(w.edits[win]) + 1
        first, last = int(places[0]) - len(w.texts[win]), int(places[-1])
        bands = max(1, PAIRS // len(own) // step)
        for low in range(first // step - 1, last // step + 1, bands):
            yield own, low, low + bands


def _banded(own: int, clean: flat.Piece, at, grams, places, w: Windows, entry, low, high, known: dict):
    """Hits of one text among the bands ``low`` to ``high - 1``, or all bands."""
    if low is not None:
        win = int(w.window[entry[0]])
        step = 2 * int(w.edits[win]) + 1
        upto = (high + 1) * step + len(w.texts[win])
        places = places[np.searchsorted(places, low * step) : np.searchsorted(places, upto)]
    keys = w.grams[entry]
    lo = np.searchsorted(keys, grams[places], "left")
    n = np.searchsorted(keys, grams[places], "right") - lo
    met = entry[_ranges(lo, n)]
    if not len(met):
        return
    pos, window, place = np.repeat(places, n), w.window[met], w.place[met]
    # Bands of 4k + 2 diagonals, one every 2k + 1: 2k + 1 diagonals lie whole in one.
    step = 2 * w.edits[window] + 1
    band = (pos - place) // step
    # One number for window, band and place; a q-gram of the window counts once in a band.
    base = int(band.min()) - 1
    span, width = int(band.max()) - base + 1, int(place.max()) + 1
    code = (window * span + band - base) * width + place
    code = np.unique(np.concatenate([code, code - width]))
    head, shared = np.unique(code // width, return_counts=True)
    heads = np.c_[head // span, head % span + base]
    enough = shared >= np.maximum(w.least[heads[:, 0]], 1)
    if low is not None:
        enough &= (heads[:, 1] >= low) & (heads[:, 1] < high)
    for g in np.flatnonzero(enough):
        win, b = heads[g]
        k = int(w.edits[win])
        wide = 2 * k + 1
        text = w.texts[win]
        left = max(int(b) * wide - k, int(clean.offsets[own]))
        right = min((int(b) + 2) * wide + k + len(text), int(clean.offsets[own + 1]))
        stretch = clean.data[left:right].tobytes()
        exact = stretch.find(text)
        if exact >= 0:
            found = exact, exact + len(text), 0
        elif not k:
            found = None
        else:  # a text that repeats itself has the same stretch again and again
            if len(known) >= KNOWN:
                known.clear()
            if (win, stretch) not in known:
                known[win, stretch] = _align(text, stretch, k)
            found = known[win, stretch]
        if found:
            s, e, cost = found
            s, e = max(left + s, left), min(left + e, right)
            s, e = s + (clean.data[s] == 32), e - (clean.data[e - 1] == 32)
            yield own, int(win), int(at[s]), int(at[max(e - 1, s)]) + 1, cost


def _merged(hits, w: Windows) -> list[tuple[int, int, int, int, int]]:
    """Text, item, start, end and edits: hits of short windows as one where they meet.

    Those inside a hit of a long window of the same item are left out.
    """
    out, parts, spans = [], {}, {}
    for own, win, s, e, cost in dict.fromkeys(hits):
        key = own, int(w.items[win])
        if w.short[win]:
            parts.setdefault(key, []).append((s, e, cost))
        else:
            spans.setdefault(key, []).append((s, e))
            out.append((*key, s, e, cost))
    for key, own in parts.items():
        long = np.array(sorted(spans.get(key, [])), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(long[:, 1])
        last = None
        for s, e, cost in sorted(own):
            k = int(np.searchsorted(long[:, 0], s, "right")) - 1
            if k >= 0 and reach[k] >= e:
                continue
            if last and s <= last[1]:
                last[1], last[2] = max(last[1], e), max(last[2], cost)
                continue
            if last:
                out.append((*key, *last))
            last = [s, e, cost]
        if last:
            out.append((*key, *last))
    return out


def _blocks(benchmark: DataFrame, id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded bytes, one block on the driver at a time."""
    items = benchmark.select(F.col(id).alias("id"), F.col(text).alias("text")).where(
        "text is not null"
    )
    held, size = [], 0
    for r in items.orderBy("id", "text").toLocalIterator():
        held.append((r["id"], r["text"]))
        size += len(r["text"].encode())
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    edits: float = EDITS,
) -> DataFrame:
    """``id, item_id, start, end, edits``: each window of an item found in a text.

    ``start`` and ``end`` are bytes of the text; ``edits`` is the distance of the two,
    or the greatest where short windows that meet are one hit.
    Items shorter than ``SHORTEST`` bytes are found only without edits, and items of
    less than ``Q`` bytes are not looked for.

    Defined results: null and empty texts hold nothing, null and empty items are not
    looked for; equal rows give equal hits, once for each row; items with equal texts
    are each reported; ids may be null; an empty table on either side gives an empty
    result; other columns are not looked at. A text may be very long and repeat itself:
    memory is in proportion to its length and its hits.
    """
    schema = T.StructType([
        T.StructField(id, docs.schema[id].dataType), T.StructField(item_id, T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("edits", T.IntegerType()),
    ])
    texts = lean(docs).select(F.col(id), F.col(text).alias("_text"))
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        w = Windows.of(block, window, edits)
        if w is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(vars(w))

        def run(batches, sent=sent):
            w = Windows(**sent.value)
            for b in batches:
                for p in flat.pieces(b.column(1)):
                    hits = _merged(_hits(p, w), w)
                    if hits:
                        own, item, s, e, cost = (np.array(x) for x in zip(*hits))
                        ids = b.column(0).slice(p.first, p.n).take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids, pa.array(item, pa.int64()), pa.array(s, pa.int64()),
                                pa.array(e, pa.int64()), pa.array(cost, pa.int32()),
                            ],
                            names=schema.names,
                        )

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    edits: float = EDITS,
) -> DataFrame:
    """The rows in whose texts no window of an item is found; all columns, no shuffle."""
    at = docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text):
        w = Windows.of(block, window, edits)
        if w is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(vars(w))

        def run(batches, sent=sent):
            w = Windows(**sent.value)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for p in flat.pieces(b.column(at)):
                    for own, *_ in _hits(p, w):
                        clean[p.first + own] = False
                yield b.filter(pa.array(clean))

        docs = lean(docs).mapInArrow(run, docs.schema)
    return docs
