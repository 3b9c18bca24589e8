"""Repeated runs of lines, by content-defined chunks.

Every line is hashed; where the hash rolled over two lines falls on one of ``MEAN`` values,
a chunk of two lines or more may end. Borders depend on nearby lines alone, so a passage is
cut alike wherever it stands. Chunks that repeat, byte by byte, go from all places but the
first (least id, then place): ``remove_repeated_chunks``.

A repeated run need not begin and end with a chunk, and a short one may hold none.
``remove_repeated_runs`` therefore goes on line by line, across the borders of chunks and
inside chunks that stay. From every line the shortest run of two lines and ``LEAST`` bytes
that starts there is taken, and to every line the shortest that ends there: two windows a
line at most, and any longer run is a union of them. Windows inside a chunk that goes are
left out: their lines go anyway, and the chunk's first place, which is earlier, has them
too. So a line goes if it lies in any run that stands at an earlier place, wherever the run
begins, and every line still stands somewhere.

Chunks and windows are found alike. Digests find candidates: a pre-aggregated count of
narrow rows. Then the bytes decide: the spans whose digests repeat are grouped by their
bytes, and only what is equal byte by byte is removed.

Texts travel only if they may lose something; bitmaps of fixed size let the others pass in
place. A bitmap that marks too much only lets more windows be counted.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from textprov.llm import flat
from textprov.llm.arrow import BATCH_BYTES, lean
from textprov.llm.bitmaps import key_bitmap, marked
from textprov.llm.flat import U, mix64
from textprov.session import materialize

MEAN = 2  # one line in so many may end a chunk
ROWS = 512  # rows whose texts are taken out of a batch at once
LEAST = 40  # bytes below which a chunk or run is left alone


def chunk_spans(p: flat.Piece, mean: int = MEAN):
    """Line starts, line ends, their texts, and the first line of each chunk.

    Chunk ``c`` runs over lines ``first[c] .. first[c + 1] - 1``.
    """
    starts, ends, owner = flat.lines(p)
    n = len(starts)
    if not n:
        return starts, ends, owner, np.zeros(1, np.int64)
    h = flat.span_hashes(flat.prefix(p.data), starts, ends)
    top = np.r_[True, owner[1:] != owner[:-1]]
    last = np.r_[owner[1:] != owner[:-1], True]
    rolled = np.zeros(n, U)
    rolled[1:] = flat.grams(h, 2)
    flag = (rolled % U(mean) == 0) & ~top
    # Of chances in a row every second one counts, so that a chunk has two lines.
    place = np.arange(n)
    quiet = np.maximum.accumulate(np.where(flag, -1, place))
    end = flag & ((place - quiet) % 2 == 1)
    end &= ~np.r_[last[1:], True]  # do not leave the last line alone
    end |= last
    first = np.flatnonzero(np.r_[True, end[:-1]])
    return starts, ends, owner, np.r_[first, n]


def window_spans(p: flat.Piece, least: int = LEAST):
    """Line starts, line ends, their texts, and first and last line of each window.

    Windows are the shortest runs of two lines and ``least`` bytes or more that start, or
    end, at each line; in the order of their lines, each once.
    """
    starts, ends, owner = flat.lines(p)
    n = len(starts)
    line = np.arange(n)
    to = np.maximum(np.searchsorted(ends, starts + least, "left"), line + 1)
    back = np.minimum(np.searchsorted(starts, ends - least, "right"), line) - 1
    on, off = to < n, back >= 0
    on[on] = owner[to[on]] == owner[on]
    off[off] = owner[back[off]] == owner[off]
    both = np.r_[line[on] * n + to[on], back[off] * n + line[off]]
    first, last = np.divmod(np.unique(both), max(n, 1))
    return starts, ends, owner, first, last


class Spans(NamedTuple):
    """Runs of lines of a piece: their texts, bytes and lines, lines counted from the text's first."""

    owner: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(*(x[at] for x in self))

    def digests(self, p: flat.Piece, seed: int = 0) -> np.ndarray:
        view = memoryview(p.data)
        each = [xxhash.xxh3_64_intdigest(view[s:e], seed) for s, e in zip(self.start, self.stop)]
        return np.array(each, U).view(np.int64)

    def number(self) -> np.ndarray:
        """One number a run, in the order of their lines; ``lines_of`` reads it."""
        return self.first << 32 | self.last


def lines_of(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return number >> 32, number & 0xFFFFFFFF


def _spans(starts, ends, owner, first, last) -> Spans:
    top = np.searchsorted(owner, owner)  # first line of each line's text
    return Spans(owner[first], starts[first], ends[last], first - top[first], last - top[first])


def chunks_of(p: flat.Piece, mean: int, least: int) -> Spans:
    """Chunks of two lines and ``least`` bytes or more."""
    starts, ends, owner, first = chunk_spans(p, mean)
    every = _spans(starts, ends, owner, first[:-1], first[1:] - 1)
    return every.take((every.last > every.first) & (every.stop - every.start >= least))


def windows_of(p: flat.Piece, least: int) -> Spans:
    return _spans(*window_spans(p, least))


def _docs(ids: list, p: flat.Piece, owner: np.ndarray) -> np.ndarray:
    """``flat.row_key`` of each span's text."""
    which, back = np.unique(owner, return_inverse=True)
    keys = [flat.row_key(ids[p.first + i], p.text(i)) for i in which.tolist()]
    return np.array(keys, np.int64)[back]


def _spots(docs: np.ndarray, spans: Spans) -> np.ndarray:
    """One number for each place of a span."""
    return mix64(docs.view(U) ^ mix64(spans.number())).view(np.int64)


def _outside(spans: Spans, chunks: Spans) -> np.ndarray:
    """Which spans lie in none of the chunks; chunks do not overlap and are in order."""
    if not len(chunks.start):
        return np.ones(len(spans.start), bool)
    at = np.searchsorted(chunks.start, spans.start, side="right") - 1
    return (at < 0) | (spans.stop > chunks.stop[at]) | (spans.owner != chunks.owner[at])


class Gone(NamedTuple):
    """Chunks that go, told apart in tasks: their digest repeats, their place does not stay."""

    repeated: Broadcast
    staying: Broadcast

    def chunks(self, p: flat.Piece, ids: list, mean: int, least: int) -> Spans:
        chunks = chunks_of(p, mean, least)
        chunks = chunks.take(marked(self.repeated.value, chunks.digests(p)))
        spots = _spots(_docs(ids, p, chunks.owner), chunks)
        return chunks.take(~marked(self.staying.value, spots))


Find = Callable[[flat.Piece, list], Spans]


def _rows(texts: DataFrame, find: Find, kind: str, only: Broadcast | None = None) -> DataFrame:
    """``digest`` of each span; with ``only`` of the marked, with ``check, doc, number``.

    ``kind`` "digests" gives no more, "places" the rest and ``spot``, "bytes" also ``id``
    and ``bytes``.
    """
    schema = "digest long"
    if kind != "digests":
        schema += ", check long, doc long, number long"
    if kind == "places":
        schema += ", spot long"
    if kind == "bytes":
        schema += f", id {texts.schema['id'].dataType.simpleString()}, bytes binary"

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for p in flat.pieces(b.column(1)):
                spans = find(p, ids)
                digest = spans.digests(p)
                if kind == "digests":
                    yield pa.RecordBatch.from_arrays([pa.array(digest)], names=["digest"])
                    continue
                every = np.flatnonzero(marked(only.value, digest))
                spans, digest = spans.take(every), digest[every]
                docs = _docs(ids, p, spans.owner)
                # Windows overlap, so their bytes may be many times the text's.
                size = np.cumsum(spans.stop - spans.start) // BATCH_BYTES
                for at in np.split(np.arange(len(every)), np.flatnonzero(size[1:] != size[:-1]) + 1):
                    own = spans.take(at)
                    cols = {
                        "digest": pa.array(digest[at]),
                        "check": pa.array(own.digests(p, 1)),
                        "doc": pa.array(docs[at]),
                        "number": pa.array(own.number()),
                    }
                    if kind == "places":
                        cols["spot"] = pa.array(_spots(docs[at], own))
                    if kind == "bytes":
                        view = memoryview(p.data)
                        data = [view[s:e].tobytes() for s, e in zip(own.start, own.stop)]
                        cols["id"] = b.column(0).take(pa.array(p.first + own.owner))
                        cols["bytes"] = pa.array(data, pa.binary())
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return texts.mapInArrow(run, schema)


def _repeated(texts: DataFrame, find: Find) -> DataFrame:
    """``digest, check`` of the spans that stand twice, and ``_doc, _number`` of the first place."""
    twice = (
        _rows(texts, find, "digests").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest")
    )
    bitmap = key_bitmap(materialize(twice, "digests"), "digest")
    same = _rows(texts, find, "bytes", bitmap).groupBy("digest", "check", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "doc", "number")).alias("keep")
    )
    # One group of bytes for both digests, or else the span is left alone.
    alone = same.groupBy("digest", "check").agg(
        F.count(F.lit(1)).alias("groups"), F.max("n").alias("n"), F.first("keep").alias("keep")
    ).where("groups = 1 and n > 1").select(
        "digest", "check", F.col("keep.doc").alias("_doc"), F.col("keep.number").alias("_number")
    )
    return materialize(alone, "repeated")


def _places(texts: DataFrame, find: Find, repeated: DataFrame, bitmap: Broadcast) -> DataFrame:
    """``doc, number, spot, gone`` of every span that the bitmap marks."""
    again = F.col("_doc").isNotNull() & ((F.col("doc") != F.col("_doc")) | (F.col("number") != F.col("_number")))
    met = _rows(texts, find, "places", bitmap).join(repeated, ["digest", "check"], "left")
    return met.select("doc", "number", "spot", again.alias("gone"))


def _by_doc(gone: DataFrame) -> DataFrame:
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def _repeated_chunks(texts: DataFrame, mean: int, least: int) -> tuple[DataFrame, Gone]:
    """``doc, number`` of the chunks that go, and the means to know them in tasks."""

    def find(p: flat.Piece, ids: list) -> Spans:
        return chunks_of(p, mean, least)

    repeated = _repeated(texts, find)
    bitmap = key_bitmap(repeated, "digest")
    placed = materialize(_places(texts, find, repeated, bitmap), "chunks")
    staying = key_bitmap(placed.where("not gone"), "spot")
    return placed.where("gone").select("doc", "number"), Gone(bitmap, staying)


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    return lean(df).select(F.col(id).alias("id"), F.col(text).alias("text"))


def repeated_chunks(
    df: DataFrame, id: str = "doc_id", text: str = "text", mean: int = MEAN, least: int = LEAST
) -> DataFrame:
    """``doc, numbers``: which chunks of a row are removed; ``doc`` is ``flat.row_key``."""
    return _by_doc(_repeated_chunks(_texts(df, id, text), mean, least)[0])


def repeated_runs(
    df: DataFrame, id: str = "doc_id", text: str = "text", mean: int = MEAN, least: int = LEAST
) -> DataFrame:
    """``doc, numbers``: which chunks and windows of a row stand earlier too."""
    texts = _texts(df, id, text)
    chunks, gone = _repeated_chunks(texts, mean, least)

    def find(p: flat.Piece, ids: list) -> Spans:
        windows = windows_of(p, least)
        return windows.take(_outside(windows, gone.chunks(p, ids, mean, least)))

    repeated = _repeated(texts, find)
    windows = _places(texts, find, repeated, key_bitmap(repeated, "digest"))
    return _by_doc(chunks.unionByName(windows.where("gone").select("doc", "number")))


def _cut_out(df: DataFrame, gone: DataFrame, id: str, text: str) -> DataFrame:
    """All rows and columns of ``df`` without the runs of lines that ``gone`` numbers."""
    bitmap = key_bitmap(gone, "doc")
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed_lines")]
    at, who = kept.index(text), kept.index(id)
    # The caller's columns go by number in between, so that no name clashes.
    plain = [f"c{i}" for i in range(len(kept))]
    base = T.StructType([T.StructField(p, df.schema[c].dataType) for p, c in zip(plain, kept)])

    def tag(want: bool):
        def run(batches):
            for b in batches:
                ids = b.column(who).to_pylist()
                for p in flat.pieces(b.column(at)):
                    docs = np.array([flat.row_key(ids[p.first + i], p.text(i)) for i in range(p.n)])
                    pick = pa.array(np.flatnonzero(marked(bitmap.value, docs) == want))
                    lines = np.bincount(flat.lines(p)[2], minlength=p.n)
                    own = b.slice(p.first, p.n)
                    n = pa.array(np.where(own.column(at).is_null().to_numpy(False), 0, lines))
                    yield pa.RecordBatch.from_arrays(
                        [c.take(pick) for c in [*own.columns, n, pa.array(docs)]],
                        names=[*plain, "n_lines", "_doc"],
                    )

        return run

    tagged = base.add("n_lines", T.LongType()).add("_doc", T.LongType())
    rows = df.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, kept)])
    stay = rows.mapInArrow(tag(False), tagged).drop("_doc").withColumn(
        "n_removed_lines", F.lit(0).cast("long")
    )
    maybe = rows.mapInArrow(tag(True), tagged).join(
        gone.withColumnsRenamed({"doc": "_doc", "numbers": "_numbers"}), "_doc", "left"
    )
    maybe = maybe.select(*plain, "n_lines", "_numbers")

    def cut(batches):
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts, numbers = b.column(at).to_pylist(), b.column(len(kept) + 1).to_pylist()
            removed = np.zeros(b.num_rows, np.int64)
            for i, drop in enumerate(numbers):
                if not drop:
                    continue
                p = next(flat.pieces(pa.array([texts[i]], pa.string())))
                starts, ends, _ = flat.lines(p)
                first, last = lines_of(np.array(drop, np.int64))
                out = flat.covered(first, last + 1, len(starts))
                data = p.data.tobytes()
                texts[i] = b"\n".join(
                    data[s:e] for s, e in zip(starts[~out], ends[~out])
                ).decode()
                removed[i] = out.sum()
            cols = list(b.columns[: len(kept) + 1])
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(removed)], names=[*plain, "n_lines", "n_removed_lines"]
            )

    done = T.StructType(list(tagged)[:-1]).add("n_removed_lines", T.LongType())
    both = stay.unionByName(maybe.mapInArrow(cut, done))
    return both.select(
        *[F.col(p).alias(c) for p, c in zip(plain, kept)], "n_lines", "n_removed_lines"
    )


def remove_repeated_chunks(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    mean: int = MEAN,
    least: int = LEAST,
) -> DataFrame:
    """All rows and columns, repeated chunks cut out of ``text``; adds counts of lines.

    ``n_lines`` counts the lines of the text that came in, ``n_removed_lines`` those
    removed. The lines left are joined again by line feeds.

    Defined results: a null text stays null and has no lines; an empty one has one; rows
    equal in id and text are the same place, so a chunk that occurs first there stays in
    all of them; a null id comes before all others; columns keep their names and values,
    but for those named like a result, which hold the result; an empty table gives an
    empty result.
    """
    gone = materialize(repeated_chunks(df, id, text, mean, least), "gone")
    return _cut_out(df, gone, id, text)


def remove_repeated_runs(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    mean: int = MEAN,
) -> DataFrame:
    """All rows and columns, every repeated run of lines cut out of ``text``; adds counts of lines.

    Columns and defined results are those of ``remove_repeated_chunks``. A run that repeats
    inside one text, also with an overlap, stays at its first place there. The result does
    not depend on ``mean``: chunks that repeat are removed first, and the runs that chunks
    miss are found line by line.
    """
    gone = materialize(repeated_runs(df, id, text, mean, least), "gone")
    return _cut_out(df, gone, id, text)
