"""Repeated passages of a corpus, found with an enhanced suffix array over anchors.

A passage of ``length`` bytes is repeated when it starts at two places. Sorting every
suffix of a corpus is out of reach, and not needed: of every window of ``length`` bytes
the ``GRAM``-byte string with the least hash is its anchor, which depends on the window's
bytes alone, so equal windows have equal anchors at equal places. Windows next to each
other mostly share their anchor; such a run of windows is a *piece*.

* Pieces whose anchor occurs once hold nothing repeated and are gone after one
  pre-aggregated count.
* Pieces with equal bytes are one class, counted by digest; of a class of two or more,
  every byte is repeated. A passage copied into a third of all texts is mostly this.
* What is left are classes that share an anchor but differ further out. Per anchor,
  their suffixes from the anchor on are sorted, the common-prefix lengths of neighbours
  make it an enhanced suffix array, and one stack scan lists its intervals: all classes
  that share r bytes from the anchor on. Inside an interval the bytes before the anchor,
  read backwards, are scanned the same way: an interval of depth l there is a group
  whose common string cannot grow to the left, since its members' next bytes differ.
  With l + r >= ``length`` it is a maximal repeat, and all members are its occurrences.
* An anchor shared by more than ``CLASSES`` classes is not gathered in a task: the
  digests of its windows are counted instead, which gives the same bytes.

Pieces overlap, so a long repeat comes out as several overlapping groups; the union of
their occurrences is exactly the repeated bytes, up to collisions of 128-bit digests
(64 bits for the anchor and 64 for the piece or window).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textprov.llm import flat
from textprov.llm.arrow import lean
from textprov.llm.bitmaps import key_bitmap, marked
from textprov.llm.flat import U
from textprov.session import materialize

LENGTH = 400
GRAM = 96
CLASSES = 256
STEP = 16  # windows that are counted as one where an anchor has more classes
HEAVY = 1024  # rows of an anchor or class from which on they are not moved to meet their key

_PLACE = U((1 << 32) - 1)


def _rolling_least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values, by doubling."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _anchored(p: flat.Piece, length: int, gram: int):
    """Anchor hash, anchor place, first and last window start of every piece."""
    data, n = p.data, len(p.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(U), none, none, none
    sums = flat.prefix(data)
    at = np.arange(n - gram + 1)
    h = flat.mix64((sums[gram:] - sums[: n - gram + 1]) * flat.powers(n + 1, flat.inverse())[at])
    # The leftmost of equal hashes wins, which also depends on the window's bytes alone.
    key = (h & ~_PLACE) | at.astype(U)
    least = _rolling_least(key, length - gram + 1)
    anchor = (least & _PLACE).astype(np.int64)
    size = np.diff(p.offsets)
    inside = np.zeros(n + 1, np.int64)
    long = size >= length
    np.add.at(inside, p.offsets[:-1][long], 1)
    np.add.at(inside, p.offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(anchor)] > 0)
    if not len(starts):
        return none.view(U), none, none, none
    a = anchor[starts]
    new = np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    return h[a[first]], a[first], starts[first], starts[last]


def _pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor, piece, doc, start, n, off``: ``n`` windows from ``start``, anchor at ``off``."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for p in flat.pieces(b.column(1)):
                h, a, lo, hi = _anchored(p, length, gram)
                if not len(h):
                    continue
                own = p.owner(lo)
                view = memoryview(p.data)
                digest = [
                    xxhash.xxh3_64_intdigest(view[s : e + length]) - (1 << 63)
                    for s, e in zip(lo.tolist(), hi.tolist())
                ]
                docs = np.zeros(p.n, np.int64)
                for i in np.unique(own):
                    docs[i] = flat.row_key(ids[p.first + i], p.text(i))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array(digest, pa.int64()),
                        pa.array(docs[own]), pa.array(lo - p.offsets[own]),
                        pa.array((hi - lo + 1).astype(np.int32)),
                        pa.array((a - lo).astype(np.int32)),
                    ],
                    names=["anchor", "piece", "doc", "start", "n", "off"],
                )

    return texts.mapInArrow(
        run, "anchor long, piece long, doc long, start long, n int, off int"
    )


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, text`` of the rows whose keys are in ``wanted.doc``, one row each."""
    keys = wanted.select("doc").distinct()
    bitmap = key_bitmap(keys, "doc")

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for p in flat.pieces(b.column(1)):
                docs = np.array([flat.row_key(ids[p.first + i], p.text(i)) for i in range(p.n)])
                at = np.flatnonzero(marked(bitmap.value, docs))
                cut = b.column(1).slice(p.first, p.n).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[at]), cut.fill_null("")], names=["doc", "text"]
                )

    near = texts.mapInArrow(run, "doc long, text string")
    return near.join(keys, "doc").dropDuplicates(["doc"])


def _contents(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Add to each class the bytes of the piece that stands for it."""
    listed = classes.groupBy("doc").agg(
        F.collect_list(F.struct("anchor", "piece", "copies", "start", "n", "off")).alias("classes")
    )
    joined = _fetch(texts, classes).join(listed, "doc").select("doc", "text", "classes")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py().encode()
                doc = b.column(0)[i].as_py()
                rows = b.column(2)[i].as_py()
                yield pa.RecordBatch.from_pylist(
                    [
                        {**r, "doc": doc, "bytes": data[r["start"] : r["start"] + r["n"] - 1 + length]}
                        for r in rows
                    ],
                    schema=pa.schema([
                        ("anchor", pa.int64()), ("piece", pa.int64()), ("copies", pa.int64()),
                        ("doc", pa.int64()), ("start", pa.int64()), ("n", pa.int32()),
                        ("off", pa.int32()), ("bytes", pa.binary()),
                    ]),
                )

    return joined.mapInArrow(
        run,
        "anchor long, piece long, copies long, doc long, start long, n int, off int, bytes binary",
    )


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if a[lo : lo + 1] != b[lo : lo + 1] else lo + 1


def intervals(lcp: list[int], least: int):
    """Intervals ``(depth, first, last)`` of a common-prefix array, by one stack scan.

    ``lcp[i]`` belongs to rows ``i`` and ``i + 1``. Each interval holds all rows that
    share ``depth`` bytes; only depths of ``least`` or more are listed, children first.
    """
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            was, first = stack.pop()
            yield was, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(rows: list[tuple[bytes, int]], length: int):
    """Maximal repeats among strings aligned at ``off``: ``(members, left, right)``.

    The members share the bytes from ``left`` before their anchor to ``right`` after it,
    at least ``length`` in all, and as a group no more on either side.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][0][rows[i][1] :])
    right = [rows[i][0][rows[i][1] :] for i in order]
    left = [rows[i][0][: rows[i][1]][::-1] for i in order]
    lcp = [common(a, b) for a, b in zip(right, right[1:])]
    for r, first, last in intervals(lcp, 1):
        need = max(0, length - r)
        inside = sorted(range(first, last + 1), key=left.__getitem__)
        back = [common(left[a], left[b]) for a, b in zip(inside, inside[1:])]
        for depth, lo, hi in intervals(back, need):
            members = inside[lo : hi + 1]
            a, b = min(members), max(members)
            if min(lcp[a:b]) > r:
                continue  # they share more to the right: a deeper interval lists them
            yield [order[m] for m in members], depth, r


def _grouped(contents: DataFrame, length: int) -> DataFrame:
    """``repeat, anchor, piece, copies, doc, start, stop``: members of maximal repeats.

    Rows of an anchor arrive together, in order, and hold at most ``CLASSES`` classes.
    """
    names = ["anchor", "piece", "copies", "doc", "start", "off", "bytes"]
    cells = contents.repartition("anchor").sortWithinPartitions("anchor").select(*names)

    def members(group):
        rows = [(g["bytes"], g["off"]) for g in group]
        for who, left, right in maximal_repeats(rows, length):
            one = group[who[0]]
            string = one["bytes"][one["off"] - left : one["off"] + right]
            key = xxhash.xxh3_64_intdigest(string) - (1 << 63)
            for i in who:
                g = group[i]
                at = g["start"] + g["off"]
                yield key, g["anchor"], g["piece"], g["copies"], g["doc"], at - left, at + right

    def run(batches):
        group, out = [], []
        for b in batches:
            for row in b.to_pylist():
                if group and group[0]["anchor"] != row["anchor"]:
                    out.extend(members(group))
                    group = []
                group.append(row)
            if out:
                yield _members(out)
                out = []
        if group:
            out.extend(members(group))
        if out:
            yield _members(out)

    return cells.mapInArrow(
        run,
        "repeat long, anchor long, piece long, copies long, doc long, start long, stop long",
    )


def _members(rows: list[tuple]) -> pa.RecordBatch:
    names = ["repeat", "anchor", "piece", "copies", "doc", "start", "stop"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows)], names=names
    )


def _blocks(contents: DataFrame, length: int) -> DataFrame:
    """Runs of up to ``STEP`` windows of a piece, aligned at the anchor.

    ``core`` is the digest of the bytes that all windows of a full run share, ``whole``
    of all bytes of this run, ``low`` and ``high`` its ends as counted from the anchor.
    """

    def run(batches):
        for b in batches:
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for p in flat.pieces(cols["bytes"]):
                sums = flat.prefix(p.data)
                pick = lambda c: cols[c].slice(p.first, p.n).to_numpy().astype(np.int64)  # noqa: E731, B023
                off, n = pick("off"), pick("n")
                first, last = (off - n + 1) // STEP, off // STEP
                many = last - first + 1
                own = np.repeat(np.arange(p.n), many)
                run_ = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[own]
                low = np.maximum(run_ * STEP, (off - n + 1)[own])
                high = np.minimum(run_ * STEP + STEP - 1, off[own])
                at, base = p.offsets[own], off[own]
                core = flat.span_hashes(
                    sums, at + base - run_ * STEP, at + base - run_ * STEP - STEP + 1 + length
                )
                whole = flat.span_hashes(sums, at + base - high, at + base - low + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(pick(c)[own]) for c in ("anchor", "piece", "copies", "doc", "start")],
                        pa.array(run_), pa.array(core.view(np.int64)), pa.array(low),
                        pa.array(high), pa.array(whole.view(np.int64)), pa.array(base - high),
                        pa.array(base - low),
                    ],
                    names=[
                        "anchor", "piece", "copies", "doc", "start", "run", "core", "low",
                        "high", "whole", "from", "to",
                    ],
                )

    return contents.mapInArrow(
        run,
        "anchor long, piece long, copies long, doc long, start long, run long, core long, "
        "low long, high long, whole long, `from` long, `to` long",
    )


def _windows(contents: DataFrame, length: int) -> DataFrame:
    """The windows of the runs listed in ``runs`` with their digests."""

    def run(batches):
        for b in batches:
            cols = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            lists = cols["runs"].to_pylist()
            for p in flat.pieces(cols["bytes"]):
                sums = flat.prefix(p.data)
                own, inner = [], []
                for i in range(p.n):
                    for r in lists[p.first + i]:
                        inner.append(np.arange(r["from"], r["to"] + 1))
                        own.append(np.full(len(inner[-1]), i))
                own, inner = np.concatenate(own), np.concatenate(inner)
                at = p.offsets[own] + inner
                h = flat.span_hashes(sums, at, at + length)
                pick = lambda c: cols[c].slice(p.first, p.n).to_numpy()[own]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)),
                        *[pa.array(pick(c)) for c in ("anchor", "piece", "copies", "doc")],
                        pa.array(pick("start") + inner),
                    ],
                    names=["repeat", "anchor", "piece", "copies", "doc", "start"],
                )

    return contents.mapInArrow(
        run, "repeat long, anchor long, piece long, copies long, doc long, start long"
    )


def _counted(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes, by pre-aggregated counts of digests.

    First by runs of windows: a run whose bytes occur twice is repeated as a whole, and
    one whose common bytes occur once holds no repeated window. What is left, about one
    run for each end of a passage, is counted window by window, together with one run of
    each repeated kind.
    """
    runs = materialize(_blocks(contents, length), "runs")
    kind = ["anchor", "run", "low", "high", "whole"]
    wholes = (
        runs.groupBy(*kind)
        .agg(
            F.sum("copies").alias("all"), F.first("core").alias("core"),
            F.min(F.struct("piece", "from", "to")).alias("one"),
        )
    )
    wholes = materialize(wholes, "kinds")
    cores = wholes.groupBy("anchor", "run", "core").agg(
        F.sum("all").alias("all"), F.count(F.lit(1)).alias("kinds")
    )
    cores = materialize(cores.where("all > 1 and kinds > 1").drop("all", "kinds"), "cores")
    twice = wholes.where("all > 1").select(*kind)
    resolved = runs.join(twice, kind).select(
        F.col("whole").alias("repeat"), "anchor", "piece", "copies", "doc",
        (F.col("start") + F.col("from")).alias("start"),
        (F.col("start") + F.col("to") + length).alias("stop"),
    )
    asked = wholes.join(cores, ["anchor", "run", "core"]).select("anchor", "one.*")
    listed = asked.groupBy("anchor", "piece").agg(
        F.collect_list(F.struct("from", "to")).alias("runs")
    )
    windows = materialize(
        _windows(contents.join(listed, ["anchor", "piece"]), length), "windows"
    )
    again = windows.groupBy("anchor", "repeat").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialize(again.select("anchor", "repeat"), "windows")
    single = windows.join(again, ["anchor", "repeat"]).select(
        "repeat", "anchor", "piece", "copies", "doc", "start",
        (F.col("start") + length).alias("stop"),
    )
    return resolved.union(single)


def _met(rows: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """Rows with their keys, and no row without; ``count`` tells how many rows a key meets.

    Keys of very many rows go to all tasks instead, so that these rows stay spread as they
    are. Such keys are few: each has more than ``2**-16`` of the sum of all counts.
    """
    most = max(HEAVY, (keys.agg(F.sum(count)).first()[0] or 0) >> 16)
    heavy = F.broadcast(keys.where(F.col(count) > most).drop(count))
    others = rows.join(heavy.select(*on), on, "left_anti")
    light = keys.where(F.col(count) <= most).drop(count)
    return rows.join(heavy, on).unionByName(others.join(light, on))


def repeated_passages(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    every: bool = True,
) -> DataFrame:
    """``doc, repeat, start, stop`` of the occurrences of repeats of ``length`` bytes or more.

    ``doc`` is a key of the row's id and text, ``start`` and ``stop`` are bytes of the
    UTF-8 text, and equal strings have the same ``repeat``. With ``every`` all occurrences
    of every group are listed; without, pieces that are repeated as a whole are listed
    only once, which leaves the union of the occurrences as it is.

    Defined results: a null text is empty; texts shorter than ``length`` hold no repeat;
    rows equal in id and text count as two places but share their ``doc``; null ids are
    ids like others; other columns are not looked at; an empty table gives an empty result.
    """
    gram = min(gram, length)
    texts = lean(df).select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = materialize(_pieces(texts, length, gram), "pieces")
    twice = (
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("all"), F.min("piece").alias("p"), F.max("piece").alias("q"))
        .where("all > 1")
        .select("anchor", (F.col("p") != F.col("q")).alias("mixed"), "all")
    )
    twice = materialize(twice, "anchors")
    found = materialize(_met(found, twice, ["anchor"], "all"), "pieces")
    classes = (
        found.groupBy("anchor", "piece")
        .agg(
            F.count(F.lit(1)).alias("copies"), F.first("mixed").alias("mixed"),
            F.min(F.struct("doc", "start", "n", "off")).alias("one"),
        )
        .select("anchor", "piece", "copies", "mixed", "one.*")
    )
    classes = materialize(classes, "classes")
    copied = classes.where("copies > 1").select("anchor", "piece", "copies")
    whole = _met(found, copied, ["anchor", "piece"], "copies").select(
        "doc", F.col("piece").alias("repeat"), "start",
        (F.col("start") + F.col("n") - 1 + length).alias("stop"),
    )
    mixed = classes.where("mixed").drop("mixed")
    kinds = materialize(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    contents = _contents(texts, mixed, length).join(kinds, "anchor")
    contents = materialize(contents, "contents")
    parts = _grouped(contents.where(F.col("kinds") <= CLASSES).drop("kinds"), length)
    hot = contents.where(F.col("kinds") > CLASSES).drop("kinds")
    if not hot.isEmpty():
        parts = parts.union(_counted(hot, length))
    own = parts.where("copies = 1").select("doc", "repeat", "start", "stop")
    out = whole.union(own)
    if every:
        place = F.col("start") - F.col("first")
        more = (
            parts.where("copies > 1")
            .join(
                classes.select("anchor", "piece", F.col("start").alias("first")),
                ["anchor", "piece"],
            )
            .select(
                "anchor", "piece", "copies", "repeat", place.alias("from"),
                (F.col("stop") - F.col("first")).alias("to"),
            )
            .distinct()
        )
        places = found.select("anchor", "piece", "doc", F.col("start").alias("at"))
        more = _met(places, materialize(more, "more"), ["anchor", "piece"], "copies").select(
            "doc", "repeat", (F.col("at") + F.col("from")).alias("start"),
            (F.col("at") + F.col("to")).alias("stop"),
        )
        out = out.union(more)
    return out


def remove_repeats(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row.

    Every byte inside a string of ``length`` bytes that also starts elsewhere is removed,
    judged on the texts as they come in. ``kept_sha256`` is the digest of the bytes left.
    """
    texts = lean(df).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def base(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for p in flat.pieces(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(p.first, p.n),
                        pa.array([flat.row_key(ids[p.first + i], p.text(i)) for i in range(p.n)], pa.int64()),
                        pa.array(np.diff(p.offsets)),
                        pa.array([hashlib.sha256(p.text(i)).hexdigest() for i in range(p.n)]),
                    ],
                    names=["id", "doc", "n_bytes", "sha"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(base, f"id {kind}, doc long, n_bytes long, sha string")
    spans = repeated_passages(df, id, text, length, gram, every=False)
    spans = spans.select("doc", "start", "stop").distinct()
    spans = materialize(
        spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans"
    )
    changed = _fetch(texts, spans).join(spans, "doc").select("doc", "text", "spans")

    def cut(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py().encode()
                s = b.column(2)[i].values
                lo, hi = s.field("start").to_numpy(), s.field("stop").to_numpy()
                gone = flat.covered(lo, hi, len(data))
                edge = np.diff(np.r_[False, gone].astype(np.int8))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((
                    b.column(0)[i].as_py(), int(gone.sum()), int((edge == 1).sum()),
                    hashlib.sha256(kept).hexdigest(),
                ))
            if out:
                doc, removed, n, sha = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(removed), pa.array(n), pa.array(sha)],
                    names=["doc", "n_removed", "n_spans", "cut_sha"],
                )

    done = changed.mapInArrow(cut, "doc long, n_removed long, n_spans long, cut_sha string")
    return rows.join(done, "doc", "left").select(
        F.col("id").alias(id),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )
