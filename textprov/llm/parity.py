"""Near-duplicate join by parity sketches.

A text's set holds its distinct word shingles as 64-bit hashes. Each hash falls in one
of m parts and flips one bit of that part's word: the parts together are a bit sketch in
which every common shingle cancels out, so the Hamming distance of two sketches never
exceeds the size of the symmetric difference of the sets. Two sets of sizes A and B with
Jaccard similarity t or more differ in at most d = (1-t)/(1+t) * (A+B) shingles. With
m = d + 1 + e parts at least e + 1 parts are the same in both (pigeonhole), so it is
enough to join texts on single parts. Sizes are cut into bands; m is fixed inside a
band, and a text that could pair with a smaller one from the band below joins there too.

* Texts with equal sets are one node from the start, so exact copies cost nothing.
* A part's join key also holds the XOR of its whole hashes: equal parts still have equal
  keys, and parts of one or two bits no longer meet by chance. Parts with no shingle, or
  with a single one, are left out where the e spare parts allow it, which is exact.
* The first pass finds the smallest node of each key by a pre-aggregating group-by. The
  second sends only keys that met: each node is compared with the smallest of its key.
* Keys whose nodes then still lie in several components have all pairs across
  components compared by sketch, in tiles of bounded size, inside tasks; pairs that
  survive are verified. So no link between components is lost, and a group of
  many copies costs about one comparison per copy.
* Whatever the sketches let through is verified on the sets themselves.

64-bit hashes stand for shingles and sets: results are exact up to hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textprov.llm import flat
from textprov.llm.arrow import lean
from textprov.llm.bitmaps import key_bitmap, marked, split
from textprov.llm.components import components
from textprov.llm.flat import U, mix64
from textprov.session import materialize

TILE = 512
PAIRS = 1 << 18  # pairs looked at in one go
WORDS = 1 << 20  # words of sketches compared in one go
SKETCH = 1024  # least bits of a sketch
LISTED = 64  # keys of a node that travel with it, to report a pair once


_bands: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``num / den`` on shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def least(self) -> int:
        """Size below which only equal sets reach the similarity."""
        return max(1, -(-self.num // (self.den - self.num)))

    def partner(self, size: int) -> int:
        """Largest set that can be similar to one of ``size``."""
        return size * self.den // self.num

    def band(self, k: int) -> tuple[int, int, int, int, int]:
        """First size, first size of the next band, differences, spare parts, parts."""
        known = _bands.setdefault((self.num, self.den), [])
        while len(known) <= k:
            low = known[-1][1] if known else self.least
            high = max(low + 1, low * 3 // 2)
            pair = high - 1 + self.partner(high - 1)
            d = pair * (self.den - self.num) // (self.den + self.num)
            spare = 2 + d // (12 if low >= 5 * (d + 1) else 5)
            known.append((low, high, d, spare, d + 1 + spare))
        return known[k]

    def bands(self, size: int) -> list[int]:
        """Bands in which a set of this size joins."""
        if size < self.least:
            return []
        k = 0
        while self.band(k)[1] <= size:
            k += 1
        out = [k]
        if k and size <= self.partner(self.band(k - 1)[1] - 1):
            out.append(k - 1)
        return out

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        common = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * common >= self.num * (len(a) + len(b) - common)


def shingle_sets(p: flat.Piece, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words."""
    low = flat.Piece(p.first, flat.LOWER[p.data], p.offsets)
    starts, ends = flat.words(low)
    owner = low.owner(starts)
    h = flat.span_hashes(flat.prefix(low.data), starts, ends)
    g = flat.grams(h, k)
    at = np.searchsorted(owner, np.arange(p.n + 1))
    for i in range(p.n):
        lo, hi = at[i], at[i + 1]
        n = hi - lo
        if n >= k:
            yield np.unique(g[lo : hi - k + 1])
        elif n:
            yield flat.grams(h[lo:hi], n)
        else:
            yield g[:0]


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _parts(s: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part of each hash, its bit, and the hash as salted for the band."""
    x = mix64(s + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((x >> U(32)) * U(m) >> U(32)).astype(np.int64), (x & U(63)), x


def keys_of(s: np.ndarray, k: int, rule: Similarity) -> np.ndarray:
    """Join keys of a set in band ``k``: one for each part that has to be joined."""
    _, _, _, spare, m = rule.band(k)
    part, bit, x = _parts(s, k, m)
    order = np.argsort(part, kind="stable")
    part, bit, x = part[order], bit[order], x[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    held = part[first]
    size = np.diff(np.r_[first, len(part)])
    parity = np.bitwise_xor.reduceat(U(1) << bit, first)
    whole = np.bitwise_xor.reduceat(x, first)
    empty = m - len(held)
    if empty <= spare:
        if empty + int((size == 1).sum()) <= spare:
            held, parity, whole = held[size > 1], parity[size > 1], whole[size > 1]
    else:
        gone = np.setdiff1d(np.arange(m), held)
        held = np.r_[held, gone]
        zero = np.zeros(len(gone), U)
        parity, whole = np.r_[parity, zero], np.r_[whole, zero]
    place = (held.astype(U) << U(8)) | U(k)
    return mix64(mix64(parity ^ mix64(whole)) + place).view(np.int64)


def sketch_of(s: np.ndarray, k: int, rule: Similarity) -> bytes:
    """The sketch that two sets of band ``k`` are compared by.

    It has two bits a shingle or more: unrelated sets of n shingles then differ in 0.86 n
    bits and sets of similarity 0.7 in 0.3 n, where 0.8 allows 0.22 n. Small sets, whose
    distances scatter more, get ``SKETCH`` bits. Pairs that pass by chance are verified.
    """
    bits = max(SKETCH, 64 * -(-2 * rule.band(k)[1] // 64))
    _, _, x = _parts(s, k, 1)
    at = ((x >> U(32)) * U(bits) >> U(32)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def _batch(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _nodes(texts: DataFrame, rule: Similarity, carry: Sequence[str] = ()) -> DataFrame:
    """``id, n_shingles, node`` of every text, and its ``carry``."""

    def run(batches):
        for b in batches:
            for p in flat.pieces(b.column(1)):
                sets = list(shingle_sets(p, rule.words))
                yield _batch({
                    "id": b.column(0).slice(p.first, p.n),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    **{c: b.column(c).slice(p.first, p.n) for c in carry},
                })

    longs = "".join(f", `{c}` long" for c in carry)
    return texts.mapInArrow(run, "id long, n_shingles long, node long" + longs)


def _keys(texts: DataFrame, rule: Similarity, only=None) -> DataFrame:
    """``key, node`` for every part that a text joins on; ``only`` keeps marked keys, with
    their ``band``."""

    def run(batches):
        for b in batches:
            for p in flat.pieces(b.column(1)):
                keys, nodes, bands = [], [], []
                for s in shingle_sets(p, rule.words):
                    node = node_of(s)
                    for k in rule.bands(len(s)):
                        ks = keys_of(s, k, rule)
                        if only is not None:
                            ks = ks[marked(only.value, ks)]
                        keys.append(ks)
                        nodes.append(np.full(len(ks), node))
                        bands.append(np.full(len(ks), k, np.int32))
                if keys:
                    cols = {
                        "key": pa.array(np.concatenate(keys), pa.int64()),
                        "node": pa.array(np.concatenate(nodes), pa.int64()),
                    }
                    if only is not None:
                        cols["band"] = pa.array(np.concatenate(bands), pa.int32())
                    yield _batch(cols)

    return texts.mapInArrow(run, "key long, node long" + (", band int" if only is not None else ""))


def _sketches(texts: DataFrame, rule: Similarity) -> DataFrame:
    """``node, band, n, sketch`` for each band that a node joins in."""

    def run(batches):
        for b in batches:
            for p in flat.pieces(b.column(1)):
                out = [
                    (node_of(s), k, len(s), sketch_of(s, k, rule))
                    for s in shingle_sets(p, rule.words)
                    for k in rule.bands(len(s))
                ]
                if out:
                    node, band, n, sketch = zip(*out)
                    yield _batch({
                        "node": pa.array(node, pa.int64()), "band": pa.array(band, pa.int32()),
                        "n": pa.array(n, pa.int64()), "sketch": pa.array(sketch, pa.binary()),
                    })

    return texts.mapInArrow(run, "node long, band int, n long, sketch binary")


def _near(rule: Similarity, n1, s1, n2, s2) -> np.ndarray:
    """Which rows of sketches ``s2`` can be similar to the sketch ``s1``."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    apart = np.bitwise_count(s2 ^ s1).sum(axis=1, dtype=np.int64)
    most = (n1 + n2) * (rule.den - rule.num) // (rule.den + rule.num)
    return (large * rule.num <= small * rule.den) & (apart <= most)


def _sketch_filter(edges: DataFrame, sketches: DataFrame, rule: Similarity) -> DataFrame:
    """Edges ``a, b`` whose sizes and sketches allow the similarity in some band."""
    left = sketches.select(
        F.col("node").alias("a"), "band", F.col("n").alias("n1"), F.col("sketch").alias("s1")
    )
    right = sketches.select(
        F.col("node").alias("b"), "band", F.col("n").alias("n2"), F.col("sketch").alias("s2")
    )
    both = edges.join(left, "a").join(right, ["b", "band"]).select("a", "b", "n1", "s1", "n2", "s2")

    def run(batches):
        for b in batches:
            n1, n2 = (b.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(3), b.column(5))):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                keep[i] = _near(rule, n1[i], x, n2[i : i + 1], y[None, :])[0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1)], names=["a", "b"]
            ).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _verify(edges: DataFrame, texts: DataFrame, rule: Similarity) -> DataFrame:
    """Edges whose sets reach the similarity, from the texts themselves.

    Texts on no edge stay where they are.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    _, texts = split(texts.select("node", "text"), "node", key_bitmap(ends, "node"))
    pairs = (
        edges.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def one(value) -> np.ndarray:
        return next(shingle_sets(next(flat.pieces(pa.array([value], pa.string()))), rule.words))

    def run(batches):
        last, have = None, None
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                a = b.column(0)[i].as_py()
                if a != last:
                    last, have = a, one(b.column(2)[i].as_py())
                keep[i] = rule.similar(have, one(b.column(3)[i].as_py()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1)], names=["a", "b"]
            ).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _across(mixed: DataFrame, sketches: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs of nodes that share a key, lie in different components and are near by sketch.

    A key's nodes are dealt into tiles of about ``TILE`` nodes; a task sees two tiles. Of
    the keys that a pair shares, only the first reports it, where both lists are at hand.
    """
    sizes = mixed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = (
        mixed.join(sizes, "key")
        .withColumn("mine", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"),
            "mine", "node", "band", "component", "keys",
        )
        .join(sketches, ["node", "band"])
    )
    cells = dealt.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    cells = cells.select(
        "key", "t1", "t2", "band", "mine", "node", "component", "keys", "n", "sketch"
    )

    def compare(t: pa.Table):
        """Near pairs inside the groups of equal key and tiles; the rows are sorted by them."""
        t = t.combine_chunks()
        key, t1, t2, mine, node, band, comp, n = (
            t.column(c).to_numpy()
            for c in ("key", "t1", "t2", "mine", "node", "band", "component", "n")
        )
        new = np.r_[True, (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        ends = np.r_[first[1:], len(key)][group]
        apart = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
        count = np.where(apart[group], ends - np.arange(len(key)) - 1, 0)
        sketches = t.column("sketch")
        row, place, matrix = np.arange(len(key)), np.zeros(len(key), np.int64), {}
        for k in np.unique(band[count > 0]):
            own = row[(band == k) & apart[group]]
            data = b"".join(x.as_py() for x in sketches.take(pa.array(own)))
            matrix[k] = np.frombuffer(data, U).reshape(len(own), -1)
            place[own] = np.arange(len(own))
        lists, earlier = t.column("keys"), {}

        def before(i: int) -> set | None:
            """The row's keys below the one it is compared at; None if they are not listed."""
            if i not in earlier:
                own = lists[i].as_py()
                earlier[i] = None if own is None else {k for k in own if k < key[i]}
            return earlier[i]

        def reported(i: int, j: int) -> bool:
            a, b = before(i), before(j)
            return a is None or b is None or a.isdisjoint(b)

        done = np.r_[0, np.cumsum(count)]
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, side="right")) - 1)
            i = np.repeat(row[lo:hi], count[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(done[lo:hi] - done[lo], count[lo:hi])
            lo = hi
            ok = (comp[i] != comp[j]) & ((t1[i] == t2[i]) | (mine[i] != mine[j]))
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok &= large * rule.num <= small * rule.den
            i, j = i[ok], j[ok]
            near = np.zeros(len(i), bool)
            for k, s in matrix.items():
                own = np.flatnonzero(band[i] == k)
                step = max(1, WORDS // s.shape[1])
                for at in range(0, len(own), step):
                    x = own[at : at + step]
                    far = np.bitwise_count(s[place[i[x]]] ^ s[place[j[x]]]).sum(axis=1, dtype=np.int64)
                    near[x] = far <= (n[i[x]] + n[j[x]]) * (rule.den - rule.num) // (rule.den + rule.num)
            pairs = [(x, y) for x, y in zip(i[near].tolist(), j[near].tolist()) if reported(x, y)]
            if pairs:
                x, y = np.array(pairs).T
                yield _batch({
                    "a": pa.array(np.minimum(node[x], node[y])),
                    "b": pa.array(np.maximum(node[x], node[y])),
                })

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = [t.column(c)[len(t) - 1].as_py() for c in ("key", "t1", "t2")]
            ours = np.ones(len(t), bool)
            for c, v in zip(("key", "t1", "t2"), last):
                ours &= t.column(c).to_numpy() == v
            cut = int(np.argmax(ours))  # the last group may go on in the next batch
            if cut:
                yield from compare(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from compare(held)

    return cells.mapInArrow(run, "a long, b long").distinct()


def _apart(held: DataFrame, comps: DataFrame) -> DataFrame:
    """``key, node, band, component, keys`` of the keys whose nodes lie in several components.

    ``keys`` lists the node's keys of this kind, if there are at most ``LISTED``.
    """
    rows = held.select("key", "node", "band").join(comps, "node", "left")
    rows = rows.select("key", "node", "band", F.coalesce("component", "node").alias("component"))
    split = (
        rows.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("key")
    )
    mixed = materialize(rows.join(split, "key"), "mixed")
    count = mixed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(f"n <= {LISTED}")
    short = mixed.join(count.select("node"), "node").groupBy("node")
    listed = short.agg(F.sort_array(F.collect_set("key")).alias("keys"))
    return mixed.join(listed, "node", "left")


def similar_groups(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    rule: Similarity = Similarity(),
    carry: Sequence[str] = (),
) -> DataFrame:
    """``id, n_shingles, component_id, n_links, component`` for every row, and its ``carry``.

    ``component`` is the same number for all rows of a group, null for an empty text;
    ``carry`` names long columns that tell rows of one id apart. ``component_id`` is the smallest id reachable by links, the row's own included;
    ``n_links`` counts the verified links of the row's set that the search needed. Two
    texts link when their sets are equal or reach the similarity.

    Defined results: a null text is empty; an empty text has size 0, links with nothing,
    and its component is its own id; ids that repeat stand for rows of their own texts; a
    row with a null id takes part in links like any other, and its component is the
    smallest id that is not null, or null without one; other columns are not looked at;
    an empty table gives an empty result.
    """
    texts = lean(df).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    named = texts if not carry else lean(df).select(
        F.col(id).cast("long").alias("id"), F.col(text).alias("text"), *carry
    )
    nodes = materialize(_nodes(named, rule, carry), "nodes")
    met = (
        _keys(texts, rule)
        .groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first <> last")
        .select("key", "first")
    )
    met = materialize(met, "met")
    held = materialize(
        _keys(texts, rule, key_bitmap(met, "key", 1 << 27)).distinct().join(met, "key"), "held"
    )
    # One text stands for each node that met another.
    wanted = held.select("node").distinct()
    each = nodes.join(wanted, "node").groupBy("node", "id").agg(F.count(F.lit(1)).alias("n"))
    chosen = each.groupBy("node").agg(F.min(F.struct("id", "n")).alias("s"))
    chosen = chosen.select("node", F.col("s.id").alias("id"), F.col("s.n").alias("n"))
    chosen = materialize(chosen, "chosen")
    bitmap = key_bitmap(chosen, "id")

    def fetch(batches):
        for b in batches:
            ids = b.column(0)
            at = np.flatnonzero(
                marked(bitmap.value, ids.fill_null(0).to_numpy().astype(np.int64))
                | ids.is_null().to_numpy(zero_copy_only=False)
            )
            part = b.take(pa.array(at))
            for p in flat.pieces(part.column(1)):
                own = [node_of(s) if len(s) else None for s in shingle_sets(p, rule.words)]
                cut = part.slice(p.first, p.n)
                yield _batch({
                    "id": cut.column(0), "node": pa.array(own, pa.int64()), "text": cut.column(1),
                })

    fetched = texts.mapInArrow(fetch, "id long, node long, text string")
    fetched = fetched.join(
        chosen, fetched["id"].eqNullSafe(chosen["id"]) & (fetched["node"] == chosen["node"])
    ).select(fetched["node"], "text")
    # Rows that repeat an id and a text are the same text: keep one of each node.
    twice = chosen.where("n > 1")
    if not twice.isEmpty():
        once, again = split(fetched, "node", key_bitmap(twice, "node"))
        fetched = once.unionByName(again.dropDuplicates(["node"]))
    fetched = materialize(fetched, "texts")
    sketches = materialize(_sketches(fetched.select("node", "text"), rule), "sketches")

    # Every node against the smallest of its key: one comparison a node and key.
    stars = held.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = materialize(_sketch_filter(stars.distinct(), sketches, rule), "near")
    links = materialize(_verify(near, fetched, rule), "links")
    comps = materialize(components(links), "components")
    # Keys whose nodes still lie apart are compared in full.
    rest = materialize(_across(_apart(held, comps), sketches, rule), "rest")
    rest = rest.join(near, ["a", "b"], "left_anti")
    more = materialize(_verify(rest, fetched, rule), "links")
    if more.isEmpty():
        final = comps
    else:
        known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        final = materialize(components(known.union(more)), "components")
    every = links.union(more)

    ends = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    least = nodes.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    placed = least.join(final, "node", "left").join(degree, "node", "left")
    placed = placed.select(
        "node", "least", F.coalesce("component", "node").alias("component"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(named, "component").select("node", "component_id", "n_links", "component")
    return nodes.join(found, "node", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "component",
        *carry,
    )
