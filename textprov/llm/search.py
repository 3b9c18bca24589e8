"""Ranked lexical search by branch and bound over a trie of documents.

Only terms of the items count. A document's restricted vector, its item terms with how
often they occur, is ordered by falling document frequency; documents whose vectors
begin alike share a path of a trie. Every node keeps, for all documents below it, the greatest count
of each term and the least length weight ``m``. A score rises with counts and falls with
``m``, so these bound the score of every document below, and an item's search goes depth
first, best child first, and leaves out each subtree whose bound is below the item's tenth
best score so far.

The texts are read once, into restricted vectors. Tasks build tries over blocks of vectors
of bounded size, search all items in each, and carry their best over to the next block;
only the best of each task are shuffled. Items go to all tasks in blocks of bounded bytes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textprov.llm.arrow import lean
from textprov.llm.flat import LOWER, Piece, pieces, prefix, runs, span_hashes
from textprov.session import materialize

TOP = 10
BLOCK_BYTES = 1 << 20  # of items that are searched in one pass
BLOCK_DOCS = 1 << 13  # vectors of one trie
BLOCK_CELLS = 1 << 24  # vectors of one trie times terms of the longest item
LEAF = 64  # documents of a subtree that is not divided further
CELLS = 64  # parts of the tasks' results that are ranked before all are

# Bytes of a term, besides all from 0x80 on.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def piece_terms(piece: Piece):
    """Hashes of a piece's terms, their spans and texts; A-Z count as a-z."""
    data = LOWER[piece.data]
    starts, ends = runs(TERM[piece.data], piece.offsets)
    return span_hashes(prefix(data), starts, ends), starts, ends, data


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[starts].copy()
    eight[np.arange(8) >= (ends - starts)[:, None]] = 0
    return eight.view(np.uint64)[:, 0]


class Lexicon:
    """Terms by a 64-bit hash, their sizes and their first eight bytes."""

    def __init__(self, terms: list[str]):
        texts = [t.encode() for t in terms]
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        hashes = span_hashes(prefix(data), offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.sizes, self.heads = hashes[self.order], sizes, heads(data, offsets[:-1], offsets[1:])

    def find(self, hashes, starts, ends, data) -> np.ndarray:
        """Number of the term at each span, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        own = self.order[at[hit]]
        same = (self.sizes[own] == ends[hit] - starts[hit]) & (self.heads[own] == heads(data, starts[hit], ends[hit]))
        term = np.full(len(hashes), -1)
        term[hit[same]] = own[same]
        return term


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """``row, item, terms`` with the distinct terms of each row, and the text's size."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    rows = items.select(
        F.monotonically_increasing_id().alias("row"), F.col(item).cast("long").alias("item"),
        F.sort_array(F.array_distinct(found)).alias("terms"), F.octet_length(low).cast("long").alias("size"),
    )
    return materialize(rows, "items")


def restricted(docs: DataFrame, id: str, text: str, terms: list[str]) -> DataFrame:
    """``doc, n, term, tf``: a document's number of terms, and those that items have, with counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        lexicon, n_terms = Lexicon(shared.value), max(len(shared.value), 1)
        for batch in batches:
            ids = batch.column(0)
            for piece in pieces(batch.column(1)):
                hashes, starts, ends, data = piece_terms(piece)
                owner = piece.owner(starts)
                term = lexicon.find(hashes, starts, ends, data)
                n = np.bincount(owner, minlength=piece.n)
                hit = term >= 0
                key, tf = np.unique(owner[hit] * n_terms + term[hit], return_counts=True)
                offsets = np.searchsorted(key, np.arange(piece.n + 1) * n_terms)
                offsets = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(piece.first, piece.n), pa.array(n.astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array((key % n_terms).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                    ],
                    names=["doc", "n", "term", "tf"],
                )

    rows = lean(docs).select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    vectors = rows.mapInArrow(run, "doc long, n long, term array<int>, tf array<long>")
    return materialize(vectors, "vectors")


def frequencies(vectors: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms with repeats, documents by item term."""
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).values.to_numpy(), minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term.astype(np.int32)), pa.array(df[term])], names=["term", "df"]
        )

    total = vectors.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).head()
    rows = vectors.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in rows.collect():  # no more rows than the block's items have terms
        df[row["term"]] = row["df"]
    return total["n"], total["l"] or 0, df


class Trie:
    """Documents of a block by path, with the greatest counts and least ``m`` of every subtree.

    Numbers below ``n_docs`` are documents in the order of their paths, above are inner
    nodes, children before parents; the last is the root.
    """

    def __init__(self, m: np.ndarray, rank: np.ndarray, tf: np.ndarray, offsets: np.ndarray, n_ranks: int):
        n = len(m)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        key = np.lexsort((rank, doc))
        rank, tf = rank[key], tf[key]
        size = np.diff(offsets)
        # Divide level by level: documents of a group, ordered by their term at this depth.
        order = np.arange(n)
        nodes: list[tuple[int, int]] = []
        parts: list[list[int]] = []
        todo = [(0, n, 0, -1)]
        while todo:
            lo, hi, depth, up = todo.pop()
            me = len(nodes)
            nodes.append((lo, hi))
            parts.append([])
            if up >= 0:
                parts[up].append(me)
            # Along the heaviest child all others become children of the same node, so that
            # trunks of frequent terms do not make a deep tree.
            while hi - lo > LEAF:
                own = order[lo:hi]
                here = np.where(depth < size[own], rank[np.minimum(offsets[own] + depth, len(rank) - 1)], -1)
                depth += 1
                if here.min() == here.max():
                    if here[0] < 0:
                        break
                    continue
                by = np.argsort(here, kind="stable")
                order[lo:hi] = own[by]
                cuts = np.flatnonzero(np.r_[True, here[by][1:] != here[by][:-1]])
                spans = [(lo + int(a), lo + int(b)) for a, b in zip(cuts, np.r_[cuts[1:], hi - lo])]
                heavy = max(spans, key=lambda x: x[1] - x[0])
                todo.extend((a, b, depth, me) for a, b in spans if (a, b) != heavy)
                if 2 * (heavy[1] - heavy[0]) <= hi - lo:
                    todo.append((*heavy, depth, me))
                    lo = hi
                else:
                    lo, hi = heavy
            if hi > lo and (lo, hi) != nodes[me]:
                todo.append((lo, hi, depth, me))
        self.order, self.n_docs, self.m = order, n, m[order]
        # Numbers from the deepest on: a child is made after its parent.
        count = len(nodes)
        number = lambda k: n + count - 1 - k
        self.children = [None] * count
        for k, (lo, hi) in enumerate(nodes):
            own = [number(c) for c in parts[k]]
            self.children[count - 1 - k] = np.array(own, np.int64) if own else np.arange(lo, hi)
        least = [int(self.m[lo:hi].min()) for lo, hi in nodes]
        self.least = np.r_[self.m, np.array(least[::-1], np.int64)]
        # Counts by term: of documents, then of leaves, then of nodes above them.
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        node, term, most = [place[doc[key]]], [rank], [tf]
        leaf = np.empty(n, np.int64)
        for k, (lo, hi) in enumerate(nodes):
            if not parts[k]:
                leaf[lo:hi] = number(k)
        up = np.full(n + count, -1)
        for k, own in enumerate(parts):
            up[[number(c) for c in own]] = number(k)
        at, t, v = leaf[node[0]], rank, tf
        while len(at):
            code = at * n_ranks + t
            by = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.r_[True, code[by][1:] != code[by][:-1]])
            at, t, v = at[by][first], t[by][first], np.maximum.reduceat(v[by], first)
            node.append(at)
            term.append(t)
            most.append(v)
            onward = up[at] >= 0
            at, t, v = up[at[onward]], t[onward], v[onward]
        node, term, most = np.concatenate(node), np.concatenate(term), np.concatenate(most)
        # A node that is above leaves of several depths has met each of its terms more than once.
        by = np.lexsort((most, node, term))
        self.node, self.most = node[by], most[by]
        self.starts = np.searchsorted(term[by], np.arange(n_ranks + 1))

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        """Greatest count of each of ``ranks`` below every number; the greatest comes last."""
        out = np.zeros((len(self.least), len(ranks)), np.int64)
        for k, r in enumerate(ranks):
            span = slice(self.starts[r], self.starts[r + 1])
            out[self.node[span], k] = self.most[span]
        return out

    def search(self, ranks: np.ndarray, weight: np.ndarray, best: list, ids, top: int) -> int:
        """Put the block's best into ``best``, a heap of ``top``; gives how many scores were computed."""
        counts = self.counts(ranks)
        seen = 0

        def bound(own: np.ndarray) -> np.ndarray:
            tf = counts[own]
            return (weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.least[own][:, None]))).sum(axis=1)

        root = len(self.least) - 1
        stack = [(int(bound(np.array([root]))[0]), root)]
        while stack:
            most, at = stack.pop()
            if most <= 0 or (len(best) == top and most < best[0][0]):
                continue
            own = self.children[at - self.n_docs]
            scores = bound(own)
            seen += len(own)
            least = best[0][0] if len(best) == top else 1
            keep = np.flatnonzero(scores >= max(least, 1))
            if own[0] < self.n_docs:
                for k in keep:
                    entry = (int(scores[k]), ids(self.order[own[k]]))
                    if len(best) < top:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            else:
                keep = keep[np.argsort(scores[keep], kind="stable")]
                stack.extend(zip(scores[keep].tolist(), own[keep].tolist()))
        return seen


def best_by_task(vectors: DataFrame, m_of: tuple[int, int], rank: np.ndarray, items: list, top: int) -> DataFrame:
    """``row, item, doc, score, cell``: each task's best of every item.

    ``items`` holds ``row, item, ranks, weights``. Equal scores rank by least id, none last.
    """
    n_docs, all_terms = m_of
    share = vectors.sparkSession.sparkContext.broadcast((rank, items))
    longest = max((len(i[2]) for i in items), default=1) or 1
    block = max(1, min(BLOCK_DOCS, BLOCK_CELLS // longest))

    def run(batches):
        rank, items = share.value
        best = [[] for _ in items]

        def searched(held):
            t = pa.Table.from_batches(held)
            term, tf = t.column("term").combine_chunks(), t.column("tf").combine_chunks()
            offsets = term.offsets.to_numpy().astype(np.int64)
            spread = slice(offsets[0], offsets[-1])
            m = 10 + (90 * t.column("n").to_numpy() * n_docs) // all_terms
            doc = t.column("doc").combine_chunks()
            # Heaps keep the greatest: less negative ids first, none last.
            back = -doc.fill_null(0).to_numpy(zero_copy_only=False)
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            ids = lambda i: (bool(known[i]), int(back[i]))
            trie = Trie(
                m, rank[term.values.to_numpy()[spread]], tf.values.to_numpy()[spread], offsets - offsets[0], len(rank)
            )
            for heap, (_, _, ranks, weights) in zip(best, items):
                if len(ranks):
                    trie.search(ranks, weights, heap, ids, top)

        held, rows = [], 0
        for batch in batches:
            while rows + batch.num_rows >= block:
                searched([*held, batch.slice(0, block - rows)])
                batch, held, rows = batch.slice(block - rows), [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if held:
            searched(held)
        out = [
            (row, item, -back if known else None, score)
            for heap, (row, item, _, _) in zip(best, items) for score, (known, back) in heap
        ]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["row", "item", "doc", "score"]
        )

    found = vectors.where(F.size("term") > 0).mapInArrow(run, "row long, item long, doc long, score long")
    return found.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(CELLS)))


def ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_items(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item, rank, id, score``: the ``top`` highest scores above 0 of each row of ``items``.

    Equal scores rank by ascending id, null ids last.

    Defined results: a null or empty text has no terms, is no document of the statistics
    and is never found; an item without terms, or with none that a document holds, has no
    rows; rows of ``items`` that repeat are items of their own, and rows of ``docs`` that repeat
    are documents of their own; null ids are kept; other columns are not looked at; empty
    tables give an empty result. Ids are whole numbers. Texts may be very long: working
    memory is in proportion to the longest one.
    """
    spark = docs.sparkSession
    own = item_terms(items, item, item_text)
    size = own.agg(F.sum("size")).head()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    results = None
    for block in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        rows = part.select("row", "item", "terms").collect()  # about block_bytes, or one item
        terms = sorted({t for r in rows for t in r["terms"]})
        if not terms:
            continue
        vectors = restricted(docs, id, text, terms)
        n, all_, df = frequencies(vectors, len(terms))
        if not all_:
            continue
        by = np.lexsort((np.arange(len(terms)), -df))  # frequent terms first
        rank = np.empty(len(terms), np.int64)
        rank[by] = np.arange(len(terms))
        number = {t: k for k, t in enumerate(terms)}
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
        given = []
        for r in rows:
            known = np.array([k for k in (number[t] for t in r["terms"]) if df[k] > 0 and weight[k] > 0], np.int64)
            given.append((r["row"], r["item"], rank[known], weight[known]))
        found = best_by_task(vectors, (n, all_), rank, given, top)
        found = ranked(found, ["row", "item", "cell"], top).drop("rank", "cell")
        found = materialize(ranked(found, ["row", "item"], top), "found")
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = spark.createDataFrame([], "row long, item long, doc long, score long, rank int")
    return results.select(F.col("item").alias(item), "rank", F.col("doc").alias(id), "score")
