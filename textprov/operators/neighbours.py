"""Approximate neighbours by an inverted file of learned cells.

Cells are the directions that k-means finds on a bounded sample. Every vector of the corpus
is in the cell of the centroid it is most like, and a query is compared with the vectors of
the ``probes`` cells it is most like. The number of cells is the square root of the number
of vectors, so the share of products falls as vectors are added, and ``probes`` is measured:
the fewest cells that hold the wanted share of the exact neighbours of a sample of queries.
Vectors without structure need most cells, and ``knn_work`` says so.

Centroids and the vectors that are compared with them are whole numbers, so that sums do not
depend on their order and cells are the same on any partitioning and in any engine.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import DataFrame, functions as F

from textprov.functions.draws import DRAW_BITS, draw
from textprov.operators.vectors import (
    _drawn_place, _each, _extent, _match, _ranked, _tile, _tile_rows, _top_k, _vectors_of, knn,
)
from textprov.session import lean

if TYPE_CHECKING:
    import numpy as np

SCALE = 1 << 15  # of the whole numbers
SAMPLE_BYTES = 128 << 20  # vectors that cells are learned from
PER_CELL = 32  # sampled vectors of a cell
LEAST_PER_CELL = 8  # where SAMPLE_BYTES leaves fewer, there are fewer cells
ROUNDS = 3
QUERIES = 256  # sampled queries that ``probes`` is measured on
BROADCAST_BYTES = 64 << 20  # of all centroids


class CellIndex(NamedTuple):
    """Centroids as rows of whole numbers, and how many cells a query is compared with."""

    centroids: np.ndarray
    probes: int


def _cell_helpers():
    """Numpy helpers, nested so that tasks need nothing but this closure."""
    import numpy as np

    def whole(vec):
        return np.floor(vec * SCALE + 0.5)

    def nearest(vec, centroids, n: int):
        """The ``n`` cells most like each vector, best first; ties go to the smaller cell."""
        out = np.empty((len(vec), n), np.int32)
        step = max(1, (1 << 20) // max(1, len(centroids)))
        for i in range(0, len(vec), step):
            like = whole(vec[i : i + step]) @ centroids.T.astype("float64")
            out[i : i + step] = (
                like.argmax(axis=1)[:, None] if n == 1 else np.argsort(-like, axis=1, kind="stable")[:, :n]
            )
        return out

    return whole, nearest


def _sampled(df: DataFrame, n: int, wanted: int, seed) -> DataFrame:
    """About ``wanted`` of ``n`` rows, by draw of the id."""
    drawn = df.withColumn("_draw", draw(seed, F.col("id")))
    if wanted >= n:
        return drawn
    return drawn.where(F.col("_draw") < math.floor((1 << DRAW_BITS) * wanted / n))


def _matrix(df: DataFrame, dim: int):
    import numpy as np

    t = df.toArrow()
    _, matrix, *_ = _top_k(1, False, 9)
    if not t.num_rows:
        return t, np.zeros((0, dim))
    return t, matrix(t["vec"].combine_chunks())


def learn_cells(sample: DataFrame, dim: int, n_cells: int, rounds: int = ROUNDS):
    """Centroids of spherical k-means that starts from the first vectors by draw."""
    import numpy as np

    whole, nearest = _cell_helpers()
    # One row has the least draw, so the order is total.
    rows, vec = _matrix(sample.orderBy("_draw", "id"), dim)
    if not len(vec):
        return np.zeros((0, dim), np.int64)
    points = whole(vec)
    centroids = points[:n_cells].copy()
    for _ in range(rounds):
        own = nearest(vec, centroids, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        cells, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(points[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids[cells] = np.where(norm > 0, np.floor(SCALE * sums / np.maximum(norm, 1) + 0.5), 0)
    return centroids.astype(np.int64)


def fit_index(
    corpus: DataFrame,
    k: int = 5,
    target: float = 0.95,
    n_cells: int | None = None,
    probes: int | None = None,
    rounds: int = ROUNDS,
    vec: str = "vec",
    id: str = "id",
    seed=0,
) -> CellIndex:
    """Learn cells, and measure how many of them hold ``target`` of the ``k`` nearest.

    Cells come from a sample of at most ``SAMPLE_BYTES``, ``probes`` from about ``QUERIES`` vectors
    of the corpus and their exact neighbours. Both samples are drawn by id.
    """
    import numpy as np

    c = _vectors_of(corpus, id, vec)
    n, dim, _ = _extent(c)
    if n_cells is None:
        room = max(1, min(SAMPLE_BYTES // LEAST_PER_CELL, BROADCAST_BYTES) // (8 * max(dim, 1)))
        n_cells = max(1, min(math.ceil(math.sqrt(n)), room))
    wanted = min(PER_CELL * n_cells, max(1, SAMPLE_BYTES // (8 * max(dim, 1))))
    centroids = learn_cells(_sampled(c, n, wanted, f"{seed}:cells"), dim, n_cells, rounds)
    if probes is not None or not n:
        return CellIndex(centroids, max(1, min(probes or 1, max(len(centroids), 1))))
    asked = _sampled(c, n, QUERIES, f"{seed}:ask").drop("_draw")
    found = knn(asked, c, k).select("query_id", "id")
    pairs = found.toArrow()  # at most about QUERIES * k rows, as are the vectors below
    if not pairs.num_rows:
        return CellIndex(centroids, 1)
    near = found.select("id").distinct()
    there, there_vec = _matrix(c.join(F.broadcast(near), "id", "left_semi"), dim)
    here, here_vec = _matrix(asked, dim)
    _, nearest = _cell_helpers()
    order = nearest(here_vec, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids), dtype=order.dtype)[None, :], axis=1)
    own = dict(zip(there["id"].to_pylist(), nearest(there_vec, centroids, 1)[:, 0].tolist()))
    row = {q: i for i, q in enumerate(here["id"].to_pylist())}
    needed = sorted(
        int(place[row[q], own[i]]) + 1
        for q, i in zip(pairs["query_id"].to_pylist(), pairs["id"].to_pylist())
    )
    return CellIndex(centroids, needed[math.ceil(target * len(needed)) - 1])


def _placed(df: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """``id, vec, cell``: a row for each of the cells a vector is most like."""
    shared = df.sparkSession.sparkContext.broadcast(index.centroids)
    _, nearest = _cell_helpers()
    _, matrix, *_ = _top_k(1, False, 9)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = nearest(matrix(batch.column("vec")), shared.value, probes)
            offsets = pa.array(range(0, cells.size + 1, probes), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel(), pa.int32()))],
                names=[*batch.schema.names, "cells"],
            )

    schema = df.withColumn("cells", F.lit(None).cast("array<int>")).schema
    return lean(df).mapInArrow(place, schema).select("id", "vec", F.explode("cells").alias("cell"))


def knn_approx(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    index: CellIndex | None = None,
    vec: str = "vec",
    id: str = "id",
    exclude_self: bool = True,
    digits: int = 9,
    tile_rows: int | None = None,
) -> DataFrame:
    """Near neighbours among the vectors of a query's cells: ``query_id, id, sim, rank``.

    Similarities are exact; a neighbour in a cell that is not probed is missed. Without an
    ``index``, one is fitted on the corpus. The corpus is laid out cell by cell and cut into tiles
    of ``tile_rows``, so a cell that holds a third of all texts is many tiles; its texts are all
    compared. A query goes once to each tile that holds any of its cells, however many, and
    every tile is one set of tasks of bounded size. Rows without a vector take no part.
    """
    import numpy as np

    index = index or fit_index(corpus, k, vec=vec, id=id)
    q, c = _vectors_of(queries, id, vec), _vectors_of(corpus, id, vec)
    out = q.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim")).schema
    if not len(index.centroids):
        return _ranked(q.sparkSession.createDataFrame([], out), k)
    right = _placed(c, index, 1)
    n, dim, _ = _extent(q)
    counts = np.zeros(len(index.centroids), np.int64)
    for cell, count in right.groupBy("cell").count().toLocalIterator():  # one row a cell
        counts[cell] = count
    total = int(counts.sum())
    if not n or not total:
        return _ranked(q.sparkSession.createDataFrame([], out), k)
    rows = tile_rows or _tile_rows(q, max(n, total), dim)
    n_q, n_c = max(1, math.ceil(n / rows)), max(1, math.ceil(total / rows))
    starts = np.cumsum(counts) - counts
    cells = q.sparkSession.createDataFrame(
        [(i, int(starts[i]), int(counts[i])) for i in np.flatnonzero(counts).tolist()], "cell int, start long, count long"
    )
    place = F.col("start") + _drawn_place("corpus", F.col("count"))
    right = right.join(F.broadcast(cells), "cell").select(
        "id", "vec", "cell", F.floor(place * n_c / F.lit(total)).cast("int").alias("ct"),
        _each(F.lit(n_q)).alias("qt"),
    )
    left = _asked(q, index, starts, counts, n_c).withColumn("qt", _tile("query", F.lit(n_q)))
    match = _match_cells(k, exclude_self, digits)
    return _ranked(_match(left, right, ["qt", "ct"], n_q * n_c, match, out), k)


def _asked(df: DataFrame, index: CellIndex, starts, counts, n_tiles: int) -> DataFrame:
    """``id, vec, cells, ct``: a row for each tile that holds some of the cells a vector asks for."""
    import numpy as np

    total = int(counts.sum())
    first, last = starts * n_tiles // total, np.maximum(starts + counts - 1, 0) * n_tiles // total
    last = np.where(counts > 0, last, -1)  # an empty cell is in no tile
    shared = df.sparkSession.sparkContext.broadcast((index.centroids, first, last))
    _, nearest = _cell_helpers()
    _, matrix, *_ = _top_k(1, False, 9)
    probes = index.probes

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        centroids, first, last = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = nearest(matrix(batch.column("vec")), centroids, probes)
            for t in range(n_tiles):
                here = (first[cells] <= t) & (t <= last[cells])
                each = here.sum(axis=1)
                some = np.flatnonzero(each)
                if len(some):
                    offsets = pa.array(np.r_[0, np.cumsum(each[some])].astype(np.int32))
                    asked = pa.ListArray.from_arrays(offsets, pa.array(cells[here], pa.int32()))
                    part = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, asked, pa.array(np.full(len(some), t, np.int32))],
                        names=[*batch.schema.names, "cells", "ct"],
                    )

    schema = df.withColumns({"cells": F.lit(None).cast("array<int>"), "ct": F.lit(0)}).schema
    return lean(df).mapInArrow(ask, schema)


def _match_cells(k: int, exclude_self: bool, digits: int):
    """Per pair of tiles: the best ``k`` for each query among the corpus rows of its cells."""
    keys, matrix, _, best, by_cells = _top_k(k, exclude_self, digits)

    def match(queries, corpus):
        import numpy as np
        import pyarrow as pa

        if queries.num_rows and corpus.num_rows:
            asked = queries["cells"].combine_chunks()
            q, c, s = best(*by_cells(
                keys(queries["id"].combine_chunks()), matrix(queries["vec"].combine_chunks()),
                np.r_[0, np.cumsum(asked.value_lengths().to_numpy())], asked.flatten().to_numpy(),
                keys(corpus["id"].combine_chunks()), matrix(corpus["vec"].combine_chunks()),
                corpus["cell"].combine_chunks().to_numpy(),
            ))
        else:
            q, c, s = queries["id"][:0], corpus["id"][:0], np.zeros(0)
        return pa.table({"query_id": q, "id": c, "sim": s})

    return match


def knn_work(
    queries: DataFrame, corpus: DataFrame, index: CellIndex, vec: str = "vec", id: str = "id"
) -> DataFrame:
    """``cells, probes, products, share``: products compared, and their share of all pairs."""
    q, c = _vectors_of(queries, id, vec), _vectors_of(corpus, id, vec)
    pairs = q.count() * c.count()
    if not len(index.centroids):
        products = q.where("false").agg(F.count(F.lit(1)).alias("products"))
    else:
        count = lambda df, name: df.groupBy("cell").agg(F.count(F.lit(1)).alias(name))
        met = count(_placed(q, index, index.probes), "q").join(count(_placed(c, index, 1), "c"), "cell")
        products = met.agg(F.coalesce(F.sum(F.col("q") * F.col("c")), F.lit(0)).alias("products"))
    return products.select(
        F.lit(len(index.centroids)).alias("cells"), F.lit(index.probes).alias("probes"), "products",
        (F.col("products") / F.lit(float(max(1, pairs)))).alias("share"),
    )
