"""Pooling of vectors and exact nearest neighbours."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from textprov.functions.draws import uniform
from textprov.functions.vectors import dot
from textprov.operators.skew import null_safe_join
from textprov.session import lean

POOL_FLOOR = 1e-9  # fixed value: smallest divisor of a pooled vector
BROADCAST_BYTES = 64 << 20  # query vectors up to this size go to every task
SCAN_BYTES = 8 << 20  # vectors of the corpus that a task multiplies at once
TILE_BYTES = 32 << 20  # vectors of a tile, as doubles
PRODUCTS = 1 << 28  # of a task, where the corpus is dealt out for a scan


def mean_pool(df: DataFrame, key: str, vec: str, mask: str) -> DataFrame:
    """``key, pooled``: mean of the vectors whose mask is set; zeros if none is.

    A null key is a key like any other; null vectors count for nothing.

    Vectors are summed where they are read, so a hot key costs one vector per task.
    """
    as_vector = array_to_vector(F.col(vec).cast("array<double>"))
    m = F.col(mask).cast("double")
    sums = df.groupBy(key).agg(
        F.max(F.size(vec)).alias("dim"),
        F.sum(F.when(F.col(vec).isNotNull(), m)).alias("weight"),
    )
    pooled = (
        df.where((m > 0) & F.col(vec).isNotNull())
        .groupBy(key)
        .agg(Summarizer.metrics("sum").summary(as_vector, m).alias("s"))
        .select(key, vector_to_array("s.sum").alias("total"))
    )
    total = F.coalesce("total", F.array_repeat(F.lit(0.0), F.col("dim")))
    floor = F.greatest("weight", F.lit(POOL_FLOOR))
    return null_safe_join(sums, pooled, [key], "left").select(
        key, F.transform(total, lambda x: x / floor).alias("pooled")
    )


def pair_dot(pairs: DataFrame, a: str, b: str, name: str = "dot") -> DataFrame:
    return pairs.withColumn(name, dot(a, b))


def _top_k(k: int, exclude_self: bool, digits: int):
    """Numpy helpers, nested so that tasks need nothing but this closure."""
    import numpy as np

    BLOCK = 512  # queries of a product; the corpus side is eight times as many

    def keys(column):
        ids = column.to_numpy(zero_copy_only=False)
        return ids.astype("U") if ids.dtype == object else ids

    def matrix(column):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype("float64")

    def fold(best_s, best_c, rows, q_ids, q_vec, span, c_ids, c_vec, order):
        """Let the corpus rows of ``span``, sorted by id, compete for the best ``k`` of ``rows``.

        ``best_s`` and ``best_c`` hold each query's best so far, greatest first. Only products
        that reach the last of them are looked at, so a block is a product and a comparison.
        """
        for i in range(0, len(rows), BLOCK):
            r = rows[i : i + BLOCK]
            vec, ids = q_vec[r], q_ids[r]
            for lo in range(span[0], span[1], 8 * BLOCK):
                hi = min(lo + 8 * BLOCK, span[1])
                sim = vec @ c_vec[lo:hi].T
                if exclude_self:
                    left = np.searchsorted(c_ids[lo:hi], ids, "left")
                    right = np.searchsorted(c_ids[lo:hi], ids, "right")
                    for at in np.flatnonzero(right > left):
                        sim[at, left[at] : right[at]] = -np.inf
                floor = best_s[r, -1]
                if sim.shape[1] > k and np.isneginf(floor).any():
                    floor = np.fmax(floor, np.round(-np.partition(-sim, k - 1, axis=1)[:, k - 1], digits))
                # Products are rounded where they are compared closely.
                row, col = np.nonzero((sim >= (floor - 2 * 10.0**-digits)[:, None]) & (sim > -np.inf))
                if not len(row):
                    continue
                s = np.round(sim[row, col], digits)
                met = np.unique(row)
                old_s, old_c = best_s[r[met]], best_c[r[met]]
                held, place = np.nonzero(old_s > -np.inf)
                row = np.concatenate([met[held], row])
                s = np.concatenate([old_s[held, place], s])
                col = np.concatenate([old_c[held, place], col + lo])
                by = np.lexsort((order[col], -s, row))
                row, s, col = row[by], s[by], col[by]
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
                keep = rank < k
                best_s[r[row[keep]], rank[keep]] = s[keep]
                best_c[r[row[keep]], rank[keep]] = col[keep]

    def empty(n):
        return np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def found(best_s, best_c, q_ids, c_ids):
        row, place = np.nonzero(best_s > -np.inf)
        return q_ids[row], c_ids[best_c[row, place]], best_s[row, place]

    def top(q_ids, q_vec, c_ids, c_vec):
        by = np.argsort(c_ids, kind="stable")
        c_ids, c_vec = c_ids[by], c_vec[by]
        kept = empty(len(q_ids))
        fold(*kept, np.arange(len(q_ids)), q_ids, q_vec, (0, len(c_ids)), c_ids, c_vec, np.arange(len(c_ids)))
        return found(*kept, q_ids, c_ids)

    def best(q, c, s):
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = rank < k
        return q[keep], c[keep], s[keep]

    def by_cells(q_ids, q_vec, starts, cells, c_ids, c_vec, cell):
        """As ``top``, where a query meets the corpus rows of its own ``cells`` only."""
        by = np.lexsort((c_ids, cell))
        c_ids, c_vec, cell = c_ids[by], c_vec[by], cell[by]
        order = np.unique(c_ids, return_inverse=True)[1]
        row = np.repeat(np.arange(len(q_ids)), np.diff(starts))
        asked = np.argsort(cells, kind="stable")
        row, cells = row[asked], cells[asked]
        kept = empty(len(q_ids))
        for x in np.unique(cell):
            rows = row[np.searchsorted(cells, x, "left") : np.searchsorted(cells, x, "right")]
            span = tuple(int(np.searchsorted(cell, x, side)) for side in ("left", "right"))
            fold(*kept, rows, q_ids, q_vec, span, c_ids, c_vec, order)
        return found(*kept, q_ids, c_ids)

    return keys, matrix, top, best, by_cells


def _scan_corpus(shared, k: int, exclude_self: bool, digits: int):
    """Per task: stream the corpus once and keep the best ``k`` of every query."""
    keys, matrix, top, best, _ = _top_k(k, exclude_self, digits)

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        q_ids, q_vec = shared.value
        kept, held, size = None, [], 0

        def merged():
            rows = pa.Table.from_batches(held).combine_chunks()
            part = top(q_ids, q_vec, keys(rows["id"].combine_chunks()), matrix(rows["vec"].combine_chunks()))
            return part if kept is None else best(*map(np.concatenate, zip(kept, part)))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= SCAN_BYTES:
                kept = merged()
                held, size = [], 0
        if held:
            kept = merged()
        if kept is not None:
            # Ids that repeat among the queries share their best.
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in best(*kept)], names=["query_id", "id", "sim"]
            )

    return scan


def _match_tiles(k: int, exclude_self: bool, digits: int):
    """Per pair of tiles: the best ``k`` of the corpus tile for each query."""
    keys, matrix, top, best, _ = _top_k(k, exclude_self, digits)

    def match(queries, corpus):
        import numpy as np
        import pyarrow as pa

        if queries.num_rows and corpus.num_rows:
            q, c, s = best(*top(
                keys(queries["id"].combine_chunks()),
                matrix(queries["vec"].combine_chunks()),
                keys(corpus["id"].combine_chunks()),
                matrix(corpus["vec"].combine_chunks()),
            ))
        else:
            q, c, s = queries["id"][:0], corpus["id"][:0], np.zeros(0)
        return pa.table({"query_id": q, "id": c, "sim": s})

    return match


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    vec: str = "vec",
    id: str = "id",
    exclude_self: bool = True,
    digits: int = 9,
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_rows: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest by dot product: ``query_id, id, sim, rank`` (rank from 1).

    Vectors have unit length; ties (after ``digits``) go to the smaller id. The size
    of the query side is measured. If it is small it is sent to every task and the
    corpus is read in place, or dealt out once where the products are many. If not, both
    sides are cut into tiles of ``tile_rows``, by default of ``TILE_BYTES``, so that a vector
    travels once for each tile of the other side. Either way a task returns
    ``k`` rows per query, never the pairs. The tiles of a large query side are all pairs
    of both sides: for a whole corpus against itself take ``neighbours.knn_approx``.

    Rows without a vector, or with an empty one, take no part; vectors of another
    length than the rest are an error.
    """
    q, c = _vectors_of(queries, id, vec), _vectors_of(corpus, id, vec)
    out = q.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("sim")).schema
    n, dim, id_bytes = _extent(q)
    n_corpus, c_dim, _ = (n, dim, 0) if corpus is queries else _extent(c)
    if n and c_dim not in (0, dim):
        raise ValueError("queries and corpus have vectors of different lengths")
    if n * (dim * 8 + id_bytes) <= broadcast_bytes:
        tasks = math.ceil(n * n_corpus / PRODUCTS)
        found = _knn_broadcast(q, c.repartition(tasks) if tasks > 1 else c, k, exclude_self, digits, out)
    else:
        c_rows = tile_rows or _tile_rows(q, max(n, n_corpus), dim)
        q_rows = max(1, min(c_rows, broadcast_bytes // max(1, dim * 8)))
        found = _knn_tiles(q, c, k, exclude_self, digits, out, q_rows, c_rows, n, n_corpus)
    return _ranked(found, k)


def _tile_rows(df: DataFrame, n: int, dim: int) -> int:
    """Rows of a tile: of bounded size, and so few that the pairs of tiles keep all cores busy."""
    busy = math.ceil(n / math.ceil(math.sqrt(2 * df.sparkSession.sparkContext.defaultParallelism)))
    return max(1, min(TILE_BYTES // max(1, dim * 8), max(4096, busy)))


def _vectors_of(df: DataFrame, id: str, vec: str) -> DataFrame:
    return df.where(F.size(vec) > 0).select(F.col(id).alias("id"), F.col(vec).alias("vec"))


def _extent(df: DataFrame) -> tuple[int, int, int]:
    """Rows, length of the vectors, and the bytes that an id takes in an array of ids."""
    longest = F.max(F.length(F.col("id").cast("string"))) * 4  # ids of one width
    size = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"),
        F.max(F.size("vec")).alias("dim"), longest.alias("id"),
    ).first()
    if size["least"] != size["dim"]:
        raise ValueError(f"vectors of {size['least']} to {size['dim']} values")
    return size["n"], size["dim"] or 0, size["id"] or 0


def _knn_broadcast(q, c, k, exclude_self, digits, out):
    table = q.toArrow()
    if not table.num_rows:
        return q.sparkSession.createDataFrame([], out)
    keys, matrix, *_ = _top_k(k, exclude_self, digits)
    ids, vec = keys(table["id"].combine_chunks()), matrix(table["vec"].combine_chunks())
    shared = q.sparkSession.sparkContext.broadcast((ids, vec))
    return lean(c).mapInArrow(_scan_corpus(shared, k, exclude_self, digits), out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _drawn_place(tag: str, n):
    """A place of a row in ``range(n)``, by draw. Doubles, since a draw times 2048 is past a long."""
    return F.floor(uniform(tag, F.col("id")) * n)


def _tile(tag: str, tiles):
    """The tile of a row, by draw."""
    return _drawn_place(tag, tiles).cast("int")


def _each(tiles):
    return F.explode(F.sequence(F.lit(0), tiles - 1))


def _match(left, right, keys, pairs: int, match, out):
    """``match`` the rows of equal ``keys``, of which there are ``pairs``.

    Their number fixes the tasks: by their bytes, many products would meet in a task.
    """
    tasks = min(4 * pairs, max(pairs, 2000))
    left, right = (df.repartition(tasks, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, out)


def _knn_tiles(q, c, k, exclude_self, digits, out, q_rows, c_rows, n_queries, n_corpus):
    n_q, n_c = max(1, math.ceil(n_queries / q_rows)), max(1, math.ceil(n_corpus / c_rows))
    q_tiles, c_tiles = F.lit(n_q), F.lit(n_c)
    left = q.withColumn("qt", _tile("query", q_tiles)).withColumn("ct", _each(c_tiles))
    right = c.withColumn("ct", _tile("corpus", c_tiles)).withColumn("qt", _each(q_tiles))
    return _match(left, right, ["qt", "ct"], n_q * n_c, _match_tiles(k, exclude_self, digits), out)


def knn_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n, recall``: the share of exact neighbours that were found."""
    hits = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")
    )
