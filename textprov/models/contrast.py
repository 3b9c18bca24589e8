"""Text vectors trained by the supervised contrastive loss.

A vector is the unit-length projection of a text's sparse row. Every batch of the plan is
taken by one task, which has the batch's loss and its gradient with respect to the texts'
projections; each text's gradient goes to the features it has. The sums over all batches are
whole numbers, as in ``sparse``, so training repeats on any partitioning, and the driver steps
the projection, ``n_features`` times ``dimensions`` numbers, by Adam.
"""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textprov.models.sparse import (
    BETA1, BETA2, EPSILON, VALUE, WEIGHT, _blocks, _hashing, hashed_rows,
)
from textprov.operators.batches import balanced_batches, fetch_rows
from textprov.operators.losses import TEMPERATURE, _each_group
from textprov.session import lean, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not import this package

N_FEATURES = 1 << 14
DIMENSIONS = 32
GRADIENT = 1 << 24  # of a text's gradient
START = 0.01  # size of the first projection; features that are never met keep it


class Embedder(NamedTuple):
    """The projection as whole numbers; the constant has none."""

    n_features: int
    projection: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, v.tolist()) for i, v in enumerate(self.projection)]
        spark.createDataFrame(rows, "feature long, vec array<long>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedder:
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return cls(len(rows) - 1, np.array([r["vec"] for r in rows], np.int64))


class Epoch(NamedTuple):
    step: int
    loss: float


def _unit():
    def unit(z):
        import numpy as np

        size = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return z / np.maximum(size, 1e-12), size

    return unit


def _batch_gradient(tau: float):
    """Sum of a batch's losses and its gradient by the texts' projections."""
    unit = _unit()

    def gradient(z, label):
        import numpy as np

        u, size = unit(z)
        e = np.exp(u @ u.T / tau)
        same = label[:, None] == label[None, :]
        counted = same & ~np.eye(len(z), dtype=bool)
        # What is masked adds exp(0).
        pos = np.where(counted, e, 1.0).sum(axis=1)
        all_ = pos + np.where(same, 1.0, e).sum(axis=1)
        loss = np.log(all_ / pos)
        by = (e / tau) / all_[:, None]
        by = np.where(counted, by - (e / tau) / pos[:, None], np.where(same, 0.0, by))
        du = (by + by.T) @ u
        dz = (du - (du * u).sum(axis=1, keepdims=True) * u) / np.maximum(size, 1e-12)
        return np.where(size > 0, dz, 0.0), loss

    return gradient


def batched_rows(essays: DataFrame, n_features: int, batch_size: int, seed=42, n_batches: int | None = None) -> DataFrame:
    """Stored sparse rows of class-balanced batches, each batch in one place."""
    plan = materialize(balanced_batches(essays, batch_size, seed, n_batches), "batches")
    rows = materialize(hashed_rows(essays, n_features, "text", ["id", "generated"]), "rows")
    met = fetch_rows(plan.select("batch_id", "id"), rows).select("batch_id", "id", "generated", "_idx", "_val")
    met = met.where("batch_id is not null")
    return materialize(met.repartition("batch_id").sortWithinPartitions("batch_id", "id"), "batched")


def gradient_sums(rows: DataFrame, projection: np.ndarray, tau: float):
    """Sums by feature and dimension over all batches, the mean loss, and the number of texts."""
    shared = rows.sparkSession.sparkContext.broadcast(projection)
    gradient, (slices, products) = _batch_gradient(tau), _blocks()
    size, dim = projection.shape
    state: dict = {}

    def batch_sums(table):
        import numpy as np
        import pyarrow as pa

        if "sums" not in state:
            state["sums"], state["loss"] = np.zeros((size, dim), np.int64), np.zeros(2, np.int64)
        batch = table.combine_chunks().to_batches()[0]
        parts = list(slices(batch))
        z = np.concatenate([products(shared.value, starts, idx, val) for _, _, starts, idx, val in parts])
        dz, loss = gradient(z, batch.column("generated").to_numpy())
        dz = np.floor(dz * GRADIENT + 0.5).astype(np.int64)
        for i, j, starts, idx, val in parts:
            np.add.at(state["sums"], idx, np.repeat(dz[i:j], np.diff(starts), axis=0) * val[:, None])
        state["loss"] += [int(np.floor(loss * WEIGHT + 0.5).sum()), len(loss)]
        return pa.table({"feature": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.int64()))})

    groups = _each_group(("batch_id",), batch_sums)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        state.clear()
        yield from groups(batches)
        if "sums" in state:
            sums = state["sums"]
            met = np.flatnonzero(sums.any(axis=1))
            rest = np.zeros(dim, np.int64)
            rest[: min(2, dim)] = state["loss"][: min(2, dim)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[met, size]), pa.array([*sums[met].tolist(), rest.tolist()], pa.list_(pa.int64()))],
                names=["feature", "s"],
            )

    found = lean(rows).mapInArrow(run, "feature long, s array<long>")
    each = [F.sum(F.col("s")[k].cast("decimal(38,0)")).cast("double").alias(f"s{k}") for k in range(dim)]
    t = found.groupBy("feature").agg(*each).toArrow()  # a row for each feature at most
    shared.destroy()
    sums = np.zeros((size + 1, dim))
    at = t.column("feature").to_numpy()
    for k in range(dim):
        sums[at, k] = t.column(f"s{k}").to_numpy()
    total, n = sums[size, 0] / WEIGHT, sums[size, 1]
    sums[size - 1] = 0  # the constant has no projection
    return sums[:size] / (float(VALUE) * GRADIENT * max(n, 1)), total / max(n, 1), int(n)


def fit_contrastive(
    essays: DataFrame,
    n_features: int = N_FEATURES,
    dimensions: int = DIMENSIONS,
    batch_size: int = 64,
    steps: int = 20,
    rate: float = 0.02,
    tau: float = TEMPERATURE,
    parts: int = 1,
    seed=42,
    n_batches: int | None = None,
) -> tuple[Embedder, list[Epoch]]:
    """Fit on ``id, text, prompt_id, generated``: the model, and the loss before each step.

    A step takes all batches, or with ``parts`` every so many-th in turn. ``dimensions`` is at
    least 2. Texts of a class are drawn together, those of the other pushed apart.
    """
    if dimensions < 2:
        raise ValueError("a vector needs at least two dimensions")
    rows = batched_rows(essays, n_features, batch_size, seed, n_batches)
    start = START * np.random.default_rng(7).normal(size=(n_features + 1, dimensions))
    start[n_features] = 0
    p, m, v, log = start, np.zeros_like(start), np.zeros_like(start), []
    whole = lambda: np.floor(p * WEIGHT + 0.5).astype(np.int64)
    for step in range(1, steps + 1):
        own = rows if parts == 1 else rows.where(F.pmod(F.col("batch_id"), F.lit(parts)) == step % parts)
        g, loss, n = gradient_sums(own, whole(), tau)
        if not n:
            continue
        log.append(Epoch(step, float(loss)))
        m = BETA1 * m + (1 - BETA1) * g
        v = BETA2 * v + (1 - BETA2) * (g * g)
        p = p - rate * (m / (1 - math.pow(BETA1, step))) / (np.sqrt(v / (1 - math.pow(BETA2, step))) + EPSILON)
    return Embedder(n_features, whole()), log


def embed_learned(model: Embedder, df: DataFrame, text: str = "text", name: str = "vec") -> DataFrame:
    """Add ``vec`` of unit length; zeros for a text without words.

    Sparse rows are multiplied where they are made, so a task needs one Python worker and they do not travel.
    """
    listed, hashed, sparse = _hashing(df, model.n_features, text, df.columns)
    shared = df.sparkSession.sparkContext.broadcast(model.projection)
    unit, (slices, products) = _unit(), _blocks()
    kept = sparse.fields[:-2]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in hashed(batches):
            z = np.concatenate([products(shared.value, starts, idx, val) for _, _, starts, idx, val in slices(batch)])
            u = unit(z)[0]
            offsets = pa.array(np.arange(0, u.size + 1, u.shape[1], dtype=np.int32))
            vec = pa.ListArray.from_arrays(offsets, pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], vec], names=schema.names)

    return lean(listed).mapInArrow(run, schema)
