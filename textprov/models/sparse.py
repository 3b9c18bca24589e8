"""Linear models on hashed words, trained by whole-number sums that repeat exactly.

A text is a sparse row: words and pairs of neighbouring words are hashed by draw to
``n_features`` places, counts become ``1 + ln`` of them, and the row has unit length; all as
whole numbers. An iteration is one scan of the stored rows: tasks multiply rows with the
weights of all settings that are still trained, and return one row of sums for each
feature they met. Weights, products and sums are whole numbers too, so neither the
partitioning nor the order of tasks changes a bit of the result. The driver holds the
weights, a few numbers for each feature and setting, and steps them by Adam.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from textprov.functions.draws import DRAW_BITS
from textprov.functions.tokens import words
from textprov.session import lean

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not import this package

VALUE = 1 << 12  # of a row's values
WEIGHT = 1 << 20  # of weights, residuals and losses
COUNT = 1 << 8  # of the logarithms of counts
PAIR = 1_000_003  # fixed value: joins the hashes of two neighbouring words
PART = (1 << 31) - 1
ENTRIES = 1 << 18  # values of stored rows that are multiplied at once

# The usual constants of Adam.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


class LinearModel(NamedTuple):
    """Weights as whole numbers, the last one for the constant."""

    n_features: int
    weights: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each weight that is not 0, and the size of the model."""
        at = np.flatnonzero(self.weights)
        rows = [(int(i), int(self.weights[i])) for i in at] + [(-1, self.n_features)]
        spark.createDataFrame(rows, "feature long, weight long").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        rows = {r["feature"]: r["weight"] for r in spark.read.parquet(path).collect()}
        n = rows.pop(-1)
        weights = np.zeros(n + 1, np.int64)
        for feature, weight in rows.items():
            weights[feature] = weight
        return cls(n, weights)


def _hasher(n_features: int):
    """From a column of word lists to sparse rows; nested so that tasks need only this closure."""
    def sparse(column):
        import hashlib

        import numpy as np

        first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
        offsets = column.offsets.to_numpy().astype(np.int64) - first
        flat = column.values.slice(first, last - first).dictionary_encode()
        hashed = np.array(
            [int(hashlib.md5(f"feature:{w}".encode()).hexdigest()[: DRAW_BITS // 4], 16) for w in flat.dictionary.to_pylist()],
            np.int64,
        )
        n = len(column)
        row = np.repeat(np.arange(n), np.diff(offsets))
        word = hashed[flat.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
        same = row[1:] == row[:-1]
        part = word & PART
        pair = ((part[:-1] * PAIR + part[1:]) % n_features)[same]
        width = n_features + 1
        key = np.concatenate([row * width + word % n_features, row[:-1][same] * width + pair])
        key, count = np.unique(key, return_counts=True)
        own = key // width
        value = np.floor(COUNT * (1 + np.log(count)) + 0.5)
        size = np.sqrt(np.bincount(own, weights=value * value, minlength=n))
        value = np.floor(VALUE * value / size[own] + 0.5).astype(np.int64)
        # The constant is the last feature of every row.
        key = np.concatenate([key, np.arange(n) * width + n_features])
        value = np.concatenate([value, np.full(n, VALUE)])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        starts = np.searchsorted(key, np.arange(n + 1) * width)
        return starts, key % width, value

    return sparse


def _lists(starts, idx, val):
    import numpy as np
    import pyarrow as pa

    offsets = pa.array(starts.astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (idx, val)]


def word_lists(df: DataFrame, **texts: str) -> DataFrame:
    """Add the lower-case words of each text; a null text has none."""
    return df.withColumns({name: words(F.lower(F.coalesce(F.col(t), F.lit("")))) for name, t in texts.items()})


def _hashing(df: DataFrame, n_features: int, text: str, keep: Sequence[str]):
    """The words of each text, what makes batches of sparse rows of them, and the rows' schema."""
    sparse = _hasher(n_features)
    listed = word_lists(df, _words=text).select(*keep, "_words")
    schema = T.StructType([
        *listed.schema.fields[:-1],
        T.StructField("_idx", T.ArrayType(T.IntegerType())), T.StructField("_val", T.ArrayType(T.IntegerType())),
    ])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                columns = [*batch.columns[:-1], *_lists(*sparse(batch.columns[-1]))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return listed, run, schema


def hashed_rows(df: DataFrame, n_features: int, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, ``_idx`` and ``_val``: the sparse row of each text."""
    listed, run, schema = _hashing(df, n_features, text, keep)
    return lean(listed).mapInArrow(run, schema)


def difference_rows(df: DataFrame, n_features: int, plus: str, minus: str, keep: Sequence[str] = ()) -> DataFrame:
    """As ``hashed_rows``, for the difference of two texts; features that cancel are left out."""
    sparse = _hasher(n_features)
    listed = word_lists(df, _plus=plus, _minus=minus).select(*keep, "_plus", "_minus")
    schema = T.StructType([
        *listed.schema.fields[:-2],
        T.StructField("_idx", T.ArrayType(T.IntegerType())), T.StructField("_val", T.ArrayType(T.IntegerType())),
    ])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            width = n_features + 1
            keys, values = [], []
            for column, sign in ((batch.columns[-2], 1), (batch.columns[-1], -1)):
                starts, idx, val = sparse(column)
                keys.append(np.repeat(np.arange(n), np.diff(starts)) * width + idx)
                values.append(sign * val)
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            value = np.bincount(at, weights=np.concatenate(values)).astype(np.int64)
            # The constant cancels too, but stays, so that no row is without a value.
            kept = (value != 0) | (key % width == n_features)
            key, value = key[kept], value[kept]
            starts = np.searchsorted(key, np.arange(n + 1) * width)
            columns = [*batch.columns[:-2], *_lists(starts, key % width, value)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return lean(listed).mapInArrow(run, schema)


def _blocks():
    """Slices of a batch of sparse rows of bounded size, and their products with weights."""
    def slices(batch):
        import numpy as np

        idx, val = batch.column("_idx"), batch.column("_val")
        offsets = idx.offsets.to_numpy().astype(np.int64)
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + ENTRIES, side="right")) - 1)
            span = slice(offsets[i], offsets[j])
            yield i, j, offsets[i : j + 1] - offsets[i], idx.values.to_numpy()[span], val.values.to_numpy()[span].astype(np.int64)
            i = j

    def products(weights, starts, idx, val):
        import numpy as np

        return np.add.reduceat(weights[idx] * val[:, None], starts[:-1], axis=0) / float(VALUE * WEIGHT)

    return slices, products


def logistic(z, y):
    """Residual and loss of the cross-entropy."""
    import numpy as np

    p = 1 / (1 + np.exp(-z))
    return p - y, np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def margin_of(margin: float):
    """Residual and loss of a hinge at ``margin``."""
    def hinge(z, y):
        import numpy as np

        return np.where(z < margin, -1.0, 0.0), np.maximum(margin - z, 0)

    return hinge


def _gradient_sums(rows: DataFrame, weights: np.ndarray, label: str | None, objective: Callable):
    """Sums of residual times value by feature, and of losses, for every column of weights."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    slices, products = _blocks()
    size, settings = weights.shape

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        sums = np.zeros((size + 1, settings), np.int64)  # the last row sums losses
        for batch in batches:
            y = batch.column(label).to_numpy().astype("float64")[:, None] if label else np.ones((batch.num_rows, 1))
            for i, j, starts, idx, val in slices(batch):
                residual, loss = objective(products(w, starts, idx, val), y[i:j])
                residual = np.floor(residual * WEIGHT + 0.5)
                each = np.repeat(residual, np.diff(starts), axis=0) * val[:, None]
                for s in range(settings):
                    # A slice's sums are whole and below 2**53, so doubles hold them.
                    sums[:size, s] += np.bincount(idx, weights=each[:, s], minlength=size).astype(np.int64)
                sums[size] += np.floor(loss * WEIGHT + 0.5).sum(axis=0).astype(np.int64)
        met = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), *[pa.array(sums[met, s]) for s in range(settings)]],
            names=["feature", *[f"s{s}" for s in range(settings)]],
        )

    columns = [f"s{s}" for s in range(settings)]
    found = lean(rows).mapInArrow(run, ", ".join(f"{c} long" for c in ["feature", *columns]))
    total = found.groupBy("feature").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in columns])
    t = total.toArrow()  # a row for each feature at most
    shared.destroy()
    sums = np.zeros((size + 1, settings))
    at = t.column("feature").to_numpy()
    for s, c in enumerate(columns):
        sums[at, s] = t.column(c).to_numpy()
    return sums[:size], sums[size] / WEIGHT


class Trainer:
    """Steps the weights of several settings, one scan of the rows for each step of all."""

    def __init__(self, rows: DataFrame, n_features: int, grid: Sequence[dict], label: str | None, objective: Callable):
        self.rows, self.label, self.objective, self.grid = rows, label, objective, list(grid)
        self.n = rows.count()
        self.n_features = n_features
        shape = (n_features + 1, len(self.grid))
        self.weights, self.m, self.v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.steps = 0

    def whole(self, settings: Sequence[int]) -> np.ndarray:
        return np.floor(self.weights[:, list(settings)] * WEIGHT + 0.5).astype(np.int64)

    def model(self, setting: int) -> LinearModel:
        return LinearModel(self.n_features, self.whole([setting])[:, 0])

    def step(self, settings: Sequence[int]) -> dict[int, float]:
        """One step of Adam for ``settings``; gives the mean loss of each before the step."""
        settings = list(settings)
        sums, losses = _gradient_sums(self.rows, self.whole(settings), self.label, self.objective)
        self.steps += 1
        n = max(self.n, 1)
        for k, s in enumerate(settings):
            reg, rate = float(self.grid[s].get("reg", 0.0)), float(self.grid[s].get("rate", 0.1))
            w = self.weights[:, s]
            g = sums[:, k] / (float(VALUE) * WEIGHT * n) + reg * w
            self.m[:, s] = BETA1 * self.m[:, s] + (1 - BETA1) * g
            self.v[:, s] = BETA2 * self.v[:, s] + (1 - BETA2) * (g * g)
            m = self.m[:, s] / (1 - math.pow(BETA1, self.steps))
            v = self.v[:, s] / (1 - math.pow(BETA2, self.steps))
            self.weights[:, s] = w - rate * m / (np.sqrt(v) + EPSILON)
        return {s: float(losses[k] / n) for k, s in enumerate(settings)}


def with_logits(rows: DataFrame, weights: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Stored sparse rows with the product of every column of weights in place of ``_idx, _val``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    slices, products = _blocks()
    kept = [f for f in rows.schema.fields if f.name not in ("_idx", "_val")]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.concatenate([products(shared.value, starts, idx, val) for _, _, starts, idx, val in slices(batch)])
            columns = [batch.column(f.name) for f in kept] + [pa.array(z[:, s]) for s in range(z.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return lean(rows).mapInArrow(run, schema)


def add_logit(model: LinearModel, df: DataFrame, text: str = "text", name: str = "logit") -> DataFrame:
    """``df`` with the model's product for each text; every column stays."""
    rows = hashed_rows(df, model.n_features, text, df.columns)
    return with_logits(rows, model.weights[:, None], [name])


def describe(params: dict) -> str:
    return json.dumps(params, sort_keys=True)
