"""Quality classifier from trusted positives and unlabelled texts.

No text is known to be bad: some are trusted to be good, the rest is a mixture in which a
share ``prior`` is good. With the logistic loss l, the risk of a score function f is
``prior * E_good[l(f)]`` for the good class plus ``E_all[l(-f)] - prior * E_good[l(-f)]``
for the bad one, both from the two samples at hand. The second part cannot be negative
in truth; when a mini-batch makes it so, the model has begun to learn the unlabelled
texts by heart, and the step goes back up that part instead (non-negative risk).

The share is estimated first: a plain classifier tells trusted from unlabelled texts on
one half of the samples; on the other half, the unlabelled share above a threshold
divided by the trusted share above it is an upper bound of the prior, tightest where
hardly any bad text is left. A small margin (``MARGIN`` at most) is taken off, since a
prior too large hides the bad class while one too small only lowers all scores a little.

Both samples are bounded (``SAMPLE`` rows each, drawn by a digest of the id), so the fit
is a small job on the driver; counting and scoring cover all texts in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textprov.functions.draws import uniform
from textprov.llm import flat
from textprov.llm.arrow import lean
from textprov.llm.features import WIDTH, text_features

SAMPLE = 20_000  # rows of either sample, about; the documented bound of the fit
STEPS = 800
BATCH = 1024
HIDDEN = 16
CLIP = 6.0
MARGIN = 0.03
DECAY = 1e-4


@dataclass
class PuModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """Chance that each row is of the good class."""
        if not self.layers:  # nothing to learn from
            return np.full(len(features), 0.5)
        return _chance(_forward(_scaled(features, self.mean, self.scale), self.layers)[1])


def _scaled(x, mean, scale):
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def _chance(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _forward(x, layers):
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def _fit(good: np.ndarray, every: np.ndarray, prior: float, seed: int) -> list[np.ndarray]:
    """Layers that minimise the non-negative risk by Adam steps on mini-batches."""
    draw = np.random.default_rng(seed)
    width = good.shape[1]
    layers = [
        draw.normal(size=(width, HIDDEN)) / np.sqrt(width), np.zeros(HIDDEN),
        draw.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1),
    ]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        p = good[draw.integers(0, len(good), min(BATCH, len(good)))]
        u = every[draw.integers(0, len(every), min(BATCH, len(every)))]
        x = np.concatenate([p, u])
        hidden, logit = _forward(x, layers)
        chance = _chance(logit)
        n = len(p)
        minus = np.logaddexp(0, logit)
        bad_risk = minus[n:].mean() - prior * minus[:n].mean()
        grad = np.empty(len(x))
        grad[:n] = -prior * chance[:n] / n
        grad[n:] = chance[n:] / len(u)
        if bad_risk < 0:
            grad = -grad
        else:
            grad[:n] += prior * (chance[:n] - 1) / n
        back = np.outer(grad, layers[2]) * (1 - hidden**2)
        slopes = [
            x.T @ back + DECAY * layers[0], back.sum(0),
            hidden.T @ grad + DECAY * layers[2], np.array([grad.sum()]),
        ]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            layers[k] = layers[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return layers


def estimate_prior(good: np.ndarray, every: np.ndarray, seed: int = 0) -> float:
    """The best bound on the share of the good class, less a margin."""
    draw = np.random.default_rng(seed)
    a, b = draw.random(len(good)) < 0.5, draw.random(len(every)) < 0.5
    if not (a.any() and b.any() and (~a).any() and (~b).any()):
        return 0.5
    layers = _fit(good[a], every[b], 0.5, seed)
    sp = np.sort(_forward(good[~a], layers)[1])
    su = np.sort(_forward(every[~b], layers)[1])
    cuts = np.unique(np.concatenate([sp, su]))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * len(su)))
    safe = np.maximum(above_p, 1e-9)
    bound = np.where(above_p > 0.05, (above_u + slack) / safe, np.inf)
    i = int(np.argmin(bound))
    return float(np.clip(above_u[i] / safe[i] - min(slack, MARGIN), 0.05, 0.99))


def _features(df: DataFrame, text: str, flag: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for p in flat.pieces(b.column(2)):
                rows = text_features(p).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(p.first, p.n), b.column(1).slice(p.first, p.n),
                        pa.array([r.tobytes() for r in rows], pa.binary()),
                    ],
                    names=["_draw", flag, "features"],
                )

    return lean(df).select("_draw", flag, text).mapInArrow(
        run, f"_draw double, {flag} boolean, features binary"
    )


def fit_pu(
    docs: DataFrame,
    positives: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    sample: int = SAMPLE,
    seed: int = 7,
) -> PuModel:
    """Fit on at most about ``sample`` trusted and ``sample`` unlabelled texts.

    ``positives`` holds the ids of trusted texts in its column ``id``. Unlabelled texts
    are drawn from all of ``docs``, the trusted ones included, as the risk asks for.
    Without any trusted text the model gives every text 0.5.
    """
    trusted = positives.select(F.col(id)).where(F.col(id).isNotNull()).distinct()
    n_trusted, n_docs = trusted.count(), docs.count()
    none = PuModel(np.zeros(WIDTH), np.ones(WIDTH), [], 0.5)
    if not n_trusted or not n_docs:
        return none
    # The ids are a bounded sample, so they may go to every task.
    some = trusted.where(uniform(f"{seed}p", F.col(id)) < sample / n_trusted)
    some = F.broadcast(some.withColumn("_good", F.lit(True)))
    # Rows are drawn by their whole content, so that rows without an id take part too.
    drawn = docs.select(id, F.col(text).alias("_text")).withColumn(
        "_draw", uniform(f"{seed}u", F.col(id).cast("string"), F.xxhash64("_text"))
    )
    picked = drawn.join(some, id, "left").where(
        F.col("_good").isNotNull() | (F.col("_draw") < sample / n_docs)
    )
    got = _features(picked, "_text", "_good").toArrow()
    if not len(got):
        return none
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32)
    x = x.reshape(len(got), WIDTH).astype(float)
    draw = got.column("_draw").to_numpy()
    order = np.lexsort((*x.T[:4], draw))  # the same order on every run
    x, draw = x[order], draw[order]
    good = got.column("_good").fill_null(False).to_numpy().astype(bool)[order]
    every = draw < sample / n_docs
    if not good.any() or not every.any():
        return none
    mean, scale = x[every].mean(0), np.maximum(x[every].std(0), 0.02)
    p, u = _scaled(x[good], mean, scale), _scaled(x[every], mean, scale)
    prior = estimate_prior(p, u, seed)
    return PuModel(mean, scale, _fit(p, u, prior, seed), prior)


def score_texts(
    df: DataFrame, model: PuModel, text: str = "text", name: str = "score"
) -> DataFrame:
    """Add the chance that each text is good; whole texts, one pass, no shuffle.

    Defined results: null and empty texts have a score like any other (their measures
    are zeros and a mark of emptiness); equal texts have equal scores; all columns stay,
    but one named like the result, which is replaced; an empty table gives an empty result.
    """
    kept = [c for c in df.columns if c != name]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(name, T.DoubleType(), False)]
    )
    at = kept.index(text)

    def run(batches):
        for b in batches:
            for p in flat.pieces(b.column(at)):
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(p.first, p.n).columns, pa.array(model.score(text_features(p)))],
                    names=[*kept, name],
                )

    return lean(df).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def held_out(id: Column, parts: int = 5) -> Column:
    """One fold of ids whose labels are never learned from."""
    return F.crc32(id.cast("string").cast("binary")) % parts == 0


def trusted(labels: DataFrame, id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Ids that every label row calls good, without the held-out fold."""
    return (
        labels.where(~held_out(F.col(id)))
        .groupBy(id)
        .agg(F.min(F.coalesce(F.col(quality), F.lit(0))).alias("_least"))
        .where("_least = 1")
        .select(id)
    )
