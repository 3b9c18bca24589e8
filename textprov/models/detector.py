"""Linear text detector: the same target and objective as a fine-tuned classifier, on
hashed words and word pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from textprov.functions.tokens import WORD_PATTERN
from textprov.functions.vectors import sigmoid
from textprov.models.sparse import (
    LinearModel, Trainer, add_logit, describe, hashed_rows, logistic, with_logits,
)
from textprov.operators.metrics import roc_auc
from textprov.operators.series import best_and_patience
from textprov.session import materialize

N_FEATURES = 1 << 18
STEPS = 30
EVERY = 5  # steps between two looks at the holdout
LABEL = "generated"


def _words_stage(text: str, out: str) -> SQLTransformer:
    pattern = WORD_PATTERN.replace("\\", "\\\\")
    return SQLTransformer(
        statement=f"SELECT *, regexp_extract_all(lower({text}), '{pattern}', 0) AS {out} FROM __THIS__"
    )


def hashed(df: DataFrame, n_features: int, *keep: str, text: str = "text") -> DataFrame:
    """Stored sparse rows: texts are split once, every step reads the rows."""
    return materialize(hashed_rows(df, n_features, text, keep), "rows")


def fit_detector(
    train: DataFrame, n_features: int = N_FEATURES, reg: float = 1e-5, rate: float = 0.1, steps: int = STEPS
) -> LinearModel:
    """Fit on ``text, generated``: cross-entropy, one scan of the stored rows a step.

    The driver holds a few numbers per feature, no rows. The weights are the same on any
    partitioning. A null text is empty.
    """
    trainer = Trainer(
        hashed(train, n_features, LABEL), n_features, [{"reg": reg, "rate": rate}], LABEL, logistic
    )
    for _ in range(steps):
        trainer.step([0])
    return trainer.model(0)


def score(model: LinearModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``predictions`` (probability of generated) and ``logit``; no label is needed."""
    scored = add_logit(model, df, text)
    return scored.select(*df.columns, sigmoid("logit").alias("predictions"), "logit")


class Search(NamedTuple):
    model: LinearModel
    log: DataFrame
    last: LinearModel


def search(
    trainer: Trainer, metric: Callable, steps: int = STEPS, every: int = EVERY, patience: int = 2
) -> Search:
    """Train all settings at once; each stops when ``metric`` has not risen ``patience`` times.

    A step is one scan for all settings that are left. ``metric`` takes the weights of these
    settings and gives a number for each, every ``every`` steps. The model is that of the
    greatest number, the latest of equal ones of a setting and the first of equal settings;
    ``last`` is the last that was looked at. The log has a row per look, with ``best, is_best,
    patience``.
    """
    left, rows = list(range(len(trainer.grid))), []
    best: dict[int, tuple] = {}
    waited = dict.fromkeys(left, 0)
    chosen = last = None
    while left and trainer.steps < steps:
        trainer.step(left)
        if trainer.steps % every and trainer.steps < steps:
            continue
        reached = metric(trainer.whole(left))
        for s, value in zip(list(left), reached):
            last = trainer.model(s)
            rows.append((describe(trainer.grid[s]), trainer.steps, value))
            if value is not None and (s not in best or value >= best[s][0]):
                best[s], waited[s] = (value, last), 0
            else:
                waited[s] += 1
            if waited[s] >= patience:
                left.remove(s)
    for value, model in best.values():
        if chosen is None or value > chosen[0]:
            chosen = (value, model)
    log = trainer.rows.sparkSession.createDataFrame(rows, "run string, step long, metric double")
    last = last or trainer.model(0)
    return Search(chosen[1] if chosen else last, best_and_patience(log), last)


def auc_of(held: DataFrame, label: str = LABEL) -> Callable:
    """AUC of each column of weights on stored sparse rows: one scan for all."""
    def metric(weights):
        names = [f"s{s}" for s in range(weights.shape[1])]
        wide = with_logits(held.select(label, "_idx", "_val"), weights, names)
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("run"), F.col(n).alias("logit")) for s, n in enumerate(names)]))
        scored = wide.select(label, each.alias("x")).select(label, "x.*")
        found = {r["run"]: r["auc"] for r in roc_auc(scored, "logit", label, by=["run"]).collect()}
        return [found.get(s) for s in range(len(names))]

    return metric


def fit_best(
    train: DataFrame,
    valid: DataFrame,
    grid: Sequence[dict],
    patience: int = 2,
    n_features: int = N_FEATURES,
    steps: int = STEPS,
    every: int = EVERY,
) -> Search:
    """Fit a grid of ``reg`` and ``rate`` at once and pick by holdout AUC: see ``search``."""
    rows, held = (hashed(d, n_features, LABEL) for d in (train, valid))
    trainer = Trainer(rows, n_features, grid, LABEL, logistic)
    return search(trainer, auc_of(held), steps, every, patience)
