"""Pairwise ranker: generated above human inside a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from textprov.models.detector import EVERY, STEPS, Search, auc_of, hashed, search
from textprov.models.sparse import LinearModel, Trainer, add_logit, difference_rows, margin_of
from textprov.operators.losses import MARGIN
from textprov.session import materialize

RANK_FEATURES = 1 << 18


def _trainer(pairs: DataFrame, n_features: int, grid: Sequence[dict], margin: float) -> Trainer:
    rows = materialize(difference_rows(pairs, n_features, "ai", "human"), "gaps")
    return Trainer(rows, n_features, grid, None, margin_of(margin))


def fit_ranker(
    pairs: DataFrame,
    n_features: int = RANK_FEATURES,
    reg: float = 1e-5,
    rate: float = 0.1,
    steps: int = STEPS,
    margin: float = MARGIN,
) -> LinearModel:
    """Fit on ``human, ai`` texts: the mean of ``max(0, margin - (ai - human))`` of their logits.

    A pair is one sparse row, the difference of its texts, made where the texts are read.
    """
    trainer = _trainer(pairs, n_features, [{"reg": reg, "rate": rate}], margin)
    for _ in range(steps):
        trainer.step([0])
    return trainer.model(0)


def fit_best_ranker(
    pairs: DataFrame,
    valid: DataFrame,
    grid: Sequence[dict],
    patience: int = 2,
    n_features: int = RANK_FEATURES,
    steps: int = STEPS,
    every: int = EVERY,
    margin: float = MARGIN,
) -> Search:
    """Fit a grid at once and pick by the AUC on ``text, generated`` of ``valid``."""
    held = hashed(valid, n_features, "generated")
    return search(_trainer(pairs, n_features, grid, margin), auc_of(held), steps, every, patience)


def rank_score(model: LinearModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``logit``: higher means more likely generated."""
    return add_logit(model, df, text)
