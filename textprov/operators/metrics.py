"""ROC-AUC and the evaluation report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from textprov.functions.vectors import sigmoid
from textprov.operators.pairs import attach_truth
from textprov.operators.prefix import running, with_quantile_cells
from textprov.operators.rows import to_submission
from textprov.session import materialize

_COUNT = "decimal(38,0)"  # pair counts pass 2**63 long before rows do


def roc_auc(
    df: DataFrame,
    score: str = "predictions",
    label: str = "truths",
    by: Sequence[str] = (),
    n_cells: int | None = None,
    digits: int | None = 4,
) -> DataFrame:
    """Exact area under the ROC curve, ties at one half: ``*by, n_pos, n_neg, auc``.

    Rows are combined to distinct scores, which are stored, so the scores are made
    once. The negatives below each score come from a running sum over quantile cells
    of the score; ``n_cells=1`` suits groups of bounded size. Null with one class.
    """
    by = list(by)
    keys = by or ["_all"]
    points = (
        df.select(
            *(by or [F.lit(0).alias("_all")]),
            F.col(score).cast("double").alias("_score"),
            F.col(label).cast("int").alias("_label"),
        )
        .groupBy(*keys, "_score")
        .agg(
            F.count_if(F.col("_label") == 1).alias("pos"),
            F.count_if(F.col("_label") == 0).alias("neg"),
        )
    )
    stored = materialize(points, "scores").where(F.col("_score").isNotNull())
    celled = with_quantile_cells(stored, "_score", "_bin", n_cells)
    ranked = running(
        celled, ["_score"], [F.col("_bin")], {"below": ("sum", F.col("neg"))}, by=keys, inclusive=False
    )
    twice = F.col("pos").cast(_COUNT) * (F.col("below") * 2 + F.col("neg")).cast("decimal(20,0)")
    sums = ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(twice).cast("double").alias("_twice"),
    )
    area = F.try_divide(
        F.col("_twice"), F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    )
    return sums.select(
        *by, "n_pos", "n_neg", (area if digits is None else F.round(area, digits)).alias("auc")
    )


class Evaluation(NamedTuple):
    scores: DataFrame
    results: DataFrame
    submission: DataFrame


def evaluate(scored: DataFrame, truths: DataFrame, logit: str = "logit") -> Evaluation:
    """AUC (``lb``), ``id, predictions, truths`` and the submission of scored texts."""
    predicted = scored.select("id", sigmoid(logit).alias("predictions"))
    results = attach_truth(predicted, truths)
    return Evaluation(
        roc_auc(results).withColumnRenamed("auc", "lb"), results, to_submission(results)
    )
