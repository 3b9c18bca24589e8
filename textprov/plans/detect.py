"""Detection and ranking jobs: essays in, predictions, AUC and submission out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprov.functions.text import add_question, py_strip
from textprov.functions.vectors import sigmoid
from textprov.models.detector import fit_best, fit_detector, score
from textprov.models.ranker import fit_best_ranker, fit_ranker, rank_score
from textprov.operators.metrics import Evaluation, evaluate, roc_auc
from textprov.operators.pairs import human_ai_pairs
from textprov.operators.rows import by_fold, drop_null_text
from textprov.operators.sampling import hash_split, sample_n
from textprov.session import materialize
from textprov.sources.readers import read_essays
from textprov.sources.writers import write_predictions


def fold_auc(scored: DataFrame, frac: float = 0.8, seed=42) -> DataFrame:
    """AUC of each fold of a scored, hash-split corpus.

    ``scored`` has ``id, text, generated, logit``.
    """
    split = hash_split(drop_null_text(scored), frac, seed)
    return roc_auc(
        split.withColumn("predictions", sigmoid("logit")), "predictions", "generated", by=["fold"]
    )


def split_essays(essays: DataFrame, frac: float = 0.99, seed=42) -> tuple[DataFrame, DataFrame]:
    split = hash_split(drop_null_text(essays), frac, seed)
    return by_fold(split, "train"), by_fold(split, "valid")


def _report(spark, models: dict, scores, truths: DataFrame, out_dir: str, run: str) -> Evaluation:
    """Score, evaluate and write ``best`` and ``last``; returns the best evaluation.

    Predictions are stored before they are evaluated, so texts are scored once for each
    model, and once in all if both are the same.
    """
    reports: dict[int, Evaluation] = {}
    for tag in ("last", "best"):
        model = models[tag]
        if id(model) not in reports:
            scored = materialize(scores(model).select("id", "logit"), "scores")
            reports[id(model)] = evaluate(scored, truths)
        write_predictions(reports[id(model)].results, out_dir, run, tag)
        model.save(spark, f"{out_dir}/models/{run}_{tag}")
    return reports[id(models["best"])]


def run_detection(
    spark: SparkSession,
    data_dir: str,
    out_dir: str,
    run: str,
    frac: float = 0.99,
    seed=42,
    grid: Sequence[dict] | None = None,
    patience: int = 2,
    **fit,
) -> Evaluation:
    """Read, split, fit on the train fold, score and write the valid fold.

    With a ``grid`` of settings, all are trained on the same scans, and each stops when its
    holdout AUC has not improved ``patience`` times; the predictions of the best and of the
    last model are both written, and so are the models, below ``out_dir``. Without, one fit is both.
    """
    train, valid = split_essays(read_essays(spark, data_dir), frac, seed)
    train, valid = (d.withColumn("text", add_question("text")) for d in (train, valid))
    if grid:
        found = fit_best(train, valid, grid, patience, **fit)
        models = {"best": found.model, "last": found.last}
    else:
        model = fit_detector(train, **fit)
        models = {"best": model, "last": model}
    truths = valid.select("id", "generated")
    return _report(spark, models, lambda m: score(m, valid), truths, out_dir, run)


def pair_texts(essays: DataFrame, seed=42, n: int | None = None) -> DataFrame:
    """``human, ai`` texts of the same prompt, stripped; at most ``n`` pairs by draw."""
    pairs = human_ai_pairs(essays, seed).select(
        F.concat_ws("-", "human_id", "ai_id").alias("pair_id"), "human_id", "ai_id"
    )
    if n is not None:
        pairs = sample_n(pairs, n, seed, "pair_id").drop("pos")
    text = py_strip("text")
    return pairs.join(
        essays.select(F.col("id").alias("human_id"), text.alias("human")), "human_id"
    ).join(essays.select(F.col("id").alias("ai_id"), text.alias("ai")), "ai_id")


def run_ranking(
    spark: SparkSession,
    data_dir: str,
    out_dir: str,
    run: str,
    frac: float = 0.99,
    seed=42,
    grid: Sequence[dict] | None = None,
    patience: int = 2,
    **fit,
) -> Evaluation:
    """As ``run_detection``, with a ranker fitted on pairs inside prompts."""
    train, valid = split_essays(read_essays(spark, data_dir), frac, seed)
    pairs = materialize(pair_texts(train, seed), "pair_texts")
    if grid:
        found = fit_best_ranker(pairs, valid, grid, patience, **fit)
        models = {"best": found.model, "last": found.last}
    else:
        model = fit_ranker(pairs, **fit)
        models = {"best": model, "last": model}
    truths = valid.select("id", "generated")
    return _report(spark, models, lambda m: rank_score(m, valid), truths, out_dir, run)
