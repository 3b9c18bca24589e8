"""Contrastive and ranking batches with their losses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textprov.models.embedder import count_words, embed, fit_embedder
from textprov.operators.batches import balanced_batches, fetch_rows, prompt_batches
from textprov.operators.losses import ranking_loss, supcon_loss
from textprov.operators.rows import drop_null_text, limit_prompts
from textprov.session import materialize


def contrastive_losses(
    essays: DataFrame, batch_size: int = 64, max_prompt: int | None = None, seed=42, n_batches: int | None = None
) -> DataFrame:
    """Supervised contrastive loss of class-balanced batches of embedded essays.

    The counts of words are stored with what the plan needs of an essay, so texts are read
    and split once.
    """
    kept = drop_null_text(essays)
    if max_prompt is not None:
        kept = limit_prompts(kept, max_prompt)
    counted = materialize(count_words(kept.select("id", "prompt_id", "generated", "text")), "counts")
    vectors = materialize(embed(fit_embedder(counted), counted.select("id", "_tf")).drop("_tf"), "vectors")
    plan = materialize(balanced_batches(counted, batch_size, seed, n_batches), "batches")
    rows = fetch_rows(plan, vectors)
    return supcon_loss(rows, "batch_id", "vec", "generated")


def ranking_losses(scored: DataFrame, batch_size: int = 32, p: float = 0.8, seed=42) -> DataFrame:
    """Ranking loss of prompt batches; ``scored`` has ``id, prompt_id, generated, logit``.

    Batches have a fixed size, so each is a cell of its own. The scores are stored: the plan
    reads them several times and the rows are fetched from them.
    """
    stored = materialize(scored.select("id", "prompt_id", "generated", "logit"), "scored")
    plan = materialize(prompt_batches(stored, batch_size, seed, p), "batches")
    rows = fetch_rows(plan, stored.select("id", "generated", "logit"))
    return ranking_loss(rows, "batch_id", n_cells=1)
