"""Joins of predictions, human/generated pairs and preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textprov.operators.prefix import shuffled_positions
from textprov.session import materialize

RING_ROWS = 4096  # least pairs of a prompt that are joined together


def attach_truth(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """``id, predictions, truths``, matched by id and never by row order."""
    return predictions.select("id", "predictions").join(
        truths.select("id", F.col("generated").alias("truths")), "id"
    )


def human_ai_pairs(df: DataFrame, seed, id: str = "id") -> DataFrame:
    """Pair the texts of both classes of a prompt, in random order.

    Columns ``prompt_id, rank, human_id, ai_id``. Every text of a prompt that has both
    classes is in a pair: the larger class once each, the smaller one going round as
    often as it takes. A prompt of one class has no pairs. A prompt with very many texts of
    one class and few of the other is joined in blocks of ``RING_ROWS`` pairs for each of
    these few, so it is spread over the tasks.
    """
    rows = df.where(F.col("prompt_id").isNotNull()).select(id, "prompt_id", "generated")

    def ranked(label: int, name: str) -> DataFrame:
        own = rows.where(F.col("generated") == label).select(F.col(id).alias(name), "prompt_id")
        return shuffled_positions(own, name, f"{seed}:{label}", by=["prompt_id"], name="rank")

    sizes = rows.groupBy("prompt_id").agg(
        F.count_if(F.col("generated") == 0).alias("n0"), F.count_if(F.col("generated") == 1).alias("n1")
    )
    sizes = materialize(sizes.where("n0 > 0 and n1 > 0"), "prompts")
    human = materialize(ranked(0, "human_id").join(sizes, "prompt_id"), "ranks")
    ai = materialize(ranked(1, "ai_id").join(sizes, "prompt_id"), "ranks")

    def matched(larger: DataFrame, smaller: DataFrame, n: str, of: str) -> DataFrame:
        # The ring of the smaller class goes once to each block of the larger one. A block
        # is as long as the ring at least, so the copies are no more than the pairs.
        block = F.greatest(F.col(n), F.lit(RING_ROWS))
        asked = larger.withColumns({"_turn": F.col("rank") % F.col(n), "_block": F.floor(F.col("rank") / block)})
        blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(of) - 1) / block))
        ring = smaller.withColumnRenamed("rank", "_turn").withColumn("_block", F.explode(blocks)).drop("n0", "n1")
        return asked.join(ring, ["prompt_id", "_block", "_turn"]).select(
            "prompt_id", "rank", "human_id", "ai_id"
        )

    return matched(human.where("n0 >= n1"), ai.where("n0 >= n1"), "n1", "n0").union(
        matched(ai.where("n1 > n0"), human.where("n1 > n0"), "n0", "n1")
    )


def preference_ids(scored: DataFrame, score: str = "score", id: str = "id") -> DataFrame:
    """Best and worst scored text of each prompt, prompts without a gap left out.

    Ties take the smallest id. The aggregate combines where the rows are read, so
    a prompt of any size costs one row per task.
    """
    s = F.col(score)
    best = F.min_by(id, F.struct(-s, F.col(id)))
    worst = F.min_by(id, F.struct(s, F.col(id)))
    return (
        scored.where(F.col("prompt_id").isNotNull() & s.isNotNull())
        .groupBy("prompt_id")
        .agg(
            best.alias("chosen_id"),
            worst.alias("rejected_id"),
            (F.max(s) - F.min(s)).alias("diff"),
        )
        .where(F.col("diff") > 0)
    )


def build_preferences(scored: DataFrame, score: str = "score", id: str = "id") -> DataFrame:
    """``dpo_id, prompt, chosen, rejected, diff``: the winning and losing texts.

    ``scored`` has ``id, prompt_id, prompt, text`` and the score. Only ids go through
    the aggregate. The picked ids are stored, so their real size decides how the
    texts are fetched.
    """
    picked = materialize(preference_ids(scored, score, id), "preferences")
    chosen = scored.select(F.col(id).alias("chosen_id"), "prompt", F.col("text").alias("chosen"))
    rejected = scored.select(F.col(id).alias("rejected_id"), F.col("text").alias("rejected"))
    return (
        picked.join(chosen, "chosen_id")
        .join(rejected, "rejected_id")
        .select(
            F.concat_ws("-", "prompt_id", "chosen_id", "rejected_id").alias("dpo_id"),
            "prompt", "chosen", "rejected", "diff",
        )
    )
