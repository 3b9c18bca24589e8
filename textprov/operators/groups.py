"""Grouped lists, counts and means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textprov.operators.prefix import shuffled_positions


def ids_by(
    df: DataFrame, by: Sequence[str], chunk: int = 4096, seed=0, id: str = "id"
) -> DataFrame:
    """The ids of each group as lists of at most ``chunk`` ids, in random order.

    Columns ``*by, chunk, n, ids``. A group of any size is whole, but spread over
    as many lists as it needs.
    """
    by = list(by)
    rows = df.select(id, *by).dropna(subset=by)
    ranked = shuffled_positions(rows, id, seed, by=by, name="rank")
    entry = F.struct("rank", F.col(id).alias("id"))
    return (
        ranked.withColumn("chunk", F.floor(F.col("rank") / F.lit(chunk)).cast("bigint"))
        .groupBy(*by, "chunk")
        .agg(F.array_sort(F.collect_list(entry)).alias("_ids"))
        .select(
            *by,
            "chunk",
            F.size("_ids").alias("n"),
            F.transform("_ids", lambda x: x["id"]).alias("ids"),
        )
    )


def ids_by_prompt(df: DataFrame, chunk: int = 4096, seed=0, id: str = "id") -> DataFrame:
    return ids_by(df, ["prompt_id"], chunk, seed, id)


def ids_by_prompt_class(df: DataFrame, chunk: int = 4096, seed=0, id: str = "id") -> DataFrame:
    return ids_by(df, ["prompt_id", "generated"], chunk, seed, id)


def distinct_prompts(df: DataFrame) -> DataFrame:
    return df.select("prompt_id").distinct()


def profile(df: DataFrame) -> DataFrame:
    """Rows and columns of each fold."""
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint")
    )


def mean_loss(df: DataFrame, loss: str = "loss", batch: str = "batch_id") -> DataFrame:
    """Mean of the batch means; batches count alike whatever their size."""
    return (
        df.groupBy(batch)
        .agg(F.avg(loss).alias("_mean"))
        .agg(F.avg("_mean").alias("valid_loss"), F.count(F.lit(1)).alias("n_batches"))
    )
