"""Metric logs: running means, best so far, patience, moving averages.

The step is an integer, unique inside its run; a null step comes first, and a null run
is a run like any other. A run of any length is cut into cells of consecutive steps;
see ``prefix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textprov.operators.prefix import running, step_cells
from textprov.operators.skew import null_safe_join

CELL_BITS = 16


def running_mean(
    df: DataFrame, run: str = "run", step: str = "step", value: str = "metric", weight: str | None = None
) -> DataFrame:
    """Add ``avg``, the weighted mean of all values up to and including the step.

    Give ``value`` as a decimal for sums that do not depend on their order.
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    total = running(
        df,
        order=[step],
        cells=step_cells(F.col(step)),
        measures={"_sum": ("sum", F.col(value) * w), "_n": ("sum", w)},
        by=[run],
    )
    return total.withColumn(
        "avg", F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double"))
    ).drop("_sum", "_n")


def best_and_patience(
    df: DataFrame, mode: str = "max", run: str = "run", step: str = "step", metric: str = "metric"
) -> DataFrame:
    """Add ``best``, ``is_best`` and ``patience`` to each evaluation.

    A row is best if no earlier one beats it, ties included; patience counts the
    rows since the last best one. That row is the latest holder of the running
    extreme. Rows are scanned once inside cells of ``2**CELL_BITS`` steps, of which only the
    row count and the leader go on to the other cells.
    """
    sign = 1 if mode == "max" else -1
    cell = [run, "_cell"]
    inside = (
        Window.partitionBy(*cell).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Inside a cell: the place of a row, and the latest holder of the extreme so far.
    local = df.withColumn("_cell", F.shiftright(F.col(step).cast("bigint"), CELL_BITS)).withColumn(
        "_at", F.row_number().over(inside).cast("bigint")
    )
    leader = F.struct((F.col(metric) * sign).alias("value"), F.col("_at").alias("at"))
    local = local.withColumn("_lead", F.max(leader).over(inside))
    # Over cells: how many rows came before, and the leader among them.
    totals = local.groupBy(*cell).agg(F.max("_at").alias("_rows"), F.max("_lead").alias("_best"))
    before = (
        Window.partitionBy(run).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    moved = lambda lead: F.struct(
        F.col(lead)["value"].alias("value"), (F.col(lead)["at"] + F.col("_before")).alias("at")
    )
    totals = totals.withColumn("_carry", F.max(moved("_best")).over(before))
    judged = null_safe_join(local, totals.select(*cell, "_before", "_carry"), cell)
    # ``greatest`` passes over a null carry, as the first cell has it.
    lead = F.greatest("_carry", moved("_lead"))
    judged = judged.withColumn("_lead", lead)
    since = F.col("_at") + F.col("_before") - F.col("_lead")["at"]
    return judged.select(
        *df.columns,
        (F.col("_lead")["value"] * sign).alias("best"),
        (since == 0).alias("is_best"),
        since.alias("patience"),
    )


def early_stop(judged: DataFrame, patience: int, run: str = "run", step: str = "step") -> DataFrame:
    """``run, stop_step``: where each run would end; null if it never does."""
    return judged.groupBy(run).agg(
        F.min(F.when(F.col("patience") >= patience, F.col(step))).alias("stop_step")
    )


def metric_at_best(
    df: DataFrame, mode: str = "max", run: str = "run", step: str = "step", metric: str = "metric"
) -> DataFrame:
    """The latest best evaluation of each run."""
    key = F.col(metric) if mode == "max" else -F.col(metric)
    return df.groupBy(run).agg(
        F.max_by(step, F.struct(key, F.col(step))).alias("step_at_best"),
        F.max_by(metric, F.struct(key, F.col(step))).alias("metric_at_best"),
    )


def ema(
    df: DataFrame,
    decay: float,
    run: str = "run",
    step: str = "step",
    value: str = "metric",
    bits: int = 12,
    levels: int = 3,
) -> DataFrame:
    """``run, ema, n``: ``(1-decay)*x + decay*previous`` over the steps, from the first x.

    One step is the map ``e -> a*e + b``; maps compose, so cells of at most
    ``2**bits`` steps are folded to one map each, then cells of cells.
    """
    # A null step comes first.
    at = F.coalesce(F.col(step).cast("bigint"), F.lit(-(1 << 62)))
    first = df.groupBy(run).agg(
        F.min_by(F.col(value).cast("double"), at).alias("_first"),
        F.count(F.lit(1)).alias("n"),
    )
    maps = df.select(
        run,
        at.alias("_at"),
        F.lit(float(decay)).alias("a"),
        (F.col(value).cast("double") * F.lit(1.0 - decay)).alias("b"),
    )
    for level in range(levels + 1):
        keys = [run] if level == levels else [run, "_up"]
        listed = F.array_sort(F.collect_list(F.struct("_at", "a", "b")))
        folded = F.aggregate(
            listed,
            F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, m: F.struct(
                (acc["a"] * m["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b")
            ),
        )
        maps = (
            maps.withColumn("_up", F.shiftright("_at", bits))
            .groupBy(*keys)
            .agg(folded.alias("_m"))
            .select(run, *([] if level == levels else [F.col("_up").alias("_at")]), "_m.a", "_m.b")
        )
    return null_safe_join(maps, first, [run]).select(
        run, (F.col("a") * F.col("_first") + F.col("b")).alias("ema"), "n"
    )
