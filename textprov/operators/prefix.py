"""Running values and positions without putting a group into one task.

A plain window would sort a whole group, or the whole table, in one task. Here
the rows are cut into cells, coarse keys that follow the sort order. Cell totals
are pre-aggregated where the rows are read; only those totals are scanned in
order, level by level; each cell is then scanned on its own and its carry added.
The largest unit of work is one cell, however many rows a group holds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textprov.functions.draws import DRAW_BITS, draw
from textprov.operators.skew import null_safe_join

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
Measures = Mapping[str, tuple[str, Column]]


def _merge(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fn == "max" else F.least(a, b)


def _carry(totals: DataFrame, by: list[str], cells: list[str], fns: dict[str, str]) -> DataFrame:
    """Value of everything before each cell."""
    head, last = cells[:-1], cells[-1]
    keys = [*by, *head]
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(last)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = totals.select(*by, *cells, *[_AGG[f](m).over(before).alias(m) for m, f in fns.items()])
    if not head:
        return local
    upper = _carry(
        totals.groupBy(*keys).agg(*[_AGG[f](m).alias(m) for m, f in fns.items()]), by, head, fns
    )
    upper = upper.withColumnsRenamed({m: f"_up_{m}" for m in fns})
    return null_safe_join(local, upper, keys).select(
        *by, *cells, *[_merge(f, F.col(m), F.col(f"_up_{m}")).alias(m) for m, f in fns.items()]
    )


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    cells: Sequence[Column],
    measures: Measures,
    by: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums, maxima or minima per ``by`` along ``order``.

    ``cells`` must follow ``order``: sorted by ``cells`` first, rows keep their
    order. ``order`` must be total. A null ``by`` key is a group like any other, and a
    null order value comes before all others of its group.
    ``df`` is read twice, for the totals and for the rows: store what is dear to make.
    """
    by = list(by)
    names = [f"_cell{i}" for i in range(len(cells))]
    fns = {m: f for m, (f, _) in measures.items()}
    marked = df.withColumns(dict(zip(names, cells)))
    totals = marked.groupBy(*by, *names).agg(
        *[_AGG[f](c).alias(m) for m, (f, c) in measures.items()]
    )
    carry = _carry(totals, by, names, fns).withColumnsRenamed({m: f"_carry_{m}" for m in fns})
    inside = (
        Window.partitionBy(*by, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = marked.withColumns(
        {f"_here_{m}": _AGG[f](c).over(inside) for m, (f, c) in measures.items()}
    )
    return null_safe_join(local, carry, [*by, *names]).select(
        *[F.col(c) for c in df.columns if c not in fns],
        *[
            _merge(f, F.col(f"_here_{m}"), F.col(f"_carry_{m}")).alias(m)
            for m, f in fns.items()
        ],
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    cells: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "pos",
) -> DataFrame:
    """Add the 0-based position of each row along ``order`` inside ``by``."""
    return running(
        df, order, cells, {name: ("sum", F.lit(1).cast("bigint"))}, by=by, inclusive=False
    )


# --- cells -----------------------------------------------------------------


def cell_bits(spark: SparkSession) -> int:
    """Enough equal cells to keep every task of the session busy."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(6, math.ceil(math.log2(16 * parts))))


def draw_cell(spark: SparkSession, drawn: Column) -> Column:
    """Cells of a draw column: equal in size, whatever the keys look like."""
    return F.shiftright(drawn, DRAW_BITS - cell_bits(spark))


def step_cells(step: Column, bits: int = 16) -> list[Column]:
    """Cells of an integer column that is unique inside its group.

    A cell spans ``2**bits`` values, so it holds at most that many rows.
    """
    s = step.cast("bigint")
    return [F.shiftright(s, 2 * bits), F.shiftright(s, bits)]


def with_quantile_cells(df: DataFrame, value: str, name: str, n: int | None = None) -> DataFrame:
    """Add a cell column that cuts ``value`` at its approximate quantiles.

    Takes one pass for the quantiles, a bounded list. A cell is either small or
    made of one single value. ``n=1`` skips the pass.
    """
    if n is None:
        n = min(1 << cell_bits(df.sparkSession), 2000)
    bounds = []
    if n > 1:
        bounds = df.approxQuantile(value, [i / n for i in range(1, n)], 0.1 / n)
    if not bounds:
        return df.withColumn(name, F.lit(0.0))
    edges = [-math.inf, *sorted(set(bounds)), math.inf]
    return Bucketizer(
        splits=edges, inputCol=value, outputCol=name, handleInvalid="keep"
    ).transform(df)


# --- orders by draw ----------------------------------------------------------


def shuffled_positions(
    df: DataFrame,
    id: str,
    seed,
    by: Sequence[str] = (),
    name: str = "pos",
    first: Sequence[Column] = (),
) -> DataFrame:
    """Positions in a random but reproducible order, optionally after ``first``.

    The order is (``first``, draw of the id, id); ``first`` columns should have few
    distinct values, since their totals are scanned in one task.
    """
    spark = df.sparkSession
    firsts = {f"_first{i}": c for i, c in enumerate(first)}
    drawn = df.withColumns({"_draw": draw(seed, F.col(id)), **firsts})
    numbered = number_rows(
        drawn,
        order=[*firsts, "_draw", id],
        cells=[*[F.col(c) for c in firsts], draw_cell(spark, F.col("_draw"))],
        by=by,
        name=name,
    )
    return numbered.drop("_draw", *firsts)
