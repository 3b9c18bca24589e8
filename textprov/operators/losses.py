"""Losses as aggregates over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textprov.functions.draws import DRAW_BITS, draw
from textprov.functions.vectors import sigmoid
from textprov.operators.prefix import running, with_quantile_cells
from textprov.operators.skew import salted_join
from textprov.session import lean, materialize

MARGIN = 0.7  # fixed value: margin of both ranking losses
TEMPERATURE = 0.1  # fixed value: temperature of the contrastive loss


def bce_term(logit, label) -> Column:
    """Cross-entropy of one logit, stable for large values."""
    x = (F.col(logit) if isinstance(logit, str) else logit).cast("double")
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_with_logits(
    df: DataFrame, logit: str = "logit", label: str = "generated", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(bce_term(logit, label)).alias("loss"))


def margin_pair_loss(
    pairs: DataFrame, ai: str = "ai_logit", human: str = "human_logit", margin: float = MARGIN, by: Sequence[str] = ()
) -> DataFrame:
    """Mean hinge of generated-minus-human raw scores over given pairs."""
    gap = F.col(ai).cast("double") - F.col(human).cast("double")
    return pairs.groupBy(*by).agg(
        F.avg(F.greatest(F.lit(float(margin)) - gap, F.lit(0.0))).alias("loss")
    )


def ranking_loss(
    df: DataFrame,
    by: str = "batch_id",
    logit: str = "logit",
    label: str = "generated",
    margin: float = MARGIN,
    n_cells: int | None = None,
) -> DataFrame:
    """Pairwise ranking loss over all ordered pairs of a group: ``by, n, loss``.

    Pairs of one class, the diagonal included, cost the margin each. A generated
    text at ``p`` and a human one at ``q`` cost ``margin - p + q`` where positive, twice
    (both orders). Sorting the generated texts at ``p - margin`` among the human ones
    turns the sum over pairs into one running sum, so no pair is ever formed.
    Labels are 0 or 1. The places are stored before they are cut into quantile cells;
    ``n_cells=1`` suits groups of bounded size and does neither.
    """
    m = F.lit(float(margin))
    is_pos = F.col("_y") == 1
    points = df.select(
        by, F.col(label).cast("int").alias("_y"), sigmoid(logit).alias("_p")
    ).where(F.col("_y").isin(0, 1))
    # Descending thresholds: what comes before a generated text costs it something.
    placed = points.withColumn("_place", F.when(is_pos, m - F.col("_p")).otherwise(-F.col("_p")))
    merged = placed.groupBy(by, "_place", "_y", "_p").agg(F.count(F.lit(1)).alias("_n"))
    if n_cells != 1:
        merged = materialize(merged, "places")
    merged = with_quantile_cells(merged, "_place", "_bin", n_cells)
    human = F.col("_n") * (1 - F.col("_y"))
    seen = running(
        merged,
        ["_place", "_y"],
        [F.col("_bin")],
        {"_count": ("sum", human), "_sum": ("sum", human * F.col("_p"))},
        by=[by],
    )
    hinge = F.col("_n") * (F.col("_count") * (m - F.col("_p")) + F.col("_sum"))
    sums = seen.groupBy(by).agg(
        F.sum(F.when(is_pos, F.col("_n")).otherwise(0)).cast("double").alias("n1"),
        F.sum(F.when(is_pos, 0).otherwise(F.col("_n"))).cast("double").alias("n0"),
        F.coalesce(F.sum(F.when(is_pos, hinge)), F.lit(0.0)).alias("hinge"),
    )
    n = F.col("n1") + F.col("n0")
    same = m * (F.col("n1") * F.col("n1") + F.col("n0") * F.col("n0"))
    return sums.select(
        by, n.cast("bigint").alias("n"), ((same + 2 * F.col("hinge")) / (n * n)).alias("loss")
    )


def _similarity_sums(tau: float):
    """Per pair of tiles: each anchor's two sums over the texts of the other tile."""

    def sums(table):
        import numpy as np
        import pyarrow as pa

        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        tile = table["tile"].to_numpy()
        label = table["label"].to_numpy()
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vec = flat.reshape(len(tile), -1).astype("float64")

        def one_way(mine, other):
            sim = np.exp(vec[mine] @ vec[other].T / tau)
            same = label[mine][:, None] == label[other][None, :]
            masked_pos = ~same
            if mine is other:
                masked_pos |= np.eye(len(mine), dtype=bool)
            pos = np.where(masked_pos, 1.0, sim).sum(axis=1)
            neg = np.where(same, 1.0, sim).sum(axis=1)
            return mine, pos, neg

        in_a, in_b = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        if a == b:
            parts = [one_way(in_a, in_a)]
        else:
            parts = [one_way(in_a, in_b), one_way(in_b, in_a)]
        rows, pos, neg = (np.concatenate(p) for p in zip(*parts))
        return pa.table(
            {
                "batch": table["batch"].take(pa.array(rows)),
                "id": table["id"].take(pa.array(rows)),
                "pos": pos,
                "neg": neg,
            }
        )

    return sums


def _each_group(keys: tuple[str, ...], fn):
    """Call ``fn`` for every run of equal keys in sorted rows; a run may span batches.

    What the runs that end in a batch give is one batch again, however short they are.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            cut = np.zeros(len(rows), bool)
            for k in keys:
                c = rows.column(k).to_numpy()
                cut[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(cut).tolist()]
            done = [fn(rows.slice(lo, hi - lo)) for lo, hi in zip(starts, starts[1:])]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
            held = rows.slice(starts[-1])
        if held is not None:
            yield from fn(held).to_batches()

    return run


def supcon_loss(
    df: DataFrame,
    by: str = "batch_id",
    vec: str = "vec",
    label: str = "label",
    id: str = "id",
    tau: float = TEMPERATURE,
    tile_rows: int = 512,
) -> DataFrame:
    """Supervised contrastive loss of each batch: ``by, n, loss``.

    Masking is by multiplication: entries that do not count, the anchor itself among
    them, add exp(0) = 1 to the sum they are masked from. Rows without a batch are left out. Every anchor needs all
    texts of its batch, so batches are cut into tiles by draw and each pair of tiles
    is one task-sized matrix product that returns sums, not pairs. A batch of usual
    size is a single tile.
    """
    rows = df.select(
        F.col(by).alias("batch"),
        F.col(id).alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.col(vec).alias("vec"),
    ).where("batch is not null")
    tiles = F.ceil(F.count(F.lit(1)) / F.lit(float(tile_rows))).alias("tiles")
    sizes = rows.groupBy("batch").agg(tiles)
    part = F.floor(
        draw("tile", F.col("id")) * F.col("tiles") / F.lit(float(1 << DRAW_BITS))
    ).cast("bigint")
    sized = salted_join(rows, sizes, ["batch"], F.col("id")).withColumn("tile", part)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    copies = sized.select("batch", "id", "label", "vec", "tile", other.alias("_other")).select(
        "batch", "id", "label", "vec", "tile",
        F.least("tile", "_other").alias("a"),
        F.greatest("tile", "_other").alias("b"),
    )
    out = copies.select(
        "batch", "id", F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg")
    ).schema
    cell = ("batch", "a", "b")
    # Sorted rows stream through a task, so many small batches share an Arrow batch.
    cells = copies.repartition(*cell).sortWithinPartitions(*cell)
    sums = lean(cells).mapInArrow(_each_group(cell, _similarity_sums(float(tau))), out)
    anchors = sums.groupBy("batch", "id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return anchors.groupBy(F.col("batch").alias(by)).agg(
        F.count(F.lit(1)).alias("n"),
        (-F.avg(F.log(F.col("pos") / (F.col("pos") + F.col("neg"))))).alias("loss"),
    )
