"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textprov.session import materialize


def _mark(edges: DataFrame) -> tuple:
    """A digest of the edge set; equal digests end the rounds."""
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node on an edge; component is the smallest node.

    Large-star and small-star rounds: every node hands its neighbours to the smallest
    of them, until all edges are stars. Each round is two aggregations and two joins on
    edges, written to the shared folder, so that lineage stays short and a lost executor
    costs one round. A node with very many edges sends one pre-aggregated minimum per
    task, and its join is split by the engine. Edges with a null end and loops are
    ignored; an empty table gives an empty result.
    """
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    e = materialize(
        edges.where(known)
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (
            small.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        e = materialize(small, "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return (
        e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(e.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .distinct()
    )
