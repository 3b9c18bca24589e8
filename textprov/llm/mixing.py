"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of equal size. A source's target is its weight's part of the
mix, but never more than ``most`` times what it has; what is above is shared by weight
among the rest until no source is above (one water level, found by running sums over the
sources). Sources are cut into shards of about ``SHARD`` texts. Seats, one for each
block of the mix, go to shards by highest quotient ``target / (2 * seats + 1)``: that is
Sainte-Lague, and gives integer quotas that add up. Only quotients near the last seat
need comparing: all others are counted in closed form, so a shard costs a few rows
whatever its quota.

In a shard, texts stand in the order of a digest of id and text and form one stream of
words, cut into blocks. A quota of more than all blocks takes the whole shard once for
each full round; the rest is a run of blocks from a drawn place on, around the end.
A text is taken by as many words as those blocks hold of it.

Everything is built-in expressions. Texts are read once, for their sizes; the window
runs over shards of bounded size, so a source with a third of all rows is spread like
any other; the single-task windows see one row for each source, and a few for each shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprov.functions.draws import draw
from textprov.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix by words there are
MOST = 2  # times that a text may be taken
BLOCK = 16  # words
SHARD = 5_000  # texts
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    source: str,
    size: str,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """``source, source_size, texts, target`` with one row for each source.

    Sources by code point, null last, have ``weights`` in turn.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("texts")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int"))
    limit = F.col("source_size") * most
    given = totals.withColumn("weight", weight).withColumn("ratio", limit / F.col("weight"))
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (
        F.sum("source_size").over(all_) * F.lit(share)
        - F.coalesce(F.sum(limit).over(before), F.lit(0))
    ) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = given.withColumn("level", level)
    # The first source that stays below its limit fixes the level of all that do.
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_)
    return levels.withColumn("final", found["level"]).select(
        "source", "source_size", "texts",
        F.least(limit.cast("double"), F.coalesce(F.col("final") * F.col("weight"), limit.cast("double")))
        .alias("target"),
    )


def quotas(shards: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """Add ``quota``, the blocks that each row takes: Sainte-Lague on ``target``.

    Rows are told apart by ``source, shard``; ``shard_size`` limits the quota.
    """
    exact = shards.withColumn("due", F.col("target") / F.lit(float(block)))
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    due, rows = F.sum("due").over(all_), F.count(F.lit(1)).over(all_)
    near = (rows / 2 + 1) / F.greatest(F.floor(due), F.lit(1))
    bounded = (
        exact.withColumn("seats", F.floor(due))
        .withColumn("near", near)
        .withColumn("sure", F.floor(F.col("due") * F.greatest(1 - F.col("near"), F.lit(0.0)) + 0.5))
        .withColumn("open", F.floor(F.col("due") * (1 + F.col("near")) + 0.5))
    )
    bounded = bounded.withColumn("left", F.col("seats") - F.sum("sure").over(all_))
    seats = bounded.select(
        "source", "shard", "due", "left",
        F.explode(
            F.when(F.col("open") > F.col("sure"), F.sequence(F.col("sure") + 1, F.col("open")))
        ).alias("seat"),
    ).withColumn("quotient", F.col("due") / (2 * F.col("seat") - 1))
    order = Window.orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "shard", "seat")
    won = (
        seats.withColumn("rank", F.row_number().over(order))
        .where("rank <= left")
        .groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard"))
        .agg(F.count(F.lit(1)).alias("won"))
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    blocks = F.ceil(F.col("shard_size") / F.lit(block))
    quota = F.least(F.col("sure") + F.coalesce("won", F.lit(0)), blocks * most)
    return bounded.join(won, same, "left").select(*shards.columns, quota.alias("quota"))


def mix(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK,
    shard_texts: int = SHARD,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``id, key, size, source, source_size, target, taken`` of every row, and its ``carry``.

    ``size`` counts the words of a text, ``target`` is what its source should give, and
    ``taken`` how many words the mix takes of this text, repeats counted. ``key`` is a
    digest of the text, to join the texts back; where rows may repeat, ``carry`` names
    columns that tell them apart. Draws are digests of ids and texts, so reruns agree whatever the
    partitioning, and rows without an id are spread like others; only rows equal in both may
    change places.

    Defined results: a null or empty text has size 0 and gives 0; a null source is a
    source, the last by name; null ids are ids like others; rows that repeat are rows of
    their own; other columns are not looked at; an empty table gives an empty result.
    """
    sizes = df.select(
        F.col(id).alias("id"), F.col(source).alias("source"),
        size_of(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"),
        draw(seed, F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("draw"),
        *carry,
    )
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes, "source", "size", weights, share, most), "targets")
    spread = F.greatest(F.lit(1), F.ceil(F.col("texts") / F.lit(shard_texts)))
    named = targets.withColumnRenamed("source", "_source")
    rows = (
        sizes.join(named, sizes["source"].eqNullSafe(named["_source"]))
        .drop("_source")
        .withColumn("shard", F.pmod(F.col("draw"), spread).cast("long"))
    )
    shards = rows.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("source_target"),
    )
    part = F.col("shard_size") / F.greatest("source_size", F.lit(1))
    shards = shards.withColumn("target", F.col("source_target") * part)
    given = quotas(shards.select("source", "shard", "shard_size", "target"), block, most)
    given = materialize(given, "quotas").withColumnsRenamed({"source": "_source", "shard": "_shard"})
    stream = Window.partitionBy("source", "shard").orderBy("draw", "id", "key")
    placed = rows.withColumn(
        "before",
        F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    blocks = F.greatest(F.ceil(F.col("shard_size") / F.lit(block)), F.lit(1))
    first = F.pmod(draw(seed, F.lit("first"), F.coalesce("source", F.lit("")), F.col("shard")), blocks)
    taken = (
        placed.join(given.drop("target"), same)
        .withColumn("rounds", F.floor(F.col("quota") / blocks))
        .withColumn("rest", F.col("quota") - F.col("rounds") * blocks)
        .withColumn("from", first * block)
        .withColumn("to", F.least((first + F.col("rest")) * block, F.col("shard_size")))
        .withColumn("around", F.greatest(first + F.col("rest") - blocks, F.lit(0)) * block)
        .withColumn("after", F.col("before") + F.col("size"))
    )
    inside = lambda lo, hi: F.greatest(
        F.least("after", hi) - F.greatest("before", lo), F.lit(0)
    )
    return taken.select(
        F.col("id").alias(id), "key", "size", F.col("source").alias(source), "source_size", "target",
        (
            F.col("rounds") * F.col("size")
            + inside(F.col("from"), F.col("to"))
            + inside(F.lit(0), F.col("around"))
        ).cast("long").alias("taken"),
        *carry,
    )
