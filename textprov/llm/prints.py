"""Document fingerprints by winnowing, in built-in expressions only.

A text is a sequence of units: pieces of at most 16 signs of a word, or a single sign of
the scripts beyond U+2E7F, which are written without blanks. Every run of ``k`` units is a
gram; its rolling hash joins the units' checksums by fixed factors, exact in 64 bits, and
each half of a run serves the runs that begin and end there. Of every window of
``w`` grams the least one is chosen, the rightmost of equal ones, by the low bits of the
hashes. What is chosen anywhere is the fingerprint: hashes with their places. Runs and
windows grow by doubling, so a place costs a few steps whatever ``k`` and ``w`` are.

The guarantee: a run of ``k + w - 1`` units that two texts share holds a whole window, and
its least gram is chosen in both. A gram is found again by its place.

``edited_prints`` also compares each text with the next one in falling order of ids. The
texts are moved once: they go to cells that follow the order of ids, and the first text of
a cell goes to the cell before as well, so that the window inside a cell sees every
neighbour. Cells come from approximate quantiles, cut evenly inside; rows of one id that is
on very many rows are cut by a digest of their texts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from textprov.session import materialize

K, W = 4, 8  # units of a gram, grams of a window
CELLS = 16  # cells of ids for each shuffle partition
COARSE = 32  # the quantiles are found in two steps of so many

# A unit; the odd factors by which runs of one and two units are joined, so
# small that a run of four checksums of 32 bits stays below 2**62; the bits of a hash that
# give its order, and those that a run shorter than a gram keeps.
UNIT = r"[\x21-\x{2E7F}]{1,16}|[^\x00-\x{2E7F}]"
FACTORS = {1: 12_547, 2: 28_657}
ORDER = (1 << 32) - 1
SHORT = (1 << 45) - 1
PLACES = (1 << 31) - 1


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def shifted(half: Column, size: int, join) -> Column:
    """``join`` of each value and the one ``size`` places on."""
    n = F.greatest(F.size(half) - size, F.lit(0))
    return F.zip_with(F.slice(half, F.lit(1), n), F.slice(half, F.lit(1 + size), n), join)


def doubled(values: Column, n: int, join) -> Column:
    """``join`` over each run of ``n`` values, a power of two, from the joins of its halves.

    ``join(size)`` gives the function for halves of ``size`` values.
    """
    size = 1
    while size < n:
        values = let(values, partial(lambda size, half: shifted(half, size, join(size)), size))
        size *= 2
    return values


def gram_hashes(codes: Column, k: int) -> Column:
    """Hash of each run of ``k`` checksums, or of all where there are fewer; none of none."""
    whole = doubled(codes, k, lambda size: lambda a, b: a * F.lit(FACTORS[size]) + b)
    few = F.aggregate(
        codes, F.lit(0).cast("bigint"), lambda h, c: (h * F.lit(FACTORS[1]) + c).bitwiseAND(F.lit(SHORT))
    )
    return F.when(F.size(codes) >= k, whole).when(F.size(codes) > 0, F.array(few)).otherwise(
        F.array().cast("array<bigint>")
    )


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """``array<struct<hash, place>>`` of the grams that are chosen, by place.

    A text of fewer than ``k`` units is one gram, one of fewer than ``w`` grams one window,
    and a null, empty or blank text has no fingerprint. Time and memory are in proportion
    to the text's length. ``k`` is 1, 2 or 4, and ``w`` a power of two.
    """
    if k not in (1, 2, 4) or w < 1 or w & (w - 1):
        raise ValueError("k has to be 1, 2 or 4 and w a power of two")

    def least(order):
        windows = doubled(order, w, lambda size: lambda a, b: F.least(a, b))
        return F.when(F.size(order) >= w, windows).when(
            F.size(order) > 0, F.array(F.array_min(order))
        ).otherwise(F.array().cast("array<bigint>"))

    def chosen(grams):
        # The order of a gram, and below it its place from the end.
        order = F.transform(
            grams, lambda x, i: x.bitwiseAND(F.lit(ORDER)) * F.lit(1 << 31) + (F.lit(PLACES) - i)
        )
        place = lambda m: (F.lit(PLACES) - (m % F.lit(1 << 31))).cast("int")
        return F.transform(
            F.array_distinct(let(order, least)),
            lambda m: F.struct(F.get(grams, place(m)).alias("hash"), place(m).alias("place")),
        )

    # One is added so that a unit differs from the lack of one.
    codes = F.transform(units(text), lambda u: F.crc32(u.cast("binary")) + F.lit(1))
    return let(let(codes, lambda c: gram_hashes(c, k)), chosen)


def print_text(chosen: Column) -> Column:
    """``hash@place`` of each, the hash in hex digits, with blanks between."""
    return F.array_join(
        F.transform(chosen, lambda x: F.concat_ws("@", F.hex(x["hash"]), x["place"].cast("string"))), " "
    )


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of two lists of distinct hashes that is in both; 1 if there are none at all."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def cells(docs: DataFrame, n_cells: int) -> DataFrame:
    """Add ``cell, part``, which follow ``ord`` and then ``key``, of about equal numbers of rows.

    ``ord`` is cut at its approximate quantiles, a list of at most ``COARSE ** 2`` numbers,
    and between two of them evenly by value. Rows that share the least value of a
    cell, which may be very many, are cut by ``key``.
    """
    n = min(COARSE * COARSE, n_cells)
    found = docs.agg(
        F.percentile_approx("ord", [i / n for i in range(n)], 20 * COARSE * COARSE).alias("edges")
    ).head()["edges"]
    edges = sorted(set(found or [0]))
    groups = [edges[i : i + COARSE] for i in range(0, len(edges), COARSE)]
    upto = lambda list_: F.size(F.filter(list_, lambda e: e <= F.col("ord")))
    group = F.greatest(upto(F.lit([g[0] for g in groups])), F.lit(1))
    inside = F.greatest(upto(F.element_at(F.array(*[F.lit(g) for g in groups]), group)), F.lit(1))
    placed = docs.withColumn("cell", ((group - 1) * COARSE + inside).cast("int"))
    least = placed.groupBy("cell").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n"))
    least = materialize(least, "cells")
    first = (
        placed.join(F.broadcast(least), "cell").where("ord = lo").groupBy("cell").agg(F.count(F.lit(1)).alias("n_lo"))
    )
    # At most COARSE ** 2 rows.
    all_ = Window.partitionBy(F.lit(0))
    sizes = least.join(first, "cell").withColumn("every", F.sum("n").over(all_)).withColumns({
        "fine_lo": F.ceil(F.col("n_lo") * n_cells / F.col("every")),
        "fine": F.ceil((F.col("n") - F.col("n_lo")) * n_cells / F.col("every")),
    })
    sizes = materialize(sizes.select("cell", "lo", "hi", "fine_lo", "fine"), "edges")
    by_key = F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("fine_lo"))
    step = (F.col("ord").cast("double") - F.col("lo").cast("double")) / (
        F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0
    )
    part = F.when(F.col("ord") == F.col("lo"), by_key).otherwise(
        F.col("fine_lo") + 1 + F.floor(step * F.col("fine"))
    )
    return placed.join(F.broadcast(sizes), "cell").withColumn("part", part.cast("long")).drop(
        "lo", "hi", "fine_lo", "fine"
    )


def with_next(df: DataFrame, id: str, text: str, add=lambda docs: docs, lead=()) -> DataFrame:
    """``id, text`` of every row and ``next_text``, the text of the next row by falling id.

    The first row follows the last. Rows of one id stand in the order of a digest of their
    texts, rows without an id last. ``add`` computes columns once the texts are in their
    cells, and ``next_`` columns of those in ``lead`` are added too.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(
        F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("ord"),
        body.alias("text"), F.xxhash64(body).alias("key"),
    )
    n_cells = CELLS * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cells(docs, n_cells)
    # One row a cell: its first row, and the cell that comes before it.
    firsts = placed.groupBy("cell", "part").agg(F.max(F.struct("ord", "key")).alias("first"))
    firsts = materialize(firsts, "firsts")
    bounds = firsts.groupBy("cell").agg(F.min("part").alias("low"))  # a row a quantile
    falling = Window.orderBy(F.lit(0), F.desc("cell"))
    before = bounds.withColumn("above", F.lag(F.struct("cell", "low")).over(falling))
    last = F.min(F.struct("cell", "low")).over(Window.partitionBy(F.lit(0)))
    before = before.select("cell", F.coalesce("above", last).alias("above"))
    inner = F.lag(F.struct("cell", F.col("part").alias("low"))).over(
        Window.partitionBy("cell").orderBy(F.desc("part"))
    )
    firsts = firsts.withColumn("inner", inner).join(F.broadcast(before), "cell")
    firsts = materialize(
        firsts.select("cell", "part", "first", F.coalesce("inner", "above").alias("above")), "bounds"
    )
    here = F.struct("cell", "part", F.lit(False).alias("guest"))
    there = F.struct(F.col("above.cell").alias("cell"), F.col("above.low").alias("part"), F.lit(True).alias("guest"))
    starts = (F.col("first.ord") == F.col("ord")) & (F.col("first.key") == F.col("key"))
    sent = placed.join(firsts, ["cell", "part"]).select(
        "id", "ord", "key", "text", F.explode(F.when(starts, F.array(here, there)).otherwise(F.array(here))).alias("to")
    )
    sent = sent.select("id", "ord", "key", "text", "to.*")
    moved = add(sent.repartition("cell", "part"))
    order = Window.partitionBy("cell", "part").orderBy("guest", F.desc("ord"), F.desc("key"))
    return moved.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *lead)}).where("not guest")


def edited_prints(
    df: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, w: int = W
) -> DataFrame:
    """``id, n_chars, edited, chosen, edited_chosen, near_edited, near_next`` of every row.

    ``chosen`` is the fingerprint of the text and ``edited_chosen`` that of ``edited``, the
    text whose last third of code points is replaced by as many of the next text's first
    ones, or all it has. ``near_edited`` and ``near_next`` are the shares of hashes that the
    text's fingerprint has in common with the edited one's and the next text's.

    Defined results: a null text is empty; an empty or blank text has an empty fingerprint,
    like any other such text by 1 and like all others by 0; the next of a sole row is the row itself;
    rows that repeat are rows of their own, each the next of the one before; rows without
    an id come last; other columns are not looked at; an empty table gives an empty result.
    Ids are whole numbers.
    """
    rows = with_next(
        df, id, text, lambda docs: docs.withColumn("chosen", winnow(F.col("text"), k, w)), lead=["chosen"]
    )
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    made = rows.select("id", "chosen", "next_chosen", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.withColumn("edited_chosen", winnow(F.col("edited"), k, w))
    own = hashes(F.col("chosen"))
    return made.select(
        F.col("id").alias(id), "n_chars", "edited", "chosen", "edited_chosen",
        likeness(own, hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(own, hashes(F.col("next_chosen"))).alias("near_next"),
    )
