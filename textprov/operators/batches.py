"""Batch plans: which text goes to which slot of which batch.

Plans are narrow tables ``batch_id, slot, id``; texts or token lists are fetched
by id afterwards, so long rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textprov.functions.draws import permutation_keys, permuted, uniform
from textprov.operators.prefix import shuffled_positions
from textprov.operators.skew import salted_join
from textprov.session import materialize


def batch_columns(df: DataFrame, batch_size: int) -> DataFrame:
    """Replace ``pos`` by ``batch_id`` and ``slot``."""
    pos = F.col("pos")
    return df.withColumns(
        {
            "batch_id": F.floor(pos / F.lit(batch_size)).cast("bigint"),
            "slot": (pos % F.lit(batch_size)).cast("bigint"),
        }
    ).drop("pos")


def assign_batches(
    df: DataFrame, batch_size: int, seed, id: str = "id", first: tuple[Column, ...] = ()
) -> DataFrame:
    """Cut the shuffled rows into batches.

    ``first`` sorts before the shuffle, e.g. the token length for cheap padding.
    """
    return batch_columns(shuffled_positions(df, id, seed, first=first), batch_size)


# A text of a small prompt is asked for by many batches. Its row is repeated so that
# about this many requests meet in one join key.
REQUESTS_PER_KEY = 1000
SMALL_KEYS = 100_000  # heavy ids that are sent to every task


def _copies(requests: int, n_prompts: int, n: Column) -> Column:
    """Repeats of each text of a prompt of ``n`` texts, all prompts drawn alike.

    One for prompts of usual size; over all prompts the repeats add at most
    ``requests / REQUESTS_PER_KEY`` rows.
    """
    per_text = F.lit(requests / max(n_prompts, 1) / REQUESTS_PER_KEY) / n
    return F.greatest(F.ceil(per_text), F.lit(1)).cast("int")


# Places that a task draws. Batches are few bytes each, so left to their size they would
# all be drawn in one task.
PLACES_PER_TASK = 1 << 14


def _pick(batches: DataFrame, prompts: DataFrame, n_prompts: int, n_places: int, seed) -> DataFrame:
    """One uniformly drawn prompt for each batch; no batch if there is no prompt.

    The batches are dealt by their number, ``PLACES_PER_TASK`` of all their places to a task,
    however few prompts there are.
    """
    number = F.floor(uniform(seed, "pick", F.col("batch_id")) * F.lit(n_prompts)).cast("bigint")
    numbered = shuffled_positions(prompts, "prompt_id", f"{seed}:prompts", name="prompt_no")
    if n_prompts <= SMALL_KEYS:
        numbered = F.broadcast(numbered)
    picked = batches.withColumn("prompt_no", number).join(numbered, "prompt_no")
    return picked.repartition(max(1, -(-n_places // PLACES_PER_TASK)), "batch_id")


def _fill(picked: DataFrame, k: Column, ranked: DataFrame, group: list[str], seed, *tag) -> DataFrame:
    """``k`` drawn texts of each picked group of ``n``: the first places of a permutation of
    its ranks that belongs to the batch. ``picked`` and the group sizes hold ``n`` and ``copies``."""
    parts = [*tag, F.col("batch_id")]
    # The keys are made below the explode, once for each batch: above it they would be made
    # again for every place, and for every round of its permutation.
    keyed = picked.select(
        "batch_id", *group, "n", "copies", permutation_keys(F.col("n"), seed, *parts).alias("_keys")
    )
    asked = keyed.select(
        "batch_id", *group, "n", "copies", "_keys",
        F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("i"),
    ).select(
        "batch_id", *group, "i",
        permuted(F.col("i"), F.col("n"), F.col("_keys"), seed, *parts).alias("rank"),
        F.pmod(F.xxhash64("batch_id"), F.col("copies")).cast("int").alias("copy"),
    )
    return asked.join(ranked, [*group, "rank", "copy"])


def _repeat(ranked: DataFrame, sizes: DataFrame, group: list[str], id: str) -> DataFrame:
    copies = salted_join(ranked, sizes.select(*group, "copies"), group, F.col(id))
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def prompt_batches(
    df: DataFrame, batch_size: int, seed, p: float = 0.8, epoch: int = 0, id: str = "id"
) -> DataFrame:
    """Epoch batches of which a share ``p`` holds texts of one prompt.

    Each batch of the shuffled epoch is kept, or with probability ``p`` replaced by
    as many distinct texts of one prompt, drawn among the prompts with at least
    ``batch_size`` texts. Columns: ``batch_id, slot, id, replaced``.
    """
    key = f"{seed}:{epoch}"
    rows = df.where(F.col("prompt_id").isNotNull()).select(id, "prompt_id")
    sizes = materialize(rows.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n")), "prompts")
    enough = F.col("n") >= batch_size
    totals = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(enough).alias("prompts")
    ).first()
    n_rows, n_prompts = totals["rows"], totals["prompts"]
    n_batches = -(-n_rows // batch_size)
    swap = F.lit(n_prompts > 0) & (
        uniform(seed, "swap", epoch, F.col("batch_id")) < F.lit(float(p))
    )
    kept = assign_batches(rows, batch_size, key, id).where(~swap).select(
        "batch_id", "slot", id, F.lit(False).alias("replaced")
    )

    batches = df.sparkSession.range(n_batches).withColumnRenamed("id", "batch_id").where(swap)
    prompts = sizes.where(enough).withColumn("copies", _copies(n_rows, n_prompts, F.col("n")))
    ranked = shuffled_positions(rows, id, f"{seed}:rank", by=["prompt_id"], name="rank")
    k = F.least(F.lit(batch_size), F.lit(n_rows) - F.col("batch_id") * batch_size).cast("bigint")
    filled = _fill(
        _pick(batches, prompts, n_prompts, n_rows, key),
        k,
        _repeat(ranked, prompts, ["prompt_id"], id),
        ["prompt_id"],
        key,
    )
    return kept.unionByName(
        filled.select("batch_id", F.col("i").alias("slot"), id, F.lit(True).alias("replaced"))
    )


def balanced_batches(
    df: DataFrame, batch_size: int, seed, n_batches: int | None = None, id: str = "id"
) -> DataFrame:
    """Batches of one prompt with equally many texts of both classes.

    A prompt takes part if both classes have ``batch_size // 2`` texts; no text
    repeats inside a batch. By default as many batches as an epoch has. Columns:
    ``batch_id, slot, prompt_id, generated, id``.
    """
    if batch_size < 2:
        raise ValueError("a balanced batch needs two texts at least")
    k = batch_size // 2
    rows = df.where(F.col("prompt_id").isNotNull() & F.col("generated").isin(0, 1)).select(
        id, "prompt_id", F.col("generated").cast("int").alias("generated")
    )
    sizes = materialize(
        rows.groupBy("prompt_id").agg(
            F.count_if(F.col("generated") == 1).alias("n_pos"),
            F.count_if(F.col("generated") == 0).alias("n_neg"),
        ),
        "prompts",
    )
    enough = (F.col("n_pos") >= k) & (F.col("n_neg") >= k)
    totals = sizes.agg(
        F.coalesce(F.sum(F.col("n_pos") + F.col("n_neg")), F.lit(0)).alias("rows"),
        F.count_if(enough).alias("prompts"),
    ).first()
    n_prompts = totals["prompts"]
    if n_batches is None:
        n_batches = -(-totals["rows"] // batch_size)
    batches = df.sparkSession.range(n_batches).withColumnRenamed("id", "batch_id")

    halves = F.explode(
        F.array(
            F.struct(F.lit(1).alias("generated"), F.col("n_pos").alias("n")),
            F.struct(F.lit(0).alias("generated"), F.col("n_neg").alias("n")),
        )
    )
    prompts = sizes.where(enough)
    copies = _copies(n_batches * k, n_prompts, F.col("n"))
    classes = (
        prompts.select("prompt_id", halves.alias("h")).select("prompt_id", "h.*").withColumn("copies", copies)
    )
    picked = (
        _pick(batches, prompts, n_prompts, 2 * k * n_batches, seed)
        .select("batch_id", "prompt_id", halves.alias("h"))
        .select("batch_id", "prompt_id", "h.*")
        .withColumn("copies", copies)
    )
    group = ["prompt_id", "generated"]
    ranked = shuffled_positions(rows, id, f"{seed}:rank", by=group, name="rank")
    filled = _fill(
        picked,
        F.lit(k).cast("bigint"),
        _repeat(ranked, classes, group, id),
        group,
        seed,
        F.col("generated"),
    )
    slot = F.col("i") + F.when(F.col("generated") == 0, F.lit(k)).otherwise(F.lit(0))
    return filled.select("batch_id", slot.alias("slot"), "prompt_id", "generated", id)


def fetch_rows(plan: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """The rows a batch plan names; columns the plan has already are kept from it.

    A text that many batches ask for is repeated in the result as often. Requests are counted
    on ids alone; a text with more than ``REQUESTS_PER_KEY`` is repeated once for each so many
    of its requests, and these are joined apart from the rest, so no task meets more of one
    text. The heavy texts are few: at most the requests divided by that number.
    """
    given = rows.drop(*[c for c in plan.columns if c != id])
    parts = F.ceil(F.count(F.lit(1)) / F.lit(float(REQUESTS_PER_KEY))).cast("int")
    heavy = plan.groupBy(id).agg(parts.alias("_parts")).where("_parts > 1")
    heavy = materialize(heavy, "heavy")
    if heavy.isEmpty():
        return plan.join(given, id)
    names = [c for c in plan.columns if c != id]
    light = plan.join(heavy, id, "left_anti").join(given, id)
    # Plan rows of one text differ in their batch and slot, so a digest of them spreads them.
    asked = plan.join(F.broadcast(heavy) if _small(heavy) else heavy, id).withColumn(
        "_part", F.pmod(F.xxhash64(*names) if names else F.monotonically_increasing_id(), F.col("_parts")).cast("int")
    )
    copies = given.join(F.broadcast(heavy) if _small(heavy) else heavy, id)
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = asked.drop("_parts").join(copies, [id, "_part"]).drop("_part")
    return light.unionByName(met.select(light.columns))


def _small(keys: DataFrame) -> bool:
    return keys.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS
