"""Generation job: essays in, cleaned responses out as records."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprov.functions.text import clean_response
from textprov.operators.infer import batch_infer, generation_plan
from textprov.operators.sampling import SAMPLED_KNOBS
from textprov.session import materialize
from textprov.sources.readers import read_human_essays
from textprov.sources.writers import write_records

RECORD_KNOBS = ["temperature", "top_k", "guidance_scale", "penalty_alpha"]


SUPPRESS_BYTES = 16 << 20

def records(generated: DataFrame) -> DataFrame:
    """One record per draw from ``generated`` rows (one decoded ``response`` each).

    A draw has as many rows as copies were asked for, so its list stays short.
    Failed rows are left out; a draw without any answer has no record.
    """
    answers = generated.where(F.col("error").isNull())
    entry = F.struct("copy", clean_response("response").alias("r"))
    return (
        answers.groupBy("draw")
        .agg(
            F.first("record_id").alias("id"),
            F.first("prompt").alias("prompt"),
            *[F.first(k).alias(k) for k in RECORD_KNOBS],
            F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"]).alias("responses"),
        )
        .drop("draw")
    )


def with_content_id(essays: DataFrame) -> DataFrame:
    """Add ``id``: a digest of all columns, and a number that tells equal rows apart.

    Equal rows are counted, not sorted, so it does not matter how many there are.
    """
    columns = essays.columns
    whole = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    counted = essays.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    each = counted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    return each.select(*columns, F.concat_ws(":", F.md5(whole), "_k").alias("id"))


def run_generation(
    spark: SparkSession,
    essays_path: str,
    out_path: str,
    load: Callable[[], Callable],
    n: int = 256,
    n_gen: int = 4,
    seed=42,
    lo: int = 16,
    hi: int = 64,
    spec: Mapping[str, tuple] = SAMPLED_KNOBS,
    suppress: DataFrame | None = None,
) -> DataFrame:
    """Plan, generate with the user's function, clean, write; returns failed rows.

    Responses are stored before they are cleaned, so a model is asked once. The same
    essays and seed give the same records, however the input is cut into files.
    ``suppress`` is a table of tokens (column ``tok``, a part of a model's vocabulary as
    ``out_of_corpus`` gives it) that must not be generated: ``load(suppress=[...])``
    gets them as a sorted list. It may hold ``SUPPRESS_BYTES``; more is an error, since the
    list goes to every task.
    """
    essays = materialize(with_content_id(read_human_essays(spark, essays_path)), "essays")
    plan = generation_plan(essays, n, n_gen, seed, lo, hi, spec)
    if suppress is not None:
        size = suppress.agg(F.coalesce(F.sum(F.octet_length("tok") + 16), F.lit(0))).first()[0]
        if size > SUPPRESS_BYTES:
            raise ValueError(f"{size} bytes of tokens to suppress; at most {SUPPRESS_BYTES} go to every task")
        load = partial(load, suppress=[r[0] for r in suppress.select("tok").orderBy("tok").collect()])
    generated = materialize(batch_infer(plan, load, "response", "string"), "generated")
    write_records(records(generated), out_path)
    return generated.where(F.col("error").isNotNull())
