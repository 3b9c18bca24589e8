"""Batched functions of the user's own over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from textprov.functions.draws import uniform_int
from textprov.functions.text import generation_prompt, instruction
from textprov.operators.rows import drop_null_text, fill_defaults
from textprov.operators.sampling import SAMPLED_KNOBS, draw_prompts, sample_knobs
from textprov.session import materialize


def map_batched(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` (pandas frame to pandas frame) to Arrow batches of rows."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def map_columns(
    df: DataFrame, load: Callable[[], Callable], columns: Sequence[str], out: str, out_type: str
) -> DataFrame:
    """Add ``out``: a function of whole Arrow columns, with its set-up done once per task.

    ``load`` returns a function that takes the Arrow arrays of ``columns`` and gives one of as many
    values. Only these columns leave the JVM. Nulls reach the function as nulls.
    """
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = load()
        for batch in batches:
            yield fn(*batch)

    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = load()
        for batch in batches:
            yield fn(batch)

    made = F.arrow_udf(run_one if len(columns) == 1 else run, out_type)
    return df.withColumn(out, made(*[F.col(c) for c in columns]))


def batch_infer(
    df: DataFrame, load: Callable[[], Callable], out: str = "responses", out_type: str = "array<string>"
) -> DataFrame:
    """Add ``out`` and ``error`` from a model function over batches of rows.

    ``load`` runs once per task and returns a function from a pandas frame to one
    value per row. A batch that fails is halved until the failing rows are alone: they
    keep a null and the message, and one bad row among n costs about 2 log2(n) calls.
    """
    fields = [*df.schema.fields]
    fields.append(T.StructField(out, T.StructType.fromDDL(f"x {out_type}")[0].dataType))
    fields.append(T.StructField("error", T.StringType()))

    def answer(model, batch):
        try:
            values = list(model(batch))
            if len(values) != len(batch):
                raise ValueError(f"{len(values)} values for {len(batch)} rows")
            return values, [None] * len(batch)
        except Exception as e:
            if len(batch) < 2:
                return [None] * len(batch), [f"{type(e).__name__}: {e}"] * len(batch)
        half = len(batch) // 2
        left, right = answer(model, batch.iloc[:half]), answer(model, batch.iloc[half:])
        return left[0] + right[0], left[1] + right[1]

    def run(batches):
        model = load()
        for batch in batches:
            values, errors = answer(model, batch)
            result = batch.copy()
            result[out] = values
            result["error"] = errors
            yield result

    return df.mapInPandas(run, T.StructType(fields))


def expand_prompts(df: DataFrame, n: int) -> DataFrame:
    """``n`` copies of each row, told apart by ``copy`` from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def with_generation_prompt(
    essays: DataFrame, seed, lo: int = 16, hi: int = 64, id: str = "id"
) -> DataFrame:
    """Add ``prompt``: the instruction and the first ``lo`` to ``hi`` characters of the text."""
    n_chars = uniform_int(lo, hi, seed, "chars", F.col(id))
    return essays.withColumn("prompt", generation_prompt(instruction(), F.col("text"), n_chars))


def generation_plan(
    essays: DataFrame,
    n: int,
    n_gen: int,
    seed,
    lo: int = 16,
    hi: int = 64,
    spec=SAMPLED_KNOBS,
    id: str = "id",
    stored: bool = True,
) -> DataFrame:
    """One row per response to generate: drawn prompt, decoding parameters, copy.

    Only ids are drawn; the drawn texts are fetched afterwards. The draws are stored
    first, so their real size decides how the texts are joined.
    """
    kept = fill_defaults(drop_null_text(essays))
    draws = draw_prompts(kept, n, seed, id)
    if stored:
        draws = materialize(draws, "draws")
    prompts = draws.join(with_generation_prompt(kept, seed, lo, hi, id).select(id, "prompt"), id)
    return expand_prompts(sample_knobs(prompts, seed, "draw", spec), n_gen)
