"""Sources and sinks: tables written in each format and read back whole."""

from pyspark.sql import functions as F

from textprov.catalog.inputs import (
    SQL_ESSAYS, SQL_HUMAN, SQL_SCORED, essays, human_essays, scored,
)
from textprov.catalog.batches import SQL_PAIRS
from textprov.catalog.registry import query, sql_uniform
from textprov.catalog.rows import DRAWS, SQL_DRAWS, sql_knobs
from textprov.catalog.strings import SQL_CLEAN, SQL_WHITE, _sql_prompt
from textprov.functions.vectors import sigmoid
from textprov.operators.infer import batch_infer, generation_plan
from textprov.operators.pairs import build_preferences
from textprov.operators.sampling import hash_split
from textprov.plans.detect import pair_texts
from textprov.plans.generate import records
from textprov.session import run_dir
from textprov.sources import readers as R, writers as W

SQL_TYPED = "CAST(id AS VARCHAR) AS id, text, CAST(generated AS INTEGER) AS generated, prompt_id"


def _essay_rows(spark, sf):
    e = essays(spark, sf)
    return e.select(F.col("id").cast("string").alias("id"), "text", "generated", "prompt_id")


@query("essays_csv", f"WITH {SQL_ESSAYS} SELECT {SQL_TYPED} FROM essays")
def essays_csv(spark, sf):
    path = run_dir(spark, "essays")
    W.write_csv(_essay_rows(spark, sf), f"{path}/train_essays.csv")
    return R.read_essays(spark, path)


@query("essays_parquet", f"WITH {SQL_ESSAYS} SELECT {SQL_TYPED} FROM essays")
def essays_parquet(spark, sf):
    path = run_dir(spark, "essays")
    _essay_rows(spark, sf).write.parquet(f"{path}/train_essays.parquet")
    return R.read_essays(spark, path)


@query(
    "split_parquet",
    f"""WITH {SQL_ESSAYS}
        SELECT {SQL_TYPED}, CASE WHEN {sql_uniform(42, 'id')} < 0.8::DOUBLE THEN 'train' ELSE 'valid' END AS fold
        FROM essays""",
)
def split_parquet(spark, sf):
    path = run_dir(spark, "split")
    split = hash_split(_essay_rows(spark, sf), 0.8, 42)
    for fold in ("train", "valid"):
        split.where(F.col("fold") == fold).drop("fold").write.parquet(f"{path}/{fold}_essays.parquet")
    return R.read_split(spark, path)


@query(
    "human_essays_csv",
    f"""WITH {SQL_HUMAN} SELECT text, prompt_name, task, holistic_essay_score, grade_level, ell_status,
                               student_disability_status FROM human""",
)
def human_essays_csv(spark, sf):
    path = f"{run_dir(spark, 'human')}/essays.csv"
    W.write_csv(human_essays(spark, sf).drop("id").withColumnRenamed("text", "full_text"), path)
    return R.read_human_essays(spark, path)


SQL_ENDS = """ends AS (
  SELECT prompt_id, arg_min(id, (-logit, id)) AS c, arg_min(id, (logit, id)) AS r FROM scored
  GROUP BY 1 HAVING max(logit) > min(logit))"""


@query(
    "preferences_parquet",
    f"""WITH {SQL_SCORED}, {SQL_ENDS}
        SELECT 'src' || e.prompt_id AS prompt, c.text AS chosen, r.text AS rejected
        FROM ends e JOIN scored c ON c.id = e.c JOIN scored r ON r.id = e.r""",
)
def preferences_parquet(spark, sf):
    path = f"{run_dir(spark, 'preferences')}/dpo_train.parquet"
    s = scored(spark, sf).withColumn("prompt", F.concat(F.lit("src"), F.col("prompt_id")))
    build_preferences(s, "logit").write.parquet(path)
    return R.read_preferences(spark, path)


@query(
    "pairs_csv",
    f"""WITH {SQL_ESSAYS}, {SQL_PAIRS}
        SELECT trim(h.text, {SQL_WHITE}) AS human, trim(a.text, {SQL_WHITE}) AS ai
        FROM pairs p JOIN essays h ON h.id = p.human_id JOIN essays a ON a.id = p.ai_id""",
)
def pairs_csv(spark, sf):
    path = f"{run_dir(spark, 'pairs')}/train_essays_pos_neg.csv"
    W.write_csv(pair_texts(essays(spark, sf)).select("human", "ai"), path)
    return R.read_pairs(spark, path)


@query(
    "predictions_csv",
    f"""WITH {SQL_SCORED} SELECT CAST(id AS VARCHAR) AS id, round(p, 9) AS predictions,
        CAST(generated AS INTEGER) AS truths, round(p, 9) AS generated FROM probs""",
)
def predictions_csv(spark, sf):
    results = scored(spark, sf).select(
        "id", F.round(sigmoid("logit"), 9).alias("predictions"), F.col("generated").alias("truths")
    )
    paths = W.write_predictions(results, run_dir(spark, "predictions"), "closed_form")
    back = R.read_csv(spark, paths["results"])
    submitted = R.read_csv(spark, paths["submission"])
    return back.join(submitted, "id").select(
        "id",
        F.col("predictions").cast("double").alias("predictions"),
        F.col("truths").cast("int").alias("truths"),
        F.col("generated").cast("double").alias("generated"),
    )


@query(
    "predictions_best_csv",
    f"""WITH {SQL_SCORED} SELECT CAST(id AS VARCHAR) AS id, round(p, 9) AS predictions,
        CAST(generated AS INTEGER) AS truths FROM probs""",
)
def predictions_best_csv(spark, sf):
    """The ``best`` files, after a worse evaluation was written as ``last``."""
    results = scored(spark, sf).select(
        "id", F.round(sigmoid("logit"), 9).alias("predictions"), F.col("generated").alias("truths")
    )
    folder = run_dir(spark, "predictions")
    paths = W.write_predictions(results, folder, "closed_form", "best")
    W.write_predictions(results.withColumn("predictions", F.lit(0.5)), folder, "closed_form", "last")
    return R.read_csv(spark, paths["results"]).select(
        "id", F.col("predictions").cast("double").alias("predictions"),
        F.col("truths").cast("int").alias("truths"),
    )


@query(
    "records_json",
    f"""WITH {SQL_HUMAN}, {SQL_DRAWS},
prompted AS (SELECT id, {_sql_prompt(5, 16, 64)} AS prompt FROM instructed),
planned AS (SELECT d.draw, p.prompt, {sql_knobs(5, 'd.draw')} FROM draws d JOIN prompted p ON p.id = d.id),
raw AS (SELECT *, prompt || ' and so on </s> </s>' AS response FROM planned),
clean AS (SELECT *, {SQL_CLEAN} AS r FROM raw)
SELECT record_id AS id, prompt, temperature, top_k::BIGINT AS top_k, guidance_scale, penalty_alpha,
       r || chr(30) || r AS responses FROM clean""",
)
def records_json(spark, sf):
    # A stand-in for a model. Nested, so that it reaches the tasks by value.
    def echo():
        return lambda batch: [f"{p} and so on </s> </s>" for p in batch["prompt"]]

    path = f"{run_dir(spark, 'records')}/responses"
    plan = generation_plan(human_essays(spark, sf), DRAWS, 2, 5).drop("id")
    W.write_records(records(batch_infer(plan, echo, "response", "string")), path)
    schema = (
        "id string, prompt string, temperature double, top_k long, guidance_scale double, "
        "penalty_alpha double, responses array<string>"
    )
    back = spark.read.schema(schema).json(path)
    return back.withColumns(
        {
            "temperature": F.round("temperature", 9),
            "guidance_scale": F.round("guidance_scale", 9),
            "penalty_alpha": F.round("penalty_alpha", 9),
            "responses": F.array_join("responses", "\x1e"),
        }
    )
