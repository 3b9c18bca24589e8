"""The roles the given tables play in the queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprov.catalog.registry import sql_words
from textprov.functions.tokens import words
from textprov.sources.readers import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as essays: ``id, text, prompt_id``, labelled or not."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.expr("cast(substring(source, 4) as int)").alias("prompt_id"),
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``texts`` for work on every word, on all cores."""
    return spread(texts(spark, sf), "id")


def essays(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled essays: ``id, text, prompt_id, generated``."""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("generated")
    )
    return corpus(spark, sf).join(labels, "id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled essays with a closed-form ``logit`` over the whole text."""
    n = F.size(words("text")) * 7 + F.length("text")
    return essays(spark, sf).withColumn(
        "logit",
        (F.pmod(n, F.lit(41)) - 20) / F.lit(8.0) + F.col("generated") * F.lit(0.5),
    )


def human_essays(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as human essays; labels are scores, missing for most."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("source").alias("prompt_name"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("task"),
        F.col("quality").cast("double").alias("holistic_essay_score"),
        (F.col("toxic") + F.lit(8.5)).cast("double").alias("grade_level"),
        F.when(F.col("lang") == "en", "No").when(F.col("lang") == "de", "Yes").alias("ell_status"),
        F.when(F.col("source") != "src3", "Not identified").alias("student_disability_status"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's next turn: ``id, instruction, text``."""
    turns = table(spark, sf, "conversations")
    ask = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("instruction")
    )
    reply = turns.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return ask.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "instruction", "text"
    )


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """``run, step, metric, n``, the metric as an exact decimal."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        F.col("value").cast("decimal(18,2)").alias("metric"),
        F.length("event_type").cast("bigint").alias("n"),
    )


SQL_TEXTS = """texts AS (
  SELECT doc_id AS id, text, CAST(substr(source, 4) AS INTEGER) AS prompt_id FROM documents)"""
SQL_ESSAYS = f"""{SQL_TEXTS},
essays AS (SELECT t.*, l.quality AS generated FROM texts t JOIN labels l ON l.doc_id = t.id)"""
SQL_SCORED = f"""{SQL_ESSAYS},
scored AS (
  SELECT *, ((len({sql_words('text')}) * 7 + length(text)) % 41 - 20)::DOUBLE / 8.0::DOUBLE
            + generated * 0.5::DOUBLE AS logit FROM essays),
probs AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p FROM scored)"""
SQL_HUMAN = """human AS (
  SELECT d.doc_id AS id, d.text, d.source AS prompt_name,
         CASE WHEN d.lang <> 'es' THEN d.lang END AS task,
         l.quality::DOUBLE AS holistic_essay_score,
         (l.toxic + 8.5)::DOUBLE AS grade_level,
         CASE d.lang WHEN 'en' THEN 'No' WHEN 'de' THEN 'Yes' END AS ell_status,
         CASE WHEN d.source <> 'src3' THEN 'Not identified' END AS student_disability_status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
filled AS (
  SELECT id, text, prompt_name, task,
         coalesce(holistic_essay_score, -1) AS holistic_essay_score,
         coalesce(grade_level, -1) AS grade_level,
         coalesce(ell_status, 'Unknown') AS ell_status,
         coalesce(student_disability_status, 'Unknown') AS student_disability_status
  FROM human WHERE text IS NOT NULL),
instructed AS (
  SELECT *, 'Prompt: ' || coalesce(prompt_name, 'nan') || chr(10) ||
            'Task: ' || coalesce(task, 'nan') || chr(10) ||
            'Score: ' || CASE WHEN holistic_essay_score = floor(holistic_essay_score)
                              THEN holistic_essay_score::BIGINT::VARCHAR
                              ELSE holistic_essay_score::VARCHAR END || chr(10) ||
            'Student Grade Level: ' || CASE WHEN grade_level = floor(grade_level)
                              THEN grade_level::BIGINT::VARCHAR
                              ELSE grade_level::VARCHAR END || chr(10) ||
            'English Language Learner: ' || ell_status || chr(10) ||
            'Disability Status: ' || student_disability_status AS instruction
  FROM filled)"""
SQL_ANSWERS = """answers AS (
  SELECT u.conv_id * 1000 + a.turn AS id, u.text AS instruction, a.text AS text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
SQL_LOG = """log AS (
  SELECT user_id AS run, event_id AS step, value::DECIMAL(18,2) AS metric,
         length(event_type)::BIGINT AS n FROM events)"""
