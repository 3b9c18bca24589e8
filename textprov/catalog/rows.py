"""Filters, projections, splits and samples."""

from pyspark.sql import functions as F

from textprov.catalog.inputs import (
    SQL_ESSAYS, SQL_HUMAN, SQL_SCORED, SQL_TEXTS, essays, human_essays, scored, table, texts,
)
from textprov.catalog.registry import query, sql_position, sql_uniform
from textprov.functions.text import instruction
from textprov.functions.vectors import sigmoid
from textprov.operators import rows as R, sampling as S

NEEDLES = [*R.PROMPT_NEEDLES, ("Task: fr", False), ("prompt: src1\n", True)]


@query(
    "drop_null_text",
    """SELECT doc_id AS id, text FROM documents WHERE source <> 'src7'""",
)
def drop_null_text(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("source") != "src7", F.col("text")).alias("text")
    )
    return R.drop_null_text(d)


@query(
    "fill_defaults",
    f"WITH {SQL_HUMAN} SELECT * FROM filled",
)
def fill_defaults(spark, sf):
    return R.fill_defaults(R.drop_null_text(human_essays(spark, sf)))


@query(
    "class_filter",
    f"WITH {SQL_ESSAYS} SELECT id, prompt_id, text FROM essays WHERE generated = 1",
)
def class_filter(spark, sf):
    return R.by_class(essays(spark, sf), 1).select("id", "prompt_id", "text")


@query(
    "prompt_filter",
    f"WITH {SQL_TEXTS} SELECT id, prompt_id, text FROM texts WHERE prompt_id <= 8",
)
def prompt_filter(spark, sf):
    return R.limit_prompts(texts(spark, sf)).select("id", "prompt_id", "text")


@query(
    "prompt_exclude",
    f"""WITH {SQL_HUMAN} SELECT id, instruction AS prompt FROM instructed
        WHERE NOT (contains(instruction, 'Task: Text dependent')
                   OR contains(lower(instruction), 'car-free')
                   OR contains(lower(instruction), 'facial action')
                   OR contains(lower(instruction), 'electoral')
                   OR contains(instruction, 'Task: fr')
                   OR contains(lower(instruction), 'prompt: src1' || chr(10)))""",
)
def prompt_exclude(spark, sf):
    filled = R.fill_defaults(R.drop_null_text(human_essays(spark, sf)))
    return R.exclude_prompts(filled.select("id", instruction().alias("prompt")), NEEDLES)


@query(
    "prompt_include",
    f"""WITH {SQL_HUMAN} SELECT id, instruction AS prompt FROM instructed
        WHERE contains(instruction, 'Task: fr')""",
)
def prompt_include(spark, sf):
    filled = R.fill_defaults(R.drop_null_text(human_essays(spark, sf)))
    return R.include_prompts(
        filled.select("id", instruction().alias("prompt")), [("Task: fr", False)]
    )


@query("project", f"WITH {SQL_ESSAYS} SELECT id, generated, prompt_id FROM essays")
def project(spark, sf):
    return R.project(essays(spark, sf), ["id", "generated", "prompt_id"])


@query(
    "drop_if_present",
    f"WITH {SQL_ESSAYS} SELECT id, generated FROM essays",
)
def drop_if_present(spark, sf):
    return R.drop_if_present(essays(spark, sf), "text", "prompt_id", "__index_level_0__")


@query("submission", f"WITH {SQL_SCORED} SELECT id, round(p, 9) AS generated FROM probs")
def submission(spark, sf):
    s = scored(spark, sf).withColumn("predictions", F.round(sigmoid("logit"), 9))
    return R.to_submission(s.drop("generated"))


@query(
    "union_classes",
    f"WITH {SQL_ESSAYS} SELECT id, generated FROM essays WHERE generated IN (0, 1)",
)
def union_classes(spark, sf):
    e = essays(spark, sf).select("id", "generated")
    return R.union_classes(R.by_class(e, 1), R.by_class(e, 0))


@query(
    "hash_split",
    f"""SELECT doc_id AS id,
               CASE WHEN {sql_uniform(42, 'doc_id')} < 0.98::DOUBLE THEN 'train' ELSE 'valid' END AS fold
        FROM documents""",
)
def hash_split(spark, sf):
    return S.hash_split(texts(spark, sf).select("id"), 0.98, 42)


@query(
    "fold_filter",
    f"""WITH {SQL_ESSAYS} SELECT id, generated, 'valid' AS fold FROM essays
        WHERE {sql_uniform(42, 'id')} >= 0.8::DOUBLE""",
)
def fold_filter(spark, sf):
    e = essays(spark, sf).select("id", "generated")
    return R.by_fold(S.hash_split(e, 0.8, 42), "valid")


@query(
    "sample_n",
    f"""SELECT id, pos FROM (SELECT doc_id AS id, {sql_position(7, 'doc_id')} AS pos FROM documents)
        WHERE pos < 300""",
)
def sample_n(spark, sf):
    return S.sample_n(texts(spark, sf).select("id"), 300, 7)


@query(
    "epoch_shuffle",
    f"SELECT doc_id AS id, {sql_position('42:3', 'doc_id')} AS pos FROM documents",
)
def epoch_shuffle(spark, sf):
    return S.epoch_order(texts(spark, sf).select("id"), 42, 3)


DRAWS = 256
SQL_DRAWS = f"""numbered AS (
  SELECT id, {sql_position('5:order', 'id')} AS pos FROM filled),
draws AS (
  SELECT g.range AS draw, n.id FROM range({DRAWS}) g JOIN numbered n
  ON n.pos = floor({sql_uniform(5, "'draw'", 'g.range')} * (SELECT count(*) FROM numbered))::BIGINT)"""


@query("draw_prompts", f"WITH {SQL_HUMAN}, {SQL_DRAWS} SELECT draw, id FROM draws")
def draw_prompts(spark, sf):
    return S.draw_prompts(R.drop_null_text(human_essays(spark, sf)), DRAWS, 5)


def sql_knobs(seed, key: str) -> str:
    def u(name):
        return sql_uniform(seed, f"'{name}'", key)

    return f"""
      'e_' || substr(md5(concat_ws(':', '{seed}', 'record', {key})), 1, 8) AS record_id,
      round(0.5::DOUBLE + 1.5::DOUBLE * {u('temperature')}, 9) AS temperature,
      (128 + floor({u('top_k')} * 129.0::DOUBLE))::INTEGER AS top_k,
      round({u('penalty_alpha')}, 9) AS penalty_alpha,
      round(1.0::DOUBLE + 0.25::DOUBLE * {u('guidance_scale')}, 9) AS guidance_scale,
      round(0.0001::DOUBLE + 0.0005::DOUBLE * {u('eta_cutoff')}, 9) AS eta_cutoff"""


def round_knobs(df):
    names = ["temperature", "penalty_alpha", "guidance_scale", "eta_cutoff"]
    return df.withColumns({n: F.round(n, 9) for n in names if n in df.columns})


@query("sample_knobs", f"SELECT doc_id AS id, {sql_knobs(11, 'doc_id')} FROM documents")
def sample_knobs(spark, sf):
    return round_knobs(S.sample_knobs(texts(spark, sf).select("id"), 11, "id"))


@query(
    "constant_knobs",
    """SELECT doc_id AS id, 'e_' || substr(md5(concat_ws(':', '11', 'record', doc_id)), 1, 8) AS record_id,
              1.5::DOUBLE AS temperature, 512::INTEGER AS top_k, 0.5::DOUBLE AS penalty_alpha,
              1.1::DOUBLE AS guidance_scale FROM documents""",
)
def constant_knobs(spark, sf):
    return S.sample_knobs(texts(spark, sf).select("id"), 11, "id", S.CONSTANT_KNOBS)
