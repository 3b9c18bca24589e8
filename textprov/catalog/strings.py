"""Text formats, clean-up and generation plans."""

from pyspark.sql import functions as F

from textprov.catalog.inputs import SQL_ANSWERS, SQL_HUMAN, answers, human_essays, table
from textprov.catalog.registry import query, sql_uniform
from textprov.catalog.rows import DRAWS, SQL_DRAWS, round_knobs, sql_knobs
from textprov.functions import text as X
from textprov.functions.text import PY_WHITESPACE
from textprov.operators.infer import expand_prompts, generation_plan, with_generation_prompt
from textprov.operators.rows import drop_null_text, fill_defaults

# Blanks of several kinds put around the texts, so that stripping has work to do.
LEAD, TAIL = "\t  　\x1c", "\r\n  \x1f\u0085"


def _sql_chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


SQL_WHITE = _sql_chars(PY_WHITESPACE)
SQL_WRAPPED = f"""wrapped AS (
  SELECT doc_id AS id, {_sql_chars(LEAD)} || text || {_sql_chars(TAIL)} AS text FROM documents)"""


def wrapped(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit(LEAD), "text", F.lit(TAIL)).alias("text")
    )


@query("py_strip", f"WITH {SQL_WRAPPED} SELECT id, trim(text, {SQL_WHITE}) AS text FROM wrapped")
def py_strip(spark, sf):
    return wrapped(spark, sf).withColumn("text", X.py_strip("text"))


@query(
    "add_question",
    f"""WITH {SQL_WRAPPED}
        SELECT id, trim(text, {SQL_WHITE}) || chr(10) || '###' || chr(10) ||
               'Is the essay generated by AI?' AS text FROM wrapped""",
)
def add_question(spark, sf):
    return wrapped(spark, sf).withColumn("text", X.add_question("text"))


@query("instruction", f"WITH {SQL_HUMAN} SELECT id, instruction FROM instructed")
def instruction(spark, sf):
    filled = fill_defaults(drop_null_text(human_essays(spark, sf)))
    return filled.select("id", X.instruction().alias("instruction"))


SQL_SOURCE = """'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response: '"""


@query("format_source", f"WITH {SQL_ANSWERS} SELECT id, {SQL_SOURCE} AS source FROM answers")
def format_source(spark, sf):
    return answers(spark, sf).select("id", X.format_source("instruction").alias("source"))


@query(
    "chat_format",
    f"WITH {SQL_ANSWERS} SELECT id, {SQL_SOURCE} || text || ' </s>' AS chat FROM answers",
)
def chat_format(spark, sf):
    return answers(spark, sf).select("id", X.format_chat("instruction", "text").alias("chat"))


def _sql_prompt(seed, lo: int, hi: int) -> str:
    n = f"({lo} + floor({sql_uniform(seed, chr(39) + 'chars' + chr(39), 'id')} * {hi - lo + 1}.0::DOUBLE))::BIGINT"
    return f"{SQL_SOURCE} || substr(text, 1, {n})"


def _prompted(spark, sf, lo, hi):
    filled = fill_defaults(drop_null_text(human_essays(spark, sf)))
    return with_generation_prompt(filled, 5, lo, hi).select("id", "prompt")


@query("generation_prompt", f"WITH {SQL_HUMAN} SELECT id, {_sql_prompt(5, 16, 64)} AS prompt FROM instructed")
def generation_prompt(spark, sf):
    return _prompted(spark, sf, 16, 64)


@query(
    "generation_prompt_long",
    f"WITH {SQL_HUMAN} SELECT id, {_sql_prompt(5, 64, 128)} AS prompt FROM instructed",
)
def generation_prompt_long(spark, sf):
    return _prompted(spark, sf, 64, 128)


# Answers as a model would decode them: prompt, marker, text, and one of several ends.
SQL_RAW = f"""raw AS (
  SELECT id, CASE id % 5
    WHEN 0 THEN {SQL_SOURCE} || text || ' </s> more </s>'
    WHEN 1 THEN {SQL_SOURCE} || text || chr(10) || '<|endoftext|> more'
    WHEN 2 THEN 'a </s> b ' || {SQL_SOURCE} || '<unk> ' || text || ' <unk><|endoftext|>'
    WHEN 3 THEN chr(9) || text || chr(160)
    ELSE {SQL_SOURCE} || text || '### Response: ' || text || '</s>' END AS response
  FROM answers)"""


def raw_answers(spark, sf):
    a = answers(spark, sf)
    source, text = X.format_source("instruction"), F.col("text")
    kind = F.col("id") % 5
    response = (
        F.when(kind == 0, F.concat(source, text, F.lit(" </s> more </s>")))
        .when(kind == 1, F.concat(source, text, F.lit("\n<|endoftext|> more")))
        .when(kind == 2, F.concat(F.lit("a </s> b "), source, F.lit("<unk> "), text, F.lit(" <unk><|endoftext|>")))
        .when(kind == 3, F.concat(F.lit("\t"), text, F.lit(" ")))
        .otherwise(F.concat(source, text, F.lit("### Response: "), text, F.lit("</s>")))
    )
    return a.select("id", response.alias("response"))


SQL_CLEAN = f"""replace(trim(string_split(string_split(response, '### Response:')[-1],
    CASE WHEN contains(response, '</s>') THEN '</s>' ELSE '<|endoftext|>' END)[1], {SQL_WHITE}), '<unk>', '')"""


@query(
    "clean_response",
    f"WITH {SQL_ANSWERS}, {SQL_RAW} SELECT id, {SQL_CLEAN} AS response FROM raw",
)
def clean_response(spark, sf):
    return raw_answers(spark, sf).withColumn("response", X.clean_response("response"))


@query(
    "clean_responses",
    f"""WITH {SQL_ANSWERS}, {SQL_RAW}, clean AS (SELECT id, {SQL_CLEAN} AS r FROM raw)
        SELECT id, r || chr(30) || r AS responses FROM clean""",
)
def clean_responses(spark, sf):
    lists = raw_answers(spark, sf).select("id", F.array_repeat("response", 2).alias("responses"))
    return lists.select(
        "id", F.array_join(X.clean_responses("responses"), "\x1e").alias("responses")
    )


@query(
    "expand_prompts",
    f"WITH {SQL_HUMAN} SELECT id, instruction AS prompt, unnest([1, 2, 3, 4]) AS copy FROM instructed",
)
def expand(spark, sf):
    filled = fill_defaults(drop_null_text(human_essays(spark, sf)))
    return expand_prompts(filled.select("id", X.instruction().alias("prompt")), 4)


@query(
    "generation_plan",
    f"""WITH {SQL_HUMAN}, {SQL_DRAWS},
prompted AS (SELECT id, {_sql_prompt(5, 16, 64)} AS prompt FROM instructed)
SELECT d.draw, d.id, p.prompt, {sql_knobs(5, 'd.draw')}, unnest([1, 2, 3, 4]) AS copy
FROM draws d JOIN prompted p ON p.id = d.id""",
)
def plan(spark, sf):
    return round_knobs(generation_plan(human_essays(spark, sf), DRAWS, 4, 5))
