"""Batches, pairs and groups."""

from pyspark.sql import functions as F

from textprov.catalog.inputs import (
    SQL_ESSAYS, SQL_SCORED, SQL_TEXTS, corpus, essays, scored, texts,
)
from textprov.catalog.registry import query, sql_permuted, sql_position, sql_uniform, sql_words
from textprov.functions.tokens import words
from textprov.functions.vectors import sigmoid
from textprov.operators import batches as B, groups as G, pairs as P, tokens as K
from textprov.operators.losses import bce_term
from textprov.operators.sampling import hash_split
from textprov.session import materialize

BS = 16


def sql_batches(seed, source: str, bs: int = BS) -> str:
    return f"""epoch AS (
  SELECT id, pos // {bs} AS batch_id, pos % {bs} AS slot
  FROM (SELECT id, {sql_position(seed, 'id')} AS pos FROM {source}))"""


@query("batch_assign", f"WITH {SQL_TEXTS}, {sql_batches(42, 'texts')} SELECT * FROM epoch")
def batch_assign(spark, sf):
    return B.assign_batches(texts(spark, sf).select("id"), BS, 42)


def sql_prompt_batches(source: str, bs: int = BS) -> str:
    """CTEs up to ``mixed_batches``: the SQL twin of ``prompt_batches`` with seed 42."""
    return f"""{sql_batches('42:0', source, bs)},
sizes AS (SELECT prompt_id, count(*) AS n FROM {source} GROUP BY 1),
prompts AS (
  SELECT *, {sql_position('42:0:prompts', 'prompt_id')} AS prompt_no FROM sizes WHERE n >= {bs}),
chosen AS (
  SELECT batch_id, count(*) AS k, (SELECT count(*) FROM prompts) > 0
         AND {sql_uniform(42, "'swap'", "0", "batch_id")} < 0.8::DOUBLE AS swap
  FROM epoch GROUP BY batch_id),
picked AS (
  SELECT c.batch_id, c.k, p.prompt_id, p.n
  FROM chosen c JOIN prompts p ON p.prompt_no = floor(
    {sql_uniform('42:0', "'pick'", "c.batch_id")} * (SELECT count(*) FROM prompts))::BIGINT
  WHERE c.swap),
plan AS (
  SELECT *, {sql_permuted('slot', 'n', '42:0', 'batch_id')} AS rank
  FROM (SELECT *, unnest(range(k)) AS slot FROM picked)),
ranked AS (SELECT id, prompt_id, {sql_position('42:rank', 'id', by='prompt_id')} AS rank FROM {source}),
mixed_batches AS (
  SELECT e.batch_id, e.slot, e.id, false AS replaced
  FROM epoch e JOIN chosen c ON c.batch_id = e.batch_id WHERE NOT c.swap
  UNION ALL
  SELECT p.batch_id, p.slot, r.id, true FROM plan p
  JOIN ranked r ON r.prompt_id = p.prompt_id AND r.rank = p.rank)"""


@query(
    "prompt_batches",
    f"WITH {SQL_TEXTS}, {sql_prompt_batches('texts')} SELECT * FROM mixed_batches",
)
def prompt_batches(spark, sf):
    # The pick and permutation draws are keyed by seed and epoch.
    return B.prompt_batches(texts(spark, sf), BS, 42)


@query(
    "balanced_batches",
    f"""WITH {SQL_ESSAYS}, {sql_batches(42, 'essays', 4)},
sizes AS (
  SELECT prompt_id, count(*) FILTER (generated = 1) AS n_pos, count(*) FILTER (generated = 0) AS n_neg
  FROM essays GROUP BY 1),
prompts AS (
  SELECT *, {sql_position('42:prompts', 'prompt_id')} AS prompt_no FROM sizes
  WHERE n_pos >= 2 AND n_neg >= 2),
picked AS (
  SELECT b.batch_id, p.* FROM (SELECT DISTINCT batch_id FROM epoch) b
  JOIN prompts p ON p.prompt_no = floor(
    {sql_uniform(42, "'pick'", "b.batch_id")} * (SELECT count(*) FROM prompts))::BIGINT),
halves AS (
  SELECT batch_id, prompt_id, 1 AS generated, n_pos AS n FROM picked
  UNION ALL SELECT batch_id, prompt_id, 0, n_neg FROM picked),
plan AS (
  SELECT *, {sql_permuted('i', 'n', 42, 'generated', 'batch_id')} AS rank
  FROM (SELECT *, unnest(range(2)) AS i FROM halves)),
ranked AS (
  SELECT id, prompt_id, generated, {sql_position('42:rank', 'id', by='prompt_id, generated')} AS rank
  FROM essays)
SELECT p.batch_id, CASE WHEN p.generated = 1 THEN p.i ELSE p.i + 2 END AS slot,
       p.prompt_id, p.generated, r.id
FROM plan p JOIN ranked r ON r.prompt_id = p.prompt_id AND r.generated = p.generated
                         AND r.rank = p.rank""",
)
def balanced_batches(spark, sf):
    return B.balanced_batches(essays(spark, sf), 4, 42)


@query(
    "fetch_rows",
    f"""WITH {SQL_TEXTS}, {sql_batches(42, 'texts')}
        SELECT e.batch_id, e.slot, t.* FROM epoch e JOIN texts t ON t.id = e.id""",
)
def fetch_rows(spark, sf):
    t = texts(spark, sf)
    return B.fetch_rows(B.assign_batches(t.select("id"), BS, 42), t)


@query(
    "attach_truth",
    f"WITH {SQL_SCORED} SELECT id, round(p, 9) AS predictions, generated AS truths FROM probs",
)
def attach_truth(spark, sf):
    s = scored(spark, sf)
    predictions = s.select("id", F.round(sigmoid("logit"), 9).alias("predictions"))
    return P.attach_truth(predictions, essays(spark, sf).select("id", "generated"))


SQL_PAIRS = f"""human_ranked AS (
  SELECT id AS human_id, prompt_id, {sql_position('42:0', 'id', by='prompt_id')} AS rank
  FROM essays WHERE generated = 0),
ai_ranked AS (
  SELECT id AS ai_id, prompt_id, {sql_position('42:1', 'id', by='prompt_id')} AS rank
  FROM essays WHERE generated = 1),
sizes AS (SELECT prompt_id, count(*) FILTER (generated = 0) AS n0, count(*) FILTER (generated = 1) AS n1
          FROM essays GROUP BY 1),
slots AS (SELECT prompt_id, n0, n1, unnest(range(greatest(n0, n1))) AS rank FROM sizes WHERE n0 > 0 AND n1 > 0),
pairs AS (
  SELECT s.prompt_id, s.rank, h.human_id, a.ai_id FROM slots s
  JOIN human_ranked h ON h.prompt_id = s.prompt_id AND h.rank = s.rank % s.n0
  JOIN ai_ranked a ON a.prompt_id = s.prompt_id AND a.rank = s.rank % s.n1)"""


@query(
    "human_ai_pairs",
    f"WITH {SQL_ESSAYS}, {SQL_PAIRS} SELECT prompt_id, rank, human_id, ai_id FROM pairs",
)
def human_ai_pairs(spark, sf):
    return P.human_ai_pairs(essays(spark, sf), 42)


@query(
    "preference_pairs",
    f"""WITH {SQL_SCORED},
ends AS (
  SELECT prompt_id, max(logit) - min(logit) AS diff,
         arg_min(id, (-logit, id)) AS chosen_id, arg_min(id, (logit, id)) AS rejected_id
  FROM scored GROUP BY 1)
SELECT concat_ws('-', e.prompt_id, chosen_id, rejected_id) AS dpo_id,
       'src' || e.prompt_id AS prompt, c.text AS chosen, r.text AS rejected, diff
FROM ends e JOIN scored c ON c.id = chosen_id JOIN scored r ON r.id = rejected_id
WHERE diff > 0""",
)
def preference_pairs(spark, sf):
    s = scored(spark, sf).withColumn("prompt", F.concat(F.lit("src"), F.col("prompt_id")))
    return P.build_preferences(s, "logit")


def _sql_ids(keys: str, source: str) -> str:
    return f"""ranked AS (SELECT id, {keys}, {sql_position(3, 'id', by=keys)} AS rank FROM {source})
SELECT {keys}, rank // {BS} AS chunk, count(*)::INTEGER AS n,
       string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids
FROM ranked GROUP BY ALL"""


@query("ids_by_prompt", f"WITH {SQL_TEXTS}, {_sql_ids('prompt_id', 'texts')}")
def ids_by_prompt(spark, sf):
    out = G.ids_by_prompt(texts(spark, sf), BS, 3)
    return out.withColumn("ids", F.array_join("ids", ","))


@query("ids_by_prompt_class", f"WITH {SQL_ESSAYS}, {_sql_ids('prompt_id, generated', 'essays')}")
def ids_by_prompt_class(spark, sf):
    out = G.ids_by_prompt_class(essays(spark, sf), BS, 3)
    return out.withColumn("ids", F.array_join("ids", ","))


@query("distinct_prompts", f"WITH {SQL_TEXTS} SELECT DISTINCT prompt_id FROM texts")
def distinct_prompts(spark, sf):
    return G.distinct_prompts(texts(spark, sf))


@query(
    "fold_profile",
    f"""SELECT CASE WHEN {sql_uniform(42, 'doc_id')} < 0.98::DOUBLE THEN 'train' ELSE 'valid' END AS fold,
               count(*) AS n_rows, 4::BIGINT AS n_columns
        FROM documents GROUP BY 1""",
)
def fold_profile(spark, sf):
    return G.profile(hash_split(texts(spark, sf), 0.98, 42))


@query(
    "mean_loss",
    f"""WITH {SQL_SCORED}, {sql_batches(42, 'scored')},
losses AS (
  SELECT e.batch_id, avg(greatest(logit, 0) - logit * generated + ln(1 + exp(-abs(logit)))) AS m
  FROM scored s JOIN epoch e ON e.id = s.id GROUP BY 1)
SELECT round(avg(m), 6) AS valid_loss, count(*) AS n_batches FROM losses""",
)
def mean_loss(spark, sf):
    s = materialize(
        scored(spark, sf).select("id", bce_term("logit", "generated").alias("loss")), "losses"
    )
    out = G.mean_loss(B.assign_batches(s, BS, 42))
    return out.withColumn("valid_loss", F.round("valid_loss", 6))


SQL_BY_LENGTH = f"""sized AS (SELECT id, len({sql_words('text')})::INTEGER AS input_length FROM texts),
placed AS (
  SELECT *, {sql_position(42, 'id', first='input_length')} AS pos FROM sized)"""


def sized(spark, sf):
    """Token lengths, stored as a tokenized table would have them."""
    return materialize(
        corpus(spark, sf).select("id", F.size(words("text")).alias("input_length")), "lengths"
    )


@query(
    "length_order",
    f"""WITH {SQL_TEXTS}, {SQL_BY_LENGTH}
        SELECT id, input_length, pos // {BS} AS batch_id, pos % {BS} AS slot FROM placed""",
)
def length_order(spark, sf):
    return B.assign_batches(sized(spark, sf), BS, 42, first=(F.col("input_length"),))


@query(
    "length_order_nulls",
    f"""WITH {SQL_TEXTS},
sized AS (SELECT id, CASE WHEN id % 13 <> 4 THEN len({sql_words('text')})::INTEGER END AS input_length FROM texts),
placed AS (
  SELECT *, {sql_position(42, 'id', first='input_length NULLS FIRST')} AS pos FROM sized)
SELECT id, input_length, pos // {BS} AS batch_id, pos % {BS} AS slot FROM placed""",
)
def length_order_nulls(spark, sf):
    """Rows without a length come first."""
    rows = sized(spark, sf).withColumn("input_length", F.when(F.col("id") % 13 != 4, F.col("input_length")))
    return B.assign_batches(rows, BS, 42, first=(F.col("input_length"),))


@query(
    "pad_length",
    f"""WITH {SQL_TEXTS}, {SQL_BY_LENGTH}
        SELECT pos // {BS} AS batch_id, (ceil(max(input_length) / 64.0) * 64)::INTEGER AS padded_length
        FROM placed GROUP BY 1""",
)
def pad_length(spark, sf):
    return K.pad_length(
        B.assign_batches(sized(spark, sf), BS, 42, first=(F.col("input_length"),))
    )
