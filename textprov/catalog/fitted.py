"""Fitted models and functions of the user's own."""

import math

from pyspark.sql import functions as F

from textprov.catalog.batches import SQL_PAIRS, sql_prompt_batches
from textprov.catalog.inputs import SQL_ESSAYS, SQL_SCORED, SQL_TEXTS, corpus, essays, scored, texts
from textprov.catalog.registry import query, sql_draw, sql_uniform, sql_words
from textprov.catalog.scores import _sql_auc as sql_auc, sql_ranking
from textprov.catalog.strings import SQL_WHITE
from textprov.functions.text import add_question
from textprov.models.contrast import embed_learned, fit_contrastive
from textprov.models.detector import fit_best, fit_detector, score
from textprov.models.ranker import fit_ranker, rank_score
from textprov.models.sparse import BETA1, BETA2, COUNT, EPSILON, PAIR, PART, VALUE, WEIGHT, describe
from textprov.operators.infer import batch_infer, map_columns
from textprov.operators.neighbours import knn_approx
from textprov.plans.contrast import contrastive_losses, ranking_losses
from textprov.plans.detect import pair_texts, split_essays
from textprov.session import materialize

FEATURES = 1 << 15


STEPS = 6


def _sql_rows(source: str, n: int, out: str, *also: str) -> str:
    """Sparse rows of ``source``, with ``id, text`` and the columns ``also``: ``out(id, f, x)``."""
    keep = "".join(f", {c}" for c in also)
    return f"""{out}_words AS (
  SELECT id, unnest(w) AS t, unnest(range(len(w))) AS i
  FROM (SELECT id, {sql_words("lower(coalesce(text, ''))")} AS w FROM {source})),
{out}_hashes AS (SELECT t, {sql_draw("feature", "t")} AS h FROM (SELECT DISTINCT t FROM {out}_words)),
{out}_hits AS (
  SELECT id, h, lead(h) OVER (PARTITION BY id ORDER BY i) AS after FROM {out}_words JOIN {out}_hashes USING (t)),
{out}_counts AS (
  SELECT id, f, floor({COUNT} * (1.0::DOUBLE + ln(count(*))) + 0.5) AS v FROM (
    SELECT id, h % {n} AS f FROM {out}_hits
    UNION ALL SELECT id, ((h & {PART}) * {PAIR} + (after & {PART})) % {n} FROM {out}_hits WHERE after IS NOT NULL)
  GROUP BY ALL),
{out}_sizes AS (SELECT id, sqrt(sum(v * v)) AS s FROM {out}_counts GROUP BY id),
{out} AS MATERIALIZED (
  SELECT id, f, floor({VALUE} * v / s + 0.5) AS x FROM {out}_counts JOIN {out}_sizes USING (id)
  UNION ALL SELECT id, {n}, {VALUE} FROM {source})"""


def _sql_steps(rows: str, n: str, steps: int, grid: list[tuple[float, float]], residual: str) -> str:
    """Tables ``w0 .. w<steps>`` of weights by run and feature, from ``rows(id, f, x, y)``."""
    d = lambda x: f"{x!r}::DOUBLE"
    runs = ", ".join(f"({i}, {d(reg)}, {d(rate)})" for i, (reg, rate) in enumerate(grid))
    out = f"""runs(run, reg, rate) AS (VALUES {runs}),
w0 AS MATERIALIZED (
  SELECT run, reg, rate, f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
  FROM runs CROSS JOIN (SELECT DISTINCT f FROM {rows}))"""
    for k in range(1, steps + 1):
        c1, c2 = d(1 - math.pow(BETA1, k)), d(1 - math.pow(BETA2, k))
        out += f""",
z{k} AS MATERIALIZED (
  SELECT run, id, y, sum(x * floor(w * {WEIGHT} + 0.5)) / {float(VALUE * WEIGHT)}::DOUBLE AS z
  FROM {rows} JOIN w{k - 1} USING (f) GROUP BY run, id, y),
g{k} AS MATERIALIZED (
  SELECT run, f, sum(x * floor(({residual}) * {WEIGHT} + 0.5)) / ({float(VALUE * WEIGHT)}::DOUBLE * {n}) AS g
  FROM {rows} JOIN z{k} USING (id, y) GROUP BY run, f),
m{k} AS MATERIALIZED (
  SELECT run, reg, rate, f, w, {d(BETA1)} * m + {d(1 - BETA1)} * (g + reg * w) AS m,
         {d(BETA2)} * v + {d(1 - BETA2)} * ((g + reg * w) * (g + reg * w)) AS v
  FROM w{k - 1} JOIN g{k} USING (run, f)),
w{k} AS MATERIALIZED (
  SELECT run, reg, rate, f, w - rate * (m / {c1}) / (sqrt(v / {c2}) + {d(EPSILON)}) AS w, m, v FROM m{k})"""
    return out


SQL_FOLDS = f"""{SQL_ESSAYS},
folded AS (SELECT *, {sql_uniform(42, 'id')} < 0.8::DOUBLE AS train FROM essays WHERE text IS NOT NULL)"""
SQL_LOGISTIC = "1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - y"
SQL_QUESTION = f"trim(text, {SQL_WHITE}) || chr(10) || '###' || chr(10) || 'Is the essay generated by AI?'"


@query(
    "detector_scores",
    f"""WITH {SQL_FOLDS},
asked AS (SELECT id, prompt_id, {SQL_QUESTION} AS text FROM texts),
{_sql_rows("asked", FEATURES, "sparse")},
xt AS MATERIALIZED (SELECT s.id, f, x, generated AS y FROM sparse s JOIN folded USING (id) WHERE train),
{_sql_steps("xt", "(SELECT count(*) FROM folded WHERE train)", STEPS, [(1e-5, 0.1)], SQL_LOGISTIC)},
logits AS (
  SELECT id, sum(x * floor(coalesce(w, 0) * {WEIGHT} + 0.5)) / {float(VALUE * WEIGHT)}::DOUBLE AS logit
  FROM sparse LEFT JOIN w{STEPS} USING (f) GROUP BY id)
SELECT id, prompt_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 9) AS predictions, logit
FROM logits JOIN asked USING (id)""",
)
def detector_scores(spark, sf):
    """Fit on the labelled train fold, score every document, labelled or not."""
    train, _ = split_essays(essays(spark, sf), 0.8)
    model = fit_detector(train.withColumn("text", add_question("text")), FEATURES, steps=STEPS)
    asked = corpus(spark, sf).withColumn("text", add_question("text"))
    return score(model, asked).select("id", "prompt_id", F.round("predictions", 9).alias("predictions"), "logit")


GRID = [(1e-5, 0.1), (1e-2, 0.1), (1e-5, 0.02)]
EVERY, PATIENCE = 2, 1


def _sql_search() -> str:
    """The log of all looks, and of each run those up to its stop."""
    looks = range(EVERY, STEPS + 1, EVERY)
    held = " UNION ALL ".join(
        f"""SELECT run * 1000 + {k} AS place, y AS generated,
               sum(x * floor(coalesce(w, 0) * {WEIGHT} + 0.5)) / {float(VALUE * WEIGHT)}::DOUBLE AS logit
        FROM (SELECT * FROM xv CROSS JOIN runs) LEFT JOIN w{k} USING (run, f) GROUP BY run, id, y"""
        for k in looks
    )
    names = " ".join(
        f"WHEN {i} THEN '{describe({'reg': reg, 'rate': rate})}'" for i, (reg, rate) in enumerate(GRID)
    )
    return f"""WITH {SQL_FOLDS},
{_sql_rows("folded", FEATURES, "sparse")},
labelled AS MATERIALIZED (SELECT s.id, f, x, generated AS y, train FROM sparse s JOIN folded USING (id)),
xt AS MATERIALIZED (SELECT id, f, x, y FROM labelled WHERE train),
xv AS MATERIALIZED (SELECT id, f, x, y FROM labelled WHERE NOT train),
{_sql_steps("xt", "(SELECT count(*) FROM folded WHERE train)", STEPS, GRID, SQL_LOGISTIC)},
held AS MATERIALIZED (SELECT *, logit AS p FROM ({held})),
{sql_auc("held", "place")},
looks AS (SELECT place // 1000 AS run, place % 1000 AS step, auc AS metric FROM areas),
led AS (SELECT *, max(metric) OVER w AS best, row_number() OVER w AS place
        FROM looks WINDOW w AS (PARTITION BY run ORDER BY step)),
judged AS (SELECT *, metric = best AS is_best,
                  place - max(CASE WHEN metric = best THEN place END) OVER (PARTITION BY run ORDER BY step) AS patience
           FROM led),
stops AS (SELECT run, min(step) AS stop FROM judged WHERE patience >= {PATIENCE} GROUP BY run)
SELECT CASE run {names} END AS run, step, metric, best, is_best, patience
FROM judged LEFT JOIN stops USING (run) WHERE stop IS NULL OR step <= stop"""


@query("detector_search", _sql_search())
def detector_search(spark, sf):
    """Three settings trained on the same scans, each until its holdout AUC stops rising."""
    train, valid = split_essays(essays(spark, sf), 0.8)
    grid = [{"reg": reg, "rate": rate} for reg, rate in GRID]
    return fit_best(train, valid, grid, PATIENCE, FEATURES, STEPS, EVERY).log


RANK_FEATURES = 1 << 16


@query(
    "ranker_scores",
    f"""WITH {SQL_FOLDS}, essays_ AS (SELECT * FROM folded WHERE train),
{SQL_PAIRS.replace("FROM essays", "FROM essays_")},
{_sql_rows("texts", RANK_FEATURES, "sparse")},
stripped AS (SELECT id, trim(text, {SQL_WHITE}) AS text FROM essays_),
{_sql_rows("stripped", RANK_FEATURES, "own")},
gaps AS MATERIALIZED (
  SELECT id, f, sum(x) AS x, 1 AS y FROM (
    SELECT concat_ws('-', human_id, ai_id) AS id, f, x FROM pairs JOIN own ON own.id = ai_id
    UNION ALL SELECT concat_ws('-', human_id, ai_id), f, -x FROM pairs JOIN own ON own.id = human_id) GROUP BY id, f),
{_sql_steps("gaps", "(SELECT count(*) FROM pairs)", STEPS, [(1e-5, 0.1)], "CASE WHEN z < 0.7::DOUBLE THEN -1 ELSE 0 END")}
SELECT id, prompt_id, logit FROM texts JOIN (
  SELECT id, sum(x * floor(coalesce(w, 0) * {WEIGHT} + 0.5)) / {float(VALUE * WEIGHT)}::DOUBLE AS logit
  FROM sparse LEFT JOIN w{STEPS} USING (f) GROUP BY id) USING (id)""",
)
def ranker_scores(spark, sf):
    """Fit on pairs of the train fold by the pairwise margin, score every document."""
    train, _ = split_essays(essays(spark, sf), 0.8)
    model = fit_ranker(pair_texts(train), RANK_FEATURES, steps=STEPS)
    return rank_score(model, corpus(spark, sf)).select("id", "prompt_id", "logit")


@query("text_neighbours")
def text_neighbours(spark, sf):
    """The essays most like each essay, by text vectors trained on the labelled ones."""
    model, _ = fit_contrastive(essays(spark, sf), 1 << 12, 16, batch_size=4, steps=6)
    t = corpus(spark, sf).select("id", "text")
    vectors = materialize(embed_learned(model, t).drop("text"), "vectors")
    return knn_approx(vectors, vectors, 3)


@query("embedder_log")
def embedder_log(spark, sf):
    """The mean contrastive loss before each step of training."""
    _, log = fit_contrastive(essays(spark, sf), 1 << 12, 16, batch_size=4, steps=6)
    return spark.createDataFrame(log, "step long, loss double").withColumn("loss", F.round("loss", 6))


@query("contrastive_losses")
def contrastive(spark, sf):
    return contrastive_losses(essays(spark, sf), 4)


@query(
    "ranking_losses",
    f"""WITH {SQL_SCORED}, {sql_prompt_batches('probs', 8)},
placed AS (SELECT b.batch_id, s.* FROM probs s JOIN mixed_batches b ON b.id = s.id)
{sql_ranking('placed', 'batch_id')}""",
)
def ranking(spark, sf):
    out = ranking_losses(scored(spark, sf).drop("text"), 8)
    return out.withColumn("loss", F.round("loss", 6))


@query(
    "batch_map",
    f"WITH {SQL_TEXTS} SELECT id, text || '|' || length(text)::VARCHAR AS text FROM texts",
)
def batch_map(spark, sf):
    def load():
        import pyarrow as pa
        import pyarrow.compute as pc

        def with_length(text):
            return pc.binary_join_element_wise(text, pc.utf8_length(text).cast(pa.string()), "|")

        return with_length

    return map_columns(texts(spark, sf).select("id", "text"), load, ["text"], "text", "string")


@query(
    "batch_infer",
    f"""WITH {SQL_TEXTS}
SELECT id, prompt_id,
       CASE WHEN prompt_id <> 5 THEN md5(text) || chr(30) || length(text)::VARCHAR END AS responses,
       CASE WHEN prompt_id = 5 THEN 'ValueError: no answer' END AS error
FROM texts""",
)
def infer(spark, sf):
    # A stand-in for a model that cannot answer texts of one prompt. Nested, so that
    # it reaches the tasks by value.
    def fussy():
        import hashlib

        def run(batch):
            if (batch["prompt_id"] == 5).any():
                raise ValueError("no answer")
            return [[hashlib.md5(t.encode()).hexdigest(), str(len(t))] for t in batch["text"]]

        return run

    out = batch_infer(texts(spark, sf), fussy)
    return out.select("id", "prompt_id", F.array_join("responses", "\x1e").alias("responses"), "error")
