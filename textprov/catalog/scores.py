"""Vectors, losses and metrics."""

from pyspark.sql import functions as F

from textprov.catalog.batches import SQL_PAIRS, sql_batches
from textprov.catalog.inputs import SQL_SCORED, scored, table
from textprov.catalog.registry import query, sql_draw, sql_position, sql_uniform
from textprov.functions import vectors as V
from textprov.operators import (
    batches as B, losses as L, metrics as M, neighbours as N, pairs as P, vectors as X,
)
from textprov.operators.neighbours import PER_CELL, QUERIES, ROUNDS, SCALE
from textprov.plans.detect import fold_auc


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label")
    )


def _digits(c: str, digits: int = 5):
    return F.array_join(F.transform(c, lambda x: F.format_string("%.5f", F.round(x, digits) + F.lit(0.0))), ",")


def _sql_digits(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: printf('%.5f', round(x, 5) + 0.0::DOUBLE)), ',')"


@query(
    "mean_pool",
    f"""WITH each AS (
  SELECT label, (vec_id % 3 <> 0)::INTEGER AS m, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i
  FROM embeddings),
pooled AS (SELECT label, i, sum(x * m) / greatest(sum(m), 1e-9::DOUBLE) AS x FROM each GROUP BY 1, 2),
rows AS (SELECT label AS key, list(x ORDER BY i) AS v FROM pooled GROUP BY 1)
SELECT key, {_sql_digits('v')} AS pooled FROM rows""",
)
def mean_pool(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("key"), "embedding", (F.col("vec_id") % 3 != 0).cast("int").alias("mask")
    )
    out = X.mean_pool(e, "key", "embedding", "mask")
    return out.withColumn("pooled", _digits("pooled"))


@query(
    "mean_pool_null_key",
    f"""WITH each AS (
  SELECT nullif(label, 3) AS key, (vec_id % 3 <> 0)::INTEGER AS m, unnest(embedding)::DOUBLE AS x,
         unnest(range(64)) AS i
  FROM embeddings WHERE vec_id % 11 <> 5),
pooled AS (SELECT key, i, sum(x * m) / greatest(sum(m), 1e-9::DOUBLE) AS x FROM each GROUP BY 1, 2),
rows AS (SELECT key, list(x ORDER BY i) AS v FROM pooled GROUP BY 1)
SELECT key, {_sql_digits('v')} AS pooled FROM rows""",
)
def mean_pool_null_key(spark, sf):
    """Some keys and some vectors are null."""
    e = table(spark, sf, "embeddings").select(
        F.when(F.col("label") != 3, F.col("label")).alias("key"),
        F.when(F.col("vec_id") % 11 != 5, F.col("embedding")).alias("embedding"),
        (F.col("vec_id") % 3 != 0).cast("int").alias("mask"),
    )
    return X.mean_pool(e, "key", "embedding", "mask").withColumn("pooled", _digits("pooled"))


@query(
    "l2_normalize",
    f"""WITH raw AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 2)) AS v FROM embeddings),
normed AS (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12::DOUBLE) AS n FROM raw)
SELECT id, {_sql_digits('list_transform(v, lambda y: y / n)')} AS vec FROM normed""",
)
def l2_normalize(spark, sf):
    raw = _vectors(spark, sf).withColumn(
        "vec", F.transform(F.col("vec").cast("array<double>"), lambda x: x * (F.col("id") + 2))
    )
    return raw.select("id", V.l2_normalize("vec").alias("vec")).withColumn("vec", _digits("vec"))


@query(
    "pair_dot",
    """SELECT a.vec_id AS id, b.vec_id AS other,
              round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def pair_dot(spark, sf):
    v = _vectors(spark, sf)
    after = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("vec").alias("vec2"))
    out = X.pair_dot(v.join(after, "id"), "vec", "vec2")
    return out.select("id", "other", F.round("dot", 6).alias("dot"))


@query(
    "knn_topk",
    """WITH sims AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id,
         round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INTEGER AS rank FROM sims)
SELECT query_id, id, round(sim, 6) AS sim, rank FROM ranked WHERE rank <= 5""",
)
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    return X.knn(v, v, 5).withColumn("sim", F.round("sim", 6))


def _sql_cells(rounds: int) -> str:
    """k-means in whole numbers: each round's cells follow from the one before."""
    nearest = lambda points, cells: (
        f"""(SELECT id, q, arg_min(cell, (-list_dot_product(q, c), cell)) AS cell
        FROM {points} CROSS JOIN {cells} GROUP BY id, q)"""
    )
    steps = "".join(
        f"""
own{i} AS {nearest("sample", f"cells{i - 1}")},
sums{i} AS (
  SELECT cell, list(s ORDER BY d) AS s FROM (
    SELECT cell, d, sum(x) AS s FROM (
      SELECT cell, unnest(q) AS x, unnest(range(len(q))) AS d FROM own{i}) GROUP BY cell, d) GROUP BY cell),
cells{i} AS (
  SELECT o.cell, CASE WHEN s IS NULL THEN o.c
                      ELSE list_transform(s, lambda x: floor({SCALE} * x / sqrt(list_dot_product(s, s)) + 0.5)) END AS c
  FROM cells{i - 1} o LEFT JOIN sums{i} USING (cell)),"""
        for i in range(1, rounds + 1)
    )
    drawn = lambda seed: sql_draw(seed, "id")
    return f"""points AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v,
         list_transform(embedding::DOUBLE[], lambda x: floor(x * {SCALE} + 0.5)) AS q FROM embeddings),
sizes AS (SELECT n, ceil(sqrt(n)) AS m FROM (SELECT count(*) AS n FROM points)),
sample AS (
  SELECT id, q, {drawn("0:cells")} AS draw FROM points, sizes
  WHERE {PER_CELL} * m >= n OR {drawn("0:cells")} < floor(4503599627370496.0::DOUBLE * {PER_CELL} * m / n)),
cells0 AS (
  SELECT cell, c FROM (SELECT q AS c, row_number() OVER (ORDER BY draw, id) - 1 AS cell FROM sample), sizes
  WHERE cell < m),{steps}
placed AS (
  SELECT id, v, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(q, c) DESC, cell) AS place
  FROM points CROSS JOIN cells{rounds}),
sims AS (
  SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 9) AS sim
  FROM points a JOIN points b ON a.id <> b.id),
exact AS (
  SELECT query_id, id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= 5),
needed AS (
  SELECT p.place, row_number() OVER (ORDER BY p.place) AS i, count(*) OVER () AS n
  FROM exact e JOIN placed b ON b.id = e.id AND b.place = 1
  JOIN placed p ON p.id = e.query_id AND p.cell = b.cell, sizes
  WHERE sizes.n <= {QUERIES} OR {sql_draw("0:ask", "e.query_id")} < floor(4503599627370496.0::DOUBLE * {QUERIES} / sizes.n)),
probes AS (SELECT place AS p FROM needed WHERE i = ceil(0.95::DOUBLE * n)),
met AS (
  SELECT a.id AS query_id, b.id AS id FROM placed a JOIN placed b ON a.cell = b.cell AND b.place = 1, probes
  WHERE a.place <= p),
approx AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY sim DESC, s.id)::INTEGER AS rank
    FROM sims s JOIN met USING (query_id, id)) WHERE rank <= 5)"""


@query(
    "knn_approx",
    f"WITH {_sql_cells(ROUNDS)} SELECT query_id, id, round(sim, 6) AS sim, rank FROM approx",
)
def knn_approx(spark, sf):
    v = _vectors(spark, sf)
    return N.knn_approx(v, v, 5).withColumn("sim", F.round("sim", 6))


@query(
    "knn_recall",
    f"""WITH {_sql_cells(ROUNDS)}
SELECT count(*) AS n, avg(CASE WHEN a.id IS NULL THEN 0 ELSE 1 END)::DOUBLE AS recall
FROM exact e LEFT JOIN approx a USING (query_id, id)""",
)
def knn_recall(spark, sf):
    v = _vectors(spark, sf)
    return X.knn_recall(N.knn_approx(v, v, 5), X.knn(v, v, 5))


@query(
    "knn_work",
    f"""WITH {_sql_cells(ROUNDS)}
SELECT m::INTEGER AS cells, p::INTEGER AS probes, (SELECT count(*) FROM met) AS products,
       (SELECT count(*) FROM met) / (n * n)::DOUBLE AS share FROM sizes, probes""",
)
def knn_work(spark, sf):
    """Products that ``knn_approx`` compares, of all pairs."""
    v = _vectors(spark, sf)
    return N.knn_work(v, v, N.fit_index(v, 5))


@query("sigmoid", f"WITH {SQL_SCORED} SELECT id, logit, round(p, 9) AS p FROM probs")
def sigmoid(spark, sf):
    return scored(spark, sf).select("id", "logit", F.round(V.sigmoid("logit"), 9).alias("p"))


# Another route to the same area: mean ranks of the positives.
def _sql_auc(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""placed AS (
  SELECT *, rank() OVER ({part}ORDER BY p)
            + (count(*) OVER (PARTITION BY {keys}p) - 1) / 2.0::DOUBLE AS r FROM {source}),
sums AS (
  SELECT {keys}count(*) FILTER (generated = 1) AS n_pos, count(*) FILTER (generated = 0) AS n_neg,
         sum(r) FILTER (generated = 1) AS s FROM placed {group}),
areas AS (
  SELECT {keys}n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN
    round((s - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg), 4) END AS auc FROM sums)"""


@query(
    "fold_auc",
    f"""WITH {SQL_SCORED},
split AS (
  SELECT *, CASE WHEN {sql_uniform(42, 'id')} < 0.8::DOUBLE THEN 'train' ELSE 'valid' END AS fold FROM probs),
{_sql_auc('split', 'fold')} SELECT * FROM areas""",
)
def fold_auc_query(spark, sf):
    return fold_auc(scored(spark, sf))


@query("roc_auc", f"WITH {SQL_SCORED}, {_sql_auc('probs')} SELECT * FROM areas")
def roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf), "logit", "generated")


@query("roc_auc_by_prompt", f"WITH {SQL_SCORED}, {_sql_auc('probs', 'prompt_id')} SELECT * FROM areas")
def roc_auc_by_prompt(spark, sf):
    return M.roc_auc(scored(spark, sf), "logit", "generated", by=["prompt_id"])


# Some prompts are null: a group like any other.
SQL_NULL_PROMPTS = f"""{SQL_SCORED},
holes AS (SELECT * REPLACE (CASE WHEN prompt_id % 6 <> 0 THEN prompt_id END AS prompt_id) FROM probs)"""


def _null_prompts(spark, sf):
    return scored(spark, sf).withColumn(
        "prompt_id", F.when(F.col("prompt_id") % 6 != 0, F.col("prompt_id"))
    )


@query(
    "roc_auc_null_prompt",
    f"WITH {SQL_NULL_PROMPTS}, {_sql_auc('holes', 'prompt_id')} SELECT * FROM areas",
)
def roc_auc_null_prompt(spark, sf):
    return M.roc_auc(_null_prompts(spark, sf), "logit", "generated", by=["prompt_id"])


@query(
    "ranking_loss_null_prompt",
    f"""WITH {SQL_NULL_PROMPTS}
SELECT a.prompt_id, sqrt(count(*))::BIGINT AS n,
       round(avg(greatest(-(a.p - b.p) * sign(a.generated - b.generated) + 0.7::DOUBLE, 0)), 6) AS loss
FROM holes a JOIN holes b ON a.prompt_id IS NOT DISTINCT FROM b.prompt_id GROUP BY 1""",
)
def ranking_loss_null_prompt(spark, sf):
    out = L.ranking_loss(_null_prompts(spark, sf), "prompt_id")
    return out.withColumn("loss", F.round("loss", 6))


SQL_BCE = "greatest(logit, 0) - logit * generated + ln(1 + exp(-abs(logit)))"


@query("bce", f"WITH {SQL_SCORED} SELECT prompt_id, round(avg({SQL_BCE}), 6) AS loss FROM scored GROUP BY 1")
def bce(spark, sf):
    out = L.bce_with_logits(scored(spark, sf), by=["prompt_id"])
    return out.withColumn("loss", F.round("loss", 6))


@query(
    "margin_pair_loss",
    f"""WITH {SQL_SCORED}, {SQL_PAIRS}
SELECT x.prompt_id, round(avg(greatest(0.7::DOUBLE - (a.logit - h.logit), 0)), 6) AS loss
FROM pairs x JOIN scored a ON a.id = x.ai_id JOIN scored h ON h.id = x.human_id GROUP BY 1""",
)
def margin_pair_loss(spark, sf):
    s = scored(spark, sf)
    pairs = (
        P.human_ai_pairs(s, 42)
        .join(s.select(F.col("id").alias("ai_id"), F.col("logit").alias("ai_logit")), "ai_id")
        .join(s.select(F.col("id").alias("human_id"), F.col("logit").alias("human_logit")), "human_id")
    )
    return L.margin_pair_loss(pairs, by=["prompt_id"]).withColumn("loss", F.round("loss", 6))


def sql_ranking(source: str, by: str) -> str:
    return f"""SELECT a.{by}, sqrt(count(*))::BIGINT AS n,
       round(avg(greatest(-(a.p - b.p) * sign(a.generated - b.generated) + 0.7::DOUBLE, 0)), 6) AS loss
FROM {source} a JOIN {source} b ON a.{by} = b.{by} GROUP BY 1"""


@query(
    "ranking_loss",
    f"""WITH {SQL_SCORED}, {sql_batches(42, 'probs', 32)},
placed AS (SELECT e.batch_id, s.* FROM probs s JOIN epoch e ON e.id = s.id)
{sql_ranking('placed', 'batch_id')}""",
)
def ranking_loss(spark, sf):
    rows = B.assign_batches(scored(spark, sf).select("id", "generated", "logit"), 32, 42)
    return L.ranking_loss(rows, "batch_id", n_cells=1).withColumn("loss", F.round("loss", 6))


@query("ranking_loss_by_prompt", f"WITH {SQL_SCORED} {sql_ranking('probs', 'prompt_id')}")
def ranking_loss_by_prompt(spark, sf):
    out = L.ranking_loss(scored(spark, sf), "prompt_id")
    return out.withColumn("loss", F.round("loss", 6))


@query(
    "supcon_loss",
    f"""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
epoch AS (SELECT *, {sql_position(42, 'id')} // 64 AS batch_id FROM e),
sims AS (
  SELECT a.batch_id, a.id, a.id <> b.id AS other, a.label = b.label AS same,
         list_dot_product(a.v, b.v) / 0.1::DOUBLE AS h
  FROM epoch a JOIN epoch b ON a.batch_id = b.batch_id),
means AS (
  SELECT batch_id, id, avg(exp(CASE WHEN other AND same THEN h ELSE 0 END)) AS vp,
         avg(exp(CASE WHEN other AND NOT same THEN h ELSE 0 END)) AS vn
  FROM sims GROUP BY 1, 2)
SELECT batch_id, count(*) AS n, round(-avg(ln(vp / (vp + vn))), 6) AS loss FROM means GROUP BY 1""",
)
def supcon_loss(spark, sf):
    rows = B.assign_batches(_vectors(spark, sf), 64, 42)
    return L.supcon_loss(rows).withColumn("loss", F.round("loss", 6))


@query(
    "evaluation",
    f"""WITH {SQL_SCORED}, {_sql_auc('probs')}
SELECT id, round(p, 9) AS predictions, generated AS truths, a.auc AS lb FROM probs, areas a""",
)
def evaluation(spark, sf):
    s = scored(spark, sf)
    report = M.evaluate(s.select("id", "logit"), s.select("id", "generated"))
    lb = report.scores.select("lb").scalar()
    return report.results.withColumns({"predictions": F.round("predictions", 9), "lb": lb})
