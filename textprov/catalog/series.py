"""Metric logs."""

from pyspark.sql import functions as F

from textprov.catalog.inputs import SQL_LOG, metric_log
from textprov.catalog.registry import query
from textprov.operators import series as S


@query(
    "running_mean",
    f"""WITH {SQL_LOG}
SELECT run, step, metric::DOUBLE AS metric, n,
       (sum(metric * n) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE AS avg
FROM log WINDOW w AS (PARTITION BY run ORDER BY step)""",
)
def running_mean(spark, sf):
    out = S.running_mean(metric_log(spark, sf), weight="n")
    return out.withColumn("metric", F.col("metric").cast("double"))


SQL_JUDGED = f"""{SQL_LOG},
led AS (SELECT run, step, metric, max(metric) OVER w AS best, row_number() OVER w AS place
        FROM log WINDOW w AS (PARTITION BY run ORDER BY step)),
flagged AS (SELECT *, metric = best AS is_best FROM led),
judged AS (
  SELECT run, step, metric::DOUBLE AS metric, best::DOUBLE AS best, is_best,
         place - max(CASE WHEN is_best THEN place END) OVER (PARTITION BY run ORDER BY step) AS patience
  FROM flagged)"""


def _judged(spark, sf):
    return S.best_and_patience(metric_log(spark, sf).drop("n"), "max")


@query("best_patience", f"WITH {SQL_JUDGED} SELECT * FROM judged")
def best_patience(spark, sf):
    return _judged(spark, sf).withColumns(
        {"metric": F.col("metric").cast("double"), "best": F.col("best").cast("double")}
    )


# The same log where some runs, and one step, are null.
SQL_NULL_LOG = f"""{SQL_LOG},
holes AS (
  SELECT CASE WHEN run % 5 <> 0 THEN run END AS run, CASE WHEN step <> 17 THEN step END AS step, metric, n
  FROM log)"""


def _with_nulls(spark, sf):
    return metric_log(spark, sf).withColumns(
        {"run": F.when(F.col("run") % 5 != 0, F.col("run")), "step": F.when(F.col("step") != 17, F.col("step"))}
    )


@query(
    "running_mean_nulls",
    f"""WITH {SQL_NULL_LOG}
SELECT run, step, metric::DOUBLE AS metric, n,
       (sum(metric * n) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE AS avg
FROM holes WINDOW w AS (PARTITION BY run ORDER BY step NULLS FIRST)""",
)
def running_mean_nulls(spark, sf):
    out = S.running_mean(_with_nulls(spark, sf), weight="n")
    return out.withColumn("metric", F.col("metric").cast("double"))


@query(
    "best_patience_nulls",
    f"""WITH {SQL_NULL_LOG},
led AS (SELECT run, step, metric, max(metric) OVER w AS best, row_number() OVER w AS place
        FROM holes WINDOW w AS (PARTITION BY run ORDER BY step NULLS FIRST))
SELECT run, step, metric::DOUBLE AS metric, best::DOUBLE AS best, metric = best AS is_best,
       place - max(CASE WHEN metric = best THEN place END)
         OVER (PARTITION BY run ORDER BY step NULLS FIRST) AS patience
FROM led""",
)
def best_patience_nulls(spark, sf):
    out = S.best_and_patience(_with_nulls(spark, sf).drop("n"), "max")
    return out.withColumns(
        {"metric": F.col("metric").cast("double"), "best": F.col("best").cast("double")}
    )


@query(
    "ema_nulls",
    f"""WITH {SQL_NULL_LOG},
numbered AS (
  SELECT run, metric::DOUBLE AS x,
         row_number() OVER (PARTITION BY run ORDER BY step NULLS FIRST) - 1 AS i,
         count(*) OVER (PARTITION BY run) AS n FROM holes)
SELECT run, n, round(sum(CASE WHEN i = 0 THEN x ELSE x * 0.1 END * pow(0.9::DOUBLE, n - 1 - i)), 6) AS ema
FROM numbered GROUP BY run, n""",
)
def ema_nulls(spark, sf):
    return S.ema(_with_nulls(spark, sf), 0.9).withColumn("ema", F.round("ema", 6))


@query(
    "best_patience_min",
    f"""WITH {SQL_LOG}
SELECT a.run, a.step, a.metric::DOUBLE AS metric, min(b.metric)::DOUBLE AS best,
       a.metric = min(b.metric) AS is_best,
       count(*) - arg_max(b.place, (-b.metric, b.place)) AS patience
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS place FROM log) a
JOIN (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS place FROM log) b
  ON b.run = a.run AND b.step <= a.step
GROUP BY a.run, a.step, a.metric""",
)
def best_patience_min(spark, sf):
    out = S.best_and_patience(metric_log(spark, sf).drop("n"), "min")
    return out.withColumns(
        {"metric": F.col("metric").cast("double"), "best": F.col("best").cast("double")}
    )


@query(
    "early_stop",
    f"""WITH {SQL_JUDGED}
        SELECT run, min(CASE WHEN patience >= 20 THEN step END) AS stop_step FROM judged GROUP BY 1""",
)
def early_stop(spark, sf):
    return S.early_stop(_judged(spark, sf), 20)


@query(
    "metric_at_best",
    f"""WITH {SQL_LOG},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, step DESC) AS place FROM log)
SELECT run, step AS step_at_best, metric::DOUBLE AS metric_at_best FROM ordered WHERE place = 1""",
)
def metric_at_best(spark, sf):
    out = S.metric_at_best(metric_log(spark, sf))
    return out.withColumn("metric_at_best", F.col("metric_at_best").cast("double"))


@query(
    "ema",
    f"""WITH {SQL_LOG},
numbered AS (
  SELECT run, metric::DOUBLE AS x, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS i,
         count(*) OVER (PARTITION BY run) AS n FROM log)
SELECT run, n, round(sum(CASE WHEN i = 0 THEN x ELSE x * 0.1 END * pow(0.9::DOUBLE, n - 1 - i)), 6) AS ema
FROM numbered GROUP BY run, n""",
)
def ema(spark, sf):
    return S.ema(metric_log(spark, sf), 0.9).withColumn("ema", F.round("ema", 6))
