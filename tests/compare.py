"""Compare a query with its check SQL as sorted rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is not None, str(type(x)), x) for x in r),
    )


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    return sorted(columns), _rows(columns, rel.fetchall())


def difference(df, con, sql) -> str | None:
    """What differs, or None."""
    c1, r1 = spark_rows(df)
    c2, r2 = sql_rows(con, sql)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows != {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ, first {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}"
    return None


# Matrix products, vocabulary look-ups and the user's own functions run on Arrow
# batches in tasks.
ARROW = {
    "tokenize", "tokenize_cut", "decode", "preview", "mask_augment", "pad_batch",
    "pad_batch_right", "mask_labels", "mask_labels_cut", "mask_labels_compat",
    "knn_topk", "knn_approx", "knn_recall", "knn_work", "text_neighbours", "supcon_loss", "contrastive_losses",
    "pair_tokens", "detector_scores", "detector_search", "ranker_scores", "embedder_log",
    "batch_map", "batch_infer", "records_json",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_faults(name: str, df) -> list[str]:
    """What a physical plan must not hold."""
    banned = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
    if name not in ARROW:
        banned += ["MapInPandas", "MapInArrow", "FlatMapGroups", "ArrowEvalPython"]
    plan = plan_text(df)
    return [b for b in banned if b in plan]
