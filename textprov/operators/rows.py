"""Row filters, fills and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# What unfilled demographic columns become.
DEFAULT_FILLS = {
    "student_disability_status": "Unknown",
    "ell_status": "Unknown",
    "grade_level": -1.0,
    "holistic_essay_score": -1.0,
}
# Needles of the optional prompt filter, (text, lower-case first).
PROMPT_NEEDLES = [
    ("Task: Text dependent", False),
    ("car-free", True),
    ("facial action", True),
    ("electoral", True),
]


def drop_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull())


def fill_defaults(df: DataFrame, fills: Mapping[str, object] | None = None) -> DataFrame:
    return df.fillna(dict(fills or DEFAULT_FILLS))


def by_fold(df: DataFrame, fold: str) -> DataFrame:
    return df.where(F.col("fold") == fold)


def by_class(df: DataFrame, generated: int) -> DataFrame:
    return df.where(F.col("generated") == generated)


def limit_prompts(df: DataFrame, max_id: int = 8) -> DataFrame:
    return df.where(F.col("prompt_id") <= max_id)


def _any_needle(column: str, needles: Sequence[tuple[str, bool]]):
    hit = F.lit(False)
    for text, lower in needles:
        c = F.lower(column) if lower else F.col(column)
        hit = hit | c.contains(text)
    return hit


def exclude_prompts(df: DataFrame, needles=PROMPT_NEEDLES, column: str = "prompt") -> DataFrame:
    """Rows whose prompt holds none of the needles."""
    return df.where(~_any_needle(column, needles))


def include_prompts(df: DataFrame, needles, column: str = "prompt") -> DataFrame:
    """Rows whose prompt holds at least one of the needles."""
    return df.where(_any_needle(column, needles))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def to_submission(df: DataFrame, prediction: str = "predictions") -> DataFrame:
    return df.select("id", F.col(prediction).alias("generated"))


def union_classes(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
