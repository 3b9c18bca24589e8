"""The query registry and helpers for the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textprov.functions.draws import ROUNDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL that gives the same rows where SQL can."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sql_draw(seed, *parts: str) -> str:
    """SQL twin of ``functions.draws.draw``; parts are SQL expressions."""
    key = ", ".join([f"'{seed}'", *parts])
    return f"('0x' || substr(md5(concat_ws(':', {key})), 1, 13))::BIGINT"


def sql_uniform(seed, *parts: str) -> str:
    return f"({sql_draw(seed, *parts)}::DOUBLE / 4503599627370496.0::DOUBLE)"


def sql_position(seed, id: str, by: str = "", first: str = "") -> str:
    """SQL twin of ``shuffled_positions``."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{first}, " if first else ""
    return f"(row_number() OVER ({part}ORDER BY {lead}{sql_draw(seed, id)}, {id}) - 1)"


def sql_permuted(i: str, n: str, seed, *parts: str) -> str:
    """SQL twin of ``permuted``."""
    other = f"(({sql_draw(seed, repr('key'), *parts, 'r')} % {n} + {n} - x) % {n})"
    digest = f"md5(concat_ws(':', '{seed}', 'swap', {', '.join(parts)}, r, greatest(x, {other})))"
    return (
        f"list_reduce(list_concat([({i})::BIGINT], range({ROUNDS})), "
        f"lambda x, r: CASE WHEN substr({digest}, 1, 1) >= '8' THEN {other} ELSE x END)"
    )


SQL_WORDS = (
    r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\p{{Z}}\p{{Cc}}]')"
)


def sql_words(text: str) -> str:
    return SQL_WORDS.format(text)
