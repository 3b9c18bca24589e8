"""From raw documents to a training mix, in five stages.

Each stage takes all rows that the one before it kept, works on whole texts, and its
result is written as Parquet and read again, so a lost executor costs one stage at most.
All but the last return the columns of ``documents``.

Rows are told apart by id and text: the duplicate stage drops copies without an id too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprov.llm.bitmaps import key_bitmap, split, without
from textprov.llm.chunks import remove_repeated_runs
from textprov.llm.leaks import without_leaks
from textprov.llm.mixing import mix
from textprov.llm.parity import Similarity, similar_groups
from textprov.llm.pu import fit_pu, score_texts, trusted
from textprov.llm.registry import table
from textprov.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GOOD = 0.3  # least chance of good quality that a document is kept with


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    model = fit_pu(docs, trusted(table(spark, sf_dir, "labels")))
    scored = score_texts(docs.select(*COLUMNS), model, name="_score")
    return scored.where(F.col("_score") >= GOOD).drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand earlier; documents left without a word go."""
    cut = remove_repeated_runs(docs.select(*COLUMNS))
    left = (F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long"))
    return cut.where(left).withColumn("n_chars", F.coalesce(chars, "n_chars")).select(*COLUMNS)


def named(docs: DataFrame) -> DataFrame:
    """Adds ``_row`` and ``_check``, two digests of a row's id and text."""
    own = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.coalesce("text", F.lit(""))]
    return docs.select(*COLUMNS).withColumns(
        {"_row": F.xxhash64(*own), "_check": F.xxhash64(F.lit(1), *own)}
    )


def repeating(docs: DataFrame) -> DataFrame:
    """``_row`` of the rows that stand more than once."""
    return docs.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    docs = named(docs)
    names = ["_row", "_check"]
    groups = similar_groups(docs, rule=Similarity(words=5, num=80, den=100), carry=names)
    groups = materialize(groups.select("doc_id", "component_id", "component", *names), "groups")
    lost = groups.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    lost = lost.select(*names)
    # The least id may stand on several texts of its group; a group may have no id at all.
    least = groups.where(F.col("component").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = least.select("component", *names).distinct()
    first = least.groupBy("component").agg(
        F.min("_row").alias("_first"), F.max("_row").alias("_last")
    ).where("_first <> _last")
    more = least.join(first, "component").where("_row <> _first").select(*names)
    kept = without(docs, materialize(lost.unionByName(more).distinct(), "lost"), *names)
    # Rows that repeat an id and its text are one document too.
    once, again = split(kept, "_row", key_bitmap(repeating(docs), "_row"))
    return once.unionByName(again.dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix and how many words it takes of each, repeats counted."""
    docs = named(docs).drop("_check")
    twice = materialize(repeating(docs), "twice")
    # Rows that repeat get a number, written once, so that each meets its own row of the mix.
    again = docs.join(twice, "_row", "left_semi").withColumn("_n", F.monotonically_increasing_id())
    once = docs.join(twice, "_row", "left_anti").withColumn("_n", F.lit(-1).cast("long"))
    every = once.unionByName(materialize(again, "again"))
    mixed = mix(every, carry=["_row", "_n"]).where("taken > 0")
    mixed = mixed.select("_row", "_n", "size", "source_size", "target", "taken")
    return every.join(mixed, ["_row", "_n"]).drop("_row", "_n")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

ORACLE_SQL = None  # the classifier is no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
