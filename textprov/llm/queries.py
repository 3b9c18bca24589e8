"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprov.llm.archive import archive_keys, build_index, lookup, read_records, write_archive
from textprov.llm.chat import format_turns, read_back
from textprov.llm import checks
from textprov.llm.chunks import remove_repeated_runs
from textprov.llm.leaks import find_leaks
from textprov.llm.licenses import scan_licenses
from textprov.llm.mixing import mix
from textprov.llm.parity import Similarity, similar_groups
from textprov.llm.prints import edited_prints, print_text
from textprov.llm.pu import fit_pu, held_out, score_texts, trusted
from textprov.llm.registry import ORACLES, QUERIES, query, table
from textprov.llm.repetition import quality_rules
from textprov.llm.search import search_items
from textprov.llm.suffixes import remove_repeats
from textprov.llm.trie import rebuilt_trie

__all__ = ["ORACLES", "QUERIES"]


@query("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_pu(docs, trusted(table(spark, sf_dir, "labels")))
    return score_texts(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op2_parity_join", checks.near_duplicates(3, 90, 100))
def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = similar_groups(docs, rule=Similarity(words=3, num=90, den=100))
    return groups.select("doc_id", "n_shingles", "component_id")


@query("op3_license_scan", checks.licenses())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, each_row=True)


@query("op4_warc_index", checks.ARCHIVE)
def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, index the captures, look every address up and read its records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    directory = build_index(write_archive(pages))
    found = lookup(archive_keys(pages), directory)
    return read_records(found).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op5_suffix_repeats", checks.REPEATS)
def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_chat_tokens", checks.CHAT)
def op6_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    return read_back(format_turns(talk.unionByName(own)))


@query("op7_line_chunks", checks.LINE_RUNS)
def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_runs(docs).select(
        "doc_id", "n_lines", "n_removed_lines",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op8_repetition", checks.repetition())
def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs)


@query("op10_benchmark_leaks")
def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, by item."""
    docs = table(spark, sf_dir, "documents")
    hits = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return hits.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min("start").alias("first_byte"),
        F.max("end").alias("last_byte"),
        F.min("edits").alias("least_edits"),
    )


@query("op9_source_mix", checks.mixing())
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op13_winnow_prints", checks.fingerprints())
def op13_winnow_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of the same texts with another end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_prints(docs).select(
        "doc_id", "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        print_text(F.col("chosen")).alias("fingerprint"),
        print_text(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


@query("op12_truncation_peel", checks.trie())
def op12_truncation_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share their first turns."""
    return rebuilt_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query("op11_fp_tree_search", checks.SEARCH)
def op11_fp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
