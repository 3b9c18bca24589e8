"""Winnowing against plain Python."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA
from textprov.llm.prints import FACTORS, ORDER, SHORT, UNIT, cells, edited_prints, print_text, winnow

PATTERN = re.compile(UNIT.replace(r"\x{2E7F}", "⹿"))


def brute(text, k=4, w=8):
    codes = [zlib.crc32(u.encode()) + 1 for u in PATTERN.findall(text or "")]
    if 0 < len(codes) < k:
        h = 0
        for c in codes:
            h = (h * FACTORS[1] + c) & SHORT
        grams = [h]
    else:
        grams = []
        for i in range(len(codes) - k + 1):
            a, b, c, d = codes[i : i + 4]
            grams.append(FACTORS[2] * (FACTORS[1] * a + b) + FACTORS[1] * c + d)
    chosen = set()
    for s in range(max(len(grams) - w, 0) + 1 if grams else 0):
        window = range(s, min(s + w, len(grams)))
        chosen.add(min(window, key=lambda i: (grams[i] & ORDER, -i)))
    return [(grams[i], i) for i in sorted(chosen)]


def share(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """By id, for rows whose ids are distinct and not null."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed = brute(text), brute(edited)
        out[id] = (len(text), edited, own, changed, share(own, changed), share(own, brute(after)))
    return out


def found(df):
    return [
        (r["doc_id"], (r["n_chars"], r["edited"], [tuple(x) for x in r["chosen"]],
                       [tuple(x) for x in r["edited_chosen"]], r["near_edited"], r["near_next"]))
        for r in df.collect()
    ]


def test_every_window_is_found(spark, rows, docs):
    alone = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = expected({r[0]: r for r in rows if r[0] is not None}.values())
    assert dict(found(edited_prints(alone))) == want


def test_rows_that_repeat_and_rows_without_id(rows, docs):
    got = found(edited_prints(docs))
    assert len(got) == len(rows)
    texts = [r[1] or "" for r in rows]
    assert sorted(x[1][0] for x in got) == sorted(len(t) for t in texts)
    prints = {}
    for t in texts:
        prints.setdefault(len(t), []).append(brute(t))
    assert all(x[1][2] in prints[x[1][0]] for x in got)
    # A row that repeats is the next of the one before.
    twice = [x[1] for x in got if x[0] == rows[3][0]]
    assert len(twice) == 2 and any(x[5] == 1.0 for x in twice)


def test_no_rows_and_one_row(spark, none):
    assert edited_prints(none).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f g h i", "en", "s", 17)], SCHEMA)
    (id, got), = found(edited_prints(one))
    assert got[1] == "a b c d e f a b c" and got[5] == 1.0


@pytest.mark.parametrize("text", ["a " * 300_000, "x" * 1_000_000, " " * 1_000_000, "字" * 60_000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = [tuple(x) for x in df.select(winnow(F.col("text")).alias("x")).head()["x"]]
    assert got == brute(text)


def test_shared_runs_share_a_gram(spark):
    run = " ".join(f"w{i}" for i in range(11))
    df = spark.createDataFrame([(f"one two {run} three",), (f"other {run} and more words here",)], "text string")
    a, b = ({x["hash"] for x in r["x"]} for r in df.select(winnow(F.col("text")).alias("x")).collect())
    assert a & b


def test_texts_of_one_id_are_cut(spark):
    """An id on most rows is spread over parts, and parts follow the order."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") - 1000).alias("ord"), F.xxhash64("id").alias("key")
    )
    placed = cells(df, 64).toPandas().sort_values(["ord", "key"])
    spots = list(zip(placed["cell"], placed["part"]))
    assert spots == sorted(spots)
    assert placed.groupby(["cell", "part"]).size().max() < 300


def test_text_of_a_print(spark):
    df = spark.createDataFrame([("one two three four five",)], "text string")
    got = df.select(print_text(winnow(F.col("text"))).alias("x")).head()["x"]
    assert got == " ".join(f"{h:X}@{i}" for h, i in brute("one two three four five"))


def test_edited_digest(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "123456789")], "doc_id long, text string")
    got = {r["doc_id"]: hashlib.sha256(r["edited"].encode()).hexdigest() for r in edited_prints(df).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in [(1, "abcd12"), (2, "123456abc")]}
