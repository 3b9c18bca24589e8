"""Very long texts, empty texts alone and in company, and reruns on other partitionings."""

import hashlib
import time

import pytest

from tests.llm.fixtures import SCHEMA
from textprov.llm import chat, leaks
from textprov.llm.features import WIDTH, text_features
from textprov.llm.flat import pieces
from textprov.llm.licenses import scan_licenses
from textprov.llm.mixing import mix

import pyarrow as pa


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, " \n" * 300_000 + "end"])
def test_chat_of_long_runs(spark, text):
    df = spark.createDataFrame(
        [(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    row = chat.read_back(chat.format_turns(df)).head()
    said = f"user\n{text}\nassistant\n{text}\n".encode()
    assert row["turns_sha256"] == hashlib.sha256(said).hexdigest()
    assert (row["loss_chars"], row["n_turns"]) == (len(text), 2)


def test_only_long_runs_are_cut():
    code = chat.encoding(chat.read_vocabulary())
    text = "Usual words,   some blanks\n\n and 漢字. " * 400
    assert chat.encode(code, text) == code.encode_ordinary(text)
    long = "x" * (3 * chat.LONGEST) + " y"
    assert code.decode(chat.encode(code, long)) == long


def test_features_of_an_empty_text_are_the_same_in_company():
    def of(*texts):
        return [text_features(p) for p in pieces(pa.array(texts, pa.string()))][0]

    alone, beside, all_ = of(""), of("", "some words here"), of(None, "", "")
    assert (alone[0] == beside[0]).all() and (all_ == alone[0]).all()
    assert alone.shape == (1, WIDTH) and alone.any()


def test_mix_repeats_on_any_partitioning(spark):
    """Rows of equal size without ids, with repeated ids, and equal rows."""
    rows = [(None, f"word{i} a b c", None, f"s{i % 3}", 1) for i in range(60)]
    rows += [(7, f"other{i} a b c", None, f"s{i % 3}", 1) for i in range(60)]
    rows += [(i, "same text here", None, "s0", 1) for i in range(20)] + [(3, "same text here", None, "s0", 1)] * 5
    df = spark.createDataFrame(rows, SCHEMA)

    def taken(n):
        got = mix(df.repartition(n), shard_texts=11, carry=["lang"])
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["key"], r["taken"]) for r in got.collect())

    assert taken(1) == taken(7) == taken(4)
    shards = {k for _, _, k, t in taken(2) if t}
    assert len(shards) > 20  # rows without an id do not all share one place


def test_licences_in_long_texts(spark):
    """Time grows with the words, not with their square."""
    def scan(n):
        text = "word other " * (n // 2) + "licensed under the Apache License, Version 2.0 all rights reserved"
        df = spark.createDataFrame([(1, text, None, None, 1)], SCHEMA)
        begun = time.time()
        row = scan_licenses(df).head()
        assert (row["n_words"], row["n_base"], row["first_word"]) == (2 * (n // 2) + 11, 1, 2 * (n // 2) + 8)
        assert row["labels"] == "apache-2,reserved" and row["score"] == 1.0
        return time.time() - begun

    scan(1000)
    small, large = scan(100_000), scan(1_000_000)
    assert large < 20 * max(small, 1.0)


def test_licences_of_texts_with_few_words(spark):
    rows = [(1, None, None, None, 1), (2, "", None, None, 1), (3, "one", None, None, 1), (4, "cc by", None, None, 1)]
    got = {r["doc_id"]: (r["n_words"], r["n_base"]) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (2, 1)}


def test_leaks_in_texts_that_repeat_themselves(spark, monkeypatch):
    """Slices and remembered alignments change nothing; memory stays bounded."""
    items = [(1, "a" * 120), (2, "ab " * 60), (3, "some words of an item that stand only once in any of the texts here")]
    texts = ["a" * 3000, "ab " * 900, "x " + items[2][1] + " y", "aab " * 300, ""]
    w = leaks.Windows.of(items, leaks.WINDOW, leaks.EDITS)
    p, = pieces(pa.array(texts))
    whole = sorted(set(leaks._hits(p, w)))
    monkeypatch.setattr(leaks, "PAIRS", 2000)
    monkeypatch.setattr(leaks, "KNOWN", 2)
    assert sorted(set(leaks._hits(p, w))) == whole
    assert {(own, int(w.items[win])) for own, win, *_ in whole} == {(0, 1), (1, 2), (2, 3)}
