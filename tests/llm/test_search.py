"""Ranked search against a score of every document for every item."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, low
from textprov.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def brute(docs, items, top=10):
    texts = [(i, TERM.findall(low(t))) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n_docs, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in texts:
            m = 10 + (90 * len(w) * n_docs) // total
            score = 0
            for t in set(TERM.findall(low(text))):
                tf = w.count(t)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:top], 1):
            out.append((-1 if item is None else item, rank, -1 if none else i, -score))
    return sorted(out)


def found(df):
    return sorted(
        (-1 if r.item_id is None else r.item_id, r["rank"], -1 if r.doc_id is None else r.doc_id, r.score)
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1]]
    out = [(i, " ".join(texts[i].split()[:30])) for i in range(12)]
    out += [
        (20, None), (21, ""), (22, "?!"), (23, "nowhereatall"), (24, "THE of And river7 river7"),
        (25, texts[-5]), (None, texts[3][:200]), (26, "señor11 Émile3 über5 é€"), (26, "señor11 Émile3 über5 é€"),
    ]
    return out


def test_all_scores(spark, rows, docs, items):
    given = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("mine"))
    assert found(S.search_items(docs, given)) == brute([r[:2] for r in rows], items)


def test_small_blocks(spark, rows, docs, items, monkeypatch):
    """Items over several passes, tries of few documents, divided down to pairs."""
    monkeypatch.setattr(S, "BLOCK_DOCS", 17)
    monkeypatch.setattr(S, "LEAF", 2)
    monkeypatch.setattr(S, "CELLS", 2)
    given = spark.createDataFrame(items, ITEMS)
    got = S.search_items(docs, given, top=3, block_bytes=1500)
    assert found(got) == brute([r[:2] for r in rows], items, top=3)


def test_copies_and_ties(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "w1 w2 w3 same copy", None, None, None) for i in range(400)]
    rows += [(1000 + i, " ".join(r.choices(words, k=r.randrange(1, 40))), None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    items = [(1, "same copy w1"), (2, "w5 w6 w7 w8"), (3, " ".join(words))]
    assert found(S.search_items(docs, spark.createDataFrame(items, ITEMS))) == brute([x[:2] for x in rows], items)


def test_bounds_hold():
    """No document below a node scores more than the node's bound."""
    r = np.random.default_rng(1)
    n, ranks = 500, 40
    size = r.integers(1, 12, n)
    offsets = np.r_[0, np.cumsum(size)]
    rank = np.concatenate([np.sort(r.choice(ranks, k, replace=False)) for k in size])
    tf = r.integers(1, 9, len(rank))
    trie = S.Trie(r.integers(10, 400, n), rank, tf, offsets, ranks)
    counts = trie.counts(np.arange(ranks))
    for k, own in enumerate(trie.children):
        assert (counts[own] <= counts[n + k]).all()
        assert (trie.least[own] >= trie.least[n + k]).all()
    assert sorted(trie.order) == list(range(n))
    dense = np.zeros((n, ranks), int)
    dense[np.repeat(np.arange(n), size), rank] = tf
    assert (counts[:n] == dense[trie.order]).all()


def test_long_texts(spark):
    rows = [(1, "river " * 300_000, None, None, None), (2, "x" * 1_000_000, None, None, None),
            (3, " " * 1_000_000, None, None, None), (4, "river stone", None, None, None)]
    items = [(1, "river"), (2, "x" * 1_000_000), (3, "stone " + "long " * 50_000)]
    got = S.search_items(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert found(got) == brute([x[:2] for x in rows], items)


def test_no_rows(spark, docs, none, items):
    given = spark.createDataFrame(items, ITEMS)
    assert S.search_items(none, given).collect() == []
    assert S.search_items(docs, given.where("false")).collect() == []
