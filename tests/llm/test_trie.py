"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textprov.llm import trie as T

TALK = "conv_id long, turn long, role string, text string"


def ordered(rows):
    talk = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            key = (turn is not None, turn or 0, role or "", hashlib.md5(text.encode()).hexdigest())
            talk[conv].append((key, (role or "", text)))
    return {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in talk.items()}


def rebuilt(talk):
    out = {}
    for c, own in talk.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = talk.get(base, [])[:h] + own[h:]
    return out


def brute(talk):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talk.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += kids[p] == 0
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
         r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()
    )


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for c in list(range(40)) + [100, 101, 102, 250, 251, -3, -100, -150]:
        for t in range(r.randrange(1, 9)):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {r.randrange(3)}"))
    out += [(60 + i, t, "user", "same") for i in range(9) for t in range(6)]  # equal conversations
    out += [(80 + i, t, "user", "same") for i in range(5) for t in range(6 + i)]
    out += [
        (300, None, None, None), (300, None, "user", "null turn"), (300, 4, "user", "a"), (300, 4, "user", "a"),
        (None, 1, "user", "nobody's"), (400, 2, "", ""), (401, 2, None, None), (500, 1, "user", "x" * 100_000),
    ]
    return out


@pytest.fixture(scope="module")
def talk(spark, rows):
    df = spark.createDataFrame(rows, TALK).repartition(3)
    return df.withColumns({c: F.lit(f"mine {c}") for c in ("conv", "pos", "n", "a", "b", "chars", "depth", "ends")})


def test_plain(talk, rows):
    assert found(T.conversation_trie(talk)) == brute(ordered(rows))


def test_rebuilt(talk, rows):
    assert found(T.rebuilt_trie(talk)) == brute(rebuilt(ordered(rows)))


@pytest.mark.parametrize("group", [0, 40])
def test_bands_are_halved(talk, rows, group):
    """Down to bands of one depth, which are plain aggregations."""
    assert found(T.conversation_trie(talk, group=group)) == brute(ordered(rows))


def test_long_conversations_are_cut(spark, monkeypatch):
    """Segments: a conversation of many turns is several rows."""
    monkeypatch.setattr(T, "SEGMENT", 4)
    r = random.Random(1)
    rows = [(c, t, "user", "same" if t < 6 else f"{r.randrange(2)}") for c in range(12) for t in range(3 + 2 * c)]
    df = spark.createDataFrame(rows, TALK)
    assert found(T.conversation_trie(df)) == brute(ordered(rows))
    assert found(T.conversation_trie(df, group=30)) == brute(ordered(rows))


def test_ids_of_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    df = spark.range(1000).select(
        F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"),
        F.when(F.col("id") % 3 == 0, "other").otherwise("same").alias("text"),
    )
    assert found(T.conversation_trie(df)) == brute(ordered([tuple(r) for r in df.collect()]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], TALK)
    assert T.rebuilt_trie(empty).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], TALK)
    assert T.conversation_trie(nobody).collect() == []


def test_only_turnless(spark):
    """A conversation that loses all turns ends at the root."""
    rows = [(c, 0, "user", "x") for c in range(1, 60)]
    df = spark.createDataFrame(rows, TALK)
    assert found(T.rebuilt_trie(df)) == brute(rebuilt(ordered(rows)))
