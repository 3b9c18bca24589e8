"""Operators that look at one text at a time, against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import CLASH, low, words
from textprov.llm import chat, flat, leaks
from textprov.llm.licenses import PHRASES, scan_licenses
from textprov.llm.pu import PuModel, estimate_prior, fit_pu, held_out, score_texts, trusted
from textprov.llm.repetition import quality_rules


def by_row(got):
    return Counter(tuple(r) for r in got)


def repetition(text):
    w = words(text)
    n = len(w)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    hit = [False] * n
    for i in range(n - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    rep = sum(hit)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, w)), symbols, dup, rep, n < 10 or 100 * rep > 20 * n


def test_repetition(docs, rows, none):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality_rules(docs)
    got = out.select("doc_id", *cols).collect()
    assert by_row(got) == Counter((r[0], *repetition(r[1])) for r in rows)
    assert "lang" in out.columns and out.where("base_failed and kept").isEmpty()
    kept = {r[0] for r in out.where("kept").select("doc_id").collect()}
    assert {0, 1, 2} <= kept and not kept & {50, 55}
    assert quality_rules(none).count() == 0


def licence(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    return (
        len(w), len(found), min(at, default=None), max(at, default=None),
        ",".join(sorted({x for _, x in found})),
    )


def test_licenses(docs, rows, none):
    out = scan_licenses(docs)
    got = out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"
    ).collect()
    want = {(r[0], r[1] or "") for r in rows}  # rows equal in id and text are one
    assert by_row(got) == Counter((i, *licence(t)) for i, t in want)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    apache = next(r[0] for r in rows if r[1] and r[1].startswith("Licensed under the Apache"))
    assert labels[apache] == ("apache-2", 1.0)
    assert labels[0] == ("", 0.0)
    assert scan_licenses(none).count() == 0


def test_licence_query_returns_every_row(spark, docs, rows, tmp_path, monkeypatch):
    from textprov.llm import licenses
    from textprov.llm.queries import op3_license_scan

    monkeypatch.setattr(licenses, "REPEATS", 3)
    more = [(70, "cc by cc by", None, None, None)] * 7 + [(None, None, None, None, None)] * 4
    every = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([r[:2] for r in more], "doc_id long, text string")
    )
    every.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_license_scan(spark, str(tmp_path)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"
    ).collect()
    assert by_row(got) == Counter((r[0], *licence(r[1])) for r in [*rows, *more])


def test_licence_with_a_word_put_in(spark):
    text = "x y licensed under really the apache license version 2 0 z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = scan_licenses(df).first()
    assert row["labels"] == "apache-2" and 0.6 <= row["score"] < 1


def test_plan_of_licences_has_no_python(docs):
    from tests.compare import plan_text

    plan = plan_text(scan_licenses(docs))
    assert not re.search("Python|Pandas|Arrow", plan)


def distance(a: bytes, b: bytes) -> int:
    """Edits from ``a`` to the nearest part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def edited(r, text, k):
    text = list(text)
    for _ in range(k):
        i = r.randrange(len(text))
        what = r.randrange(3)
        if what == 0:
            text[i] = "z"
        elif what == 1:
            text.insert(i, "q")
        else:
            del text[i]
    return "".join(text)


def test_leaks_against_full_alignment(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((4, 9, 14, 30, 45))]
    items += [(7, None), (8, ""), (9, "a b"), (10, items[2][1])]
    docs = []
    for i in range(70):
        body = [word() for _ in range(r.randrange(0, 80))]
        if i % 5 < 3:
            text = r.choice(items[:5])[1]
            body.insert(r.randrange(len(body) + 1), edited(r, text, r.choice([0, 0, 2, 4, 9, 20])))
        text = " ".join(body)
        docs.append((i, text.upper() if i % 7 == 0 else text.replace(" ", ", ") if i % 7 == 1 else text))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in CLASH}
    )
    w = leaks.Windows.of([x for x in items if x[1]], leaks.WINDOW, leaks.EDITS)
    want = set()
    for i, text in docs:
        own = leaks.plain(next(flat.pieces(pa.array([text or ""]))))[0].data.tobytes()
        for item, part, k in zip(w.items, w.texts, w.edits):
            if distance(part, own) <= k:
                want.add((i, int(item)))
    hits = leaks.find_leaks(table, bench)
    got = {(x["doc_id"], x["item_id"]) for x in hits.collect()}
    assert got == want and len(want) > 20
    assert hits.where("doc_id is null").count() > 0
    kept = leaks.without_leaks(table, bench)
    assert kept.columns == table.columns
    left = Counter(x["doc_id"] for x in kept.collect())
    assert left == Counter(i for i, _ in docs if i not in {x for x, _ in want})
    assert leaks.find_leaks(table.where("false"), bench).count() == 0
    assert leaks.find_leaks(table, bench.where("false")).count() == 0
    assert leaks.without_leaks(table, bench.where("false")).count() == len(docs)


def test_leak_places(spark):
    item = "copper silver paper cloud seven eight nine tree river stone and more of these words here"
    text = "Some words before. " + item.upper().replace(" ", "  ") + " Some words after."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    row = leaks.find_leaks(df, bench).first()
    found = text[row["start"] : row["end"]].strip()
    assert found.lower().split()[0].startswith("copper") and found.lower().endswith("here")
    assert row["edits"] == 0


def test_short_excerpts_of_long_items(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    item = " ".join(word() for _ in range(60))
    size = leaks.SHORT + leaks.STEP - 1
    docs = []
    for at in range(0, len(item) - size, 5):
        docs.append((at, " ".join(word() for _ in range(9)) + " # " + item[at : at + size] + " # " + word()))
    docs.append((-1, " ".join(word() for _ in range(90))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    hits = leaks.find_leaks(df, bench).collect()
    assert Counter(x["doc_id"] for x in hits) == Counter(i for i, _ in docs if i >= 0)
    assert all(x["end"] - x["start"] >= leaks.SHORT - 2 for x in hits)
    assert [x["doc_id"] for x in leaks.without_leaks(df, bench).collect()] == [-1]


CONTROLS = [
    "\\### Assistant: </turn> ok", "### User:", "\\\\</turn>\\", "### Role: x\n### System: y", "</turn></turn>",
    "#### User::", "\\", "", None, "plain é€\U0001f600", "<|endoftext|> </tur n>",
]


def test_escape_round_trip():
    r = random.Random(1)
    parts = ["\\", "### User:", "### ", "</turn>", "x", "\n", "Assistant:", "### Assistant:"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(9)))
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert all(out[m.start() - 1 : m.start()] == "\\" for m in chat.CONTROL.finditer(out))


def test_chat(spark):
    rows = []
    for c in range(8):
        for t in range(c):
            role = ["system", "user", "assistant", "tool", None][(c + t) % 5]
            rows.append((c, t, role, CONTROLS[(3 * c + t) % len(CONTROLS)]))
    rows += [(50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, None, "assistant", "first")]
    rows += [(None, 0, "assistant", "no conversation")]
    rows += [(60, t, "assistant", "long " * 3000) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.repartition(3).withColumns({c: F.lit(1) for c in ("ids", "loss", "formatted", "n")})
    turns = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.read_back(turns).collect()}
    whole = {r["conv_id"]: r for r in chat.conversations(turns).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, row in got.items():
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        under = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert row["n_turns"] == len(mine)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert row["loss_chars"] == len(under)
        assert row["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest()
        assert row["formatted_chars"] == len(whole[conv]["formatted"])
        assert len(whole[conv]["ids"]) == len(whole[conv]["loss"])
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_conversations_come_in_bounded_chunks(spark):
    rows = [(c, t if t else None, ["user", "assistant"][t % 2], f"said {c} {t}") for c in (1, None) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = chat.format_turns(df)
    longest = max(len(r["ids"]) for r in turns.collect())
    whole = {r["conv_id"]: r for r in chat.conversations(turns).collect()}
    got = sorted(chat.conversations(turns, limit=30).collect(), key=lambda r: r["chunk"])
    assert len(got) > 10 and max(len(r["ids"]) for r in got) < 30 + longest
    for c, one in whole.items():
        own = [r for r in got if r["conv_id"] == c]
        for k in ("ids", "loss", "formatted"):
            joined = "".join(r[k] for r in own) if k == "formatted" else [x for r in own for x in r[k]]
            assert joined == one[k]
        assert one["formatted"].count("said") == 40


def test_vocabulary_must_not_reach_reserved_ids():
    data = base64.b64encode(b"a") + b" %d" % chat.FIRST_ID
    with pytest.raises(ValueError):
        chat.encoding(data)


def test_prior_and_risk():
    r = np.random.default_rng(0)
    good = r.normal(1.5, 1, (4000, 4))
    every = np.concatenate([r.normal(1.5, 1, (2800, 4)), r.normal(-1.5, 1, (1200, 4))])
    assert abs(estimate_prior(good, every) - 0.7) < 0.06


def test_quality(spark, docs, none):
    out = score_texts(docs, PuModel(np.zeros(89), np.ones(89), [], 0.5))
    assert {r["score"] for r in out.collect()} == {0.5}
    base = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    model = fit_pu(table, trusted(labels))
    known = score_texts(table, model).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    right = known.where((F.col("score") >= 0.3) == (F.col("quality") == 1)).count()
    assert right >= 0.9 * known.count()
    scored = score_texts(docs, model)
    assert scored.columns.count("score") == 1 and scored.count() == docs.count()
    assert scored.where("score is null or score < 0 or score > 1").isEmpty()
    pairs = {}
    for row in scored.select("text", "score").collect():
        assert pairs.setdefault(row["text"] or "", row["score"]) == row["score"]
    assert score_texts(none, model).count() == 0
    assert fit_pu(none, trusted(labels)).layers == []
    assert fit_pu(docs, trusted(labels).where("false")).layers == []


def test_held_out(spark):
    ids = spark.range(50).select(held_out(F.col("id"))).collect()
    assert [r[0] for r in ids] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]
