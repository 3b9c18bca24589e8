"""Operators that compare texts with one another, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import low, sentence, words
from textprov.llm import chunks, flat, parity, suffixes
from textprov.llm.bitmaps import key_bitmap, without
from textprov.llm.components import components
from textprov.llm.mixing import mix
from textprov.llm.parity import Similarity, similar_groups
from textprov.llm.suffixes import remove_repeats, repeated_passages


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(text, k):
    w = words(low(text))
    if 0 < len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def linked(rows, rule):
    """Size and component of every row, from all pairs."""
    sets = [shingles(r[1], rule.words) for r in rows]
    u = Union()
    for i in range(len(rows)):
        u.find(i)
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                u.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            root = u.find(i)
            least[root] = min(least.get(root, r[0]), r[0])
    return Counter(
        (r[0], len(sets[i]), least.get(u.find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("rule", [Similarity(3, 90, 100), Similarity(5, 80, 100)])
def test_similar_groups(docs, rows, rule):
    got = similar_groups(docs, rule=rule).select("doc_id", "n_shingles", "component_id").collect()
    want = linked(rows, rule)
    assert Counter(tuple(r) for r in got) == want
    assert len({x[2] for x in want}) < len({x[0] for x in want})


def test_similar_groups_of_chains_and_short_texts(spark, monkeypatch):
    """Texts that drift word by word, families just below the limit, tiles of two."""
    r = random.Random(9)
    rows, n = [], 0
    for size in (10, 12, 20, 60, 150):
        base = sentence(r, size).split()
        for step in range(14):
            rows.append((n, " ".join(base)))
            base[r.randrange(size)] = f"new{n}"
            n += 1
    base = sentence(r, 120).split()
    for _ in range(14):  # each differs from the others in about a sixth of its shingles
        own = list(base)
        for i in r.sample(range(120), 4):
            own[i] = f"own{n}-{i}"
        rows.append((n, " ".join(own)))
        n += 1
    monkeypatch.setattr(parity, "TILE", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in (Similarity(3, 90, 100), Similarity(5, 80, 100)):
        got = similar_groups(df, rule=rule).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(tuple(x) for x in got) == linked(rows, rule)


def test_keys_meet_whenever_sets_are_similar():
    """The join alone: pairs at and just above the limit share a key in some band."""
    r = random.Random(2)
    import numpy as np

    for rule in (Similarity(3, 90, 100), Similarity(5, 80, 100)):
        for _ in range(400):
            both = r.randrange(rule.least, 700)
            more = both * (rule.den - rule.num) // rule.num  # the most differences allowed
            left = r.randrange(more + 1)
            s = np.array(r.sample(range(1 << 60), both + more), dtype=np.uint64)
            a = np.sort(np.r_[s[:both], s[both : both + left]])
            b = np.sort(np.r_[s[:both], s[both + left :]])
            assert rule.similar(a, b)
            bands = set(rule.bands(len(a))) & set(rule.bands(len(b)))
            assert any(
                set(parity.keys_of(a, k, rule).tolist()) & set(parity.keys_of(b, k, rule).tolist())
                for k in bands
            ) or len(a) == len(b) == both
            for k in bands:
                x, y = (np.frombuffer(parity.sketch_of(z, k, rule), np.uint64) for z in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
                n1, n2 = np.int64(len(a)), np.array([len(b)])
                assert parity._near(rule, n1, x, n2, y[None, :])[0]


def test_similar_groups_of_nothing(none):
    assert similar_groups(none).count() == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    pairs += [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(90)]
    pairs += [(5, 5), (None, 7), pairs[0]]
    u = Union()
    for a, b in pairs:
        if a is not None and a != b:
            u.join(a, b)
    least = {}
    for x in list(u.up):
        least[u.find(x)] = min(least.get(u.find(x), x), x)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: least[u.find(x)] for x in u.up}
    assert components(df.where("false")).count() == 0


def test_without(spark):
    df = spark.createDataFrame([(i % 40 or None, str(i)) for i in range(200)], "id long, v string")
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 77)], "id long")
    left = without(df, keys, "id")
    assert Counter(r["id"] for r in left.collect()) == Counter(
        (i % 40 or None) for i in range(200) if i % 40 not in (1, 2, 3)
    )
    assert key_bitmap(keys.where("false"), "id").value.sum() == 0


def removed(rows, length):
    count = Counter()
    data = [(r[1] or "").encode() for r in rows]
    for d in data:
        count.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for r, d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((r[0], len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(r, n):
    """Texts that share long and short passages, whole or cut, some of one repeated letter."""
    parts = ["".join(r.choice("abcde f") for _ in range(r.randrange(30, 200))) for _ in range(6)]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(0, 5)):
            part = r.choice(parts)
            a, b = sorted((r.randrange(len(part) + 1), r.randrange(len(part) + 1)))
            text += r.choice([part, part[a:b], "a" * r.randrange(60), "é" + part[a:]])
            text += "".join(r.choice("xyz") for _ in range(r.randrange(6)))
        out.append(text)
    return out


@pytest.mark.parametrize("classes", [256, 2])
def test_remove_repeats(spark, classes, monkeypatch):
    monkeypatch.setattr(suffixes, "CLASSES", classes)
    r = random.Random(8)
    rows = list(enumerate(passages(r, 70))) + [(70, None), (71, ""), (None, "ab" * 90), (3, "ab" * 90)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, length=40, gram=16).collect()
    assert Counter(tuple(x) for x in got) == removed(rows, 40)


def test_remove_repeats_of_documents(docs, rows, none):
    got = remove_repeats(docs).collect()
    assert Counter(tuple(x) for x in got) == removed(rows, 400)
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("every", [True, False])
def test_pieces_with_very_many_copies_are_not_gathered(spark, every, monkeypatch):
    """A word pair said over and over is one piece at thousands of places."""
    monkeypatch.setattr(suffixes, "HEAVY", 64, raising=False)
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in held}
    rows = [(i, f"{i} " + "Is onhe. " * (40 + i)) for i in range(24)]
    rows += [(100 + i, t) for i, t in enumerate(passages(random.Random(3), 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = remove_repeats(df, length=40, gram=16).collect()
        at = repeated_passages(df, length=40, gram=16, every=every)
        at = at.select("repeat", F.spark_partition_id().alias("task"))
        tasks = at.groupBy("repeat").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks")
        )
        tasks = tasks.where("n > 64").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(tuple(x) for x in got) == removed(rows, 40)
    assert tasks and all(x.tasks > 1 for x in tasks)


def test_all_occurrences_of_a_repeat(spark):
    r = random.Random(12)
    texts = passages(r, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {flat.row_key(i, t.encode()): t.encode() for i, t in enumerate(texts)}
    groups = defaultdict(set)
    for x in repeated_passages(df, length=40, gram=16).collect():
        groups[x["repeat"]].add((x["doc"], x["start"], x["stop"]))
    assert groups
    for places in groups.values():
        strings = {key[d][a:b] for d, a, b in places}
        assert len(strings) == 1 and len(places) > 1
        assert len(next(iter(strings))) >= 40


def test_maximal_repeats_by_hand():
    rows = [(b"xxABCDyy", 4), (b"zzABCDyw", 4), (b"qABCDr", 3)]
    got = {(tuple(sorted(m)), a, b) for m, a, b in suffixes.maximal_repeats(rows, 4)}
    assert got == {((0, 1, 2), 2, 2), ((0, 1), 2, 3)}


def chunked(rows):
    """Text left and lines removed of every row."""
    out, first, count = [], {}, Counter()
    cut = []
    for r in rows:
        p = next(flat.pieces(pa.array([r[1] or ""])))
        s, e, _, c = chunks.chunk_spans(p)
        data = p.data.tobytes()
        cut.append([(data[s[a] : e[b - 1]], b - a, [data[x:y] for x, y in zip(s[a:b], e[a:b])])
                    for a, b in zip(c, c[1:])])
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for n, (data, lines, _) in enumerate(cut[i]):
            count[data] += 1
            row = (rows[i][0], flat.row_key(rows[i][0], (rows[i][1] or "").encode()), n)
            key = (rows[i][0] is not None, *((rows[i][0] or 0,) + row[1:]))
            if data not in first or key < first[data][0]:
                first[data] = (key, row)
    for i, r in enumerate(rows):
        left, gone = [], 0
        for n, (data, lines, parts) in enumerate(cut[i]):
            row = (r[0], flat.row_key(r[0], (r[1] or "").encode()), n)
            if lines > 1 and len(data) >= chunks.LEAST and count[data] > 1 and first[data][1] != row:
                gone += lines
            else:
                left += parts
        text = b"\n".join(left).decode() if r[1] is not None else None
        out.append((r[0], text, gone))
    return Counter(out)


def test_line_chunks(docs, rows, none):
    out = chunks.remove_repeated_chunks(docs)
    got = Counter((x["doc_id"], x["text"], x["n_removed_lines"]) for x in out.collect())
    assert got == chunked(rows)
    assert sum(x[2] * n for x, n in got.items()) > 20
    assert set(docs.columns) <= set(out.columns)
    assert chunks.remove_repeated_chunks(none).count() == 0


def test_chunks_of_a_passage_do_not_depend_on_what_is_before_it():
    r = random.Random(6)
    passage = "\n".join(sentence(r, 8) for _ in range(40))
    found = []
    for before in range(6):
        text = "\n".join(sentence(r, 5) for _ in range(before)) + "\n" + passage
        p = next(flat.pieces(pa.array([text])))
        s, e, _, c = chunks.chunk_spans(p)
        assert all(b - a > 1 for a, b in zip(c, c[1:]))
        found.append({p.data.tobytes()[s[a] : e[b - 1]] for a, b in zip(c, c[1:])})
    common = set.intersection(*found)
    assert sum(x.count(b"\n") + 1 for x in common) > 30


def without_runs(rows, least):
    """Text left and lines removed of every row, from all runs of lines of all texts."""
    cut = [(r[1] or "").encode().split(b"\n") for r in rows]
    place = [
        (r[0] is not None, r[0] or 0, flat.row_key(r[0], (r[1] or "").encode())) for r in rows
    ]
    first = {}
    for own, at in zip(cut, place):
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                run = b"\n".join(own[i:j])
                if len(run) >= least:
                    first[run] = min(first.get(run, (*at, i)), (*at, i))
    out = []
    for r, own, at in zip(rows, cut, place):
        gone = set()
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                run = b"\n".join(own[i:j])
                if len(run) >= least and first[run] != (*at, i):
                    gone.update(range(i, j))
        text = b"\n".join(x for i, x in enumerate(own) if i not in gone).decode()
        out.append((r[0], None if r[1] is None else text, len(gone)))
    return Counter(out)


def test_every_repeated_run_of_lines_goes(spark, docs, rows, none):
    got = chunks.remove_repeated_runs(docs).collect()
    assert Counter((x["doc_id"], x["text"], x["n_removed_lines"]) for x in got) == without_runs(
        rows, chunks.LEAST
    )
    r = random.Random(12)
    few = [sentence(r, 1 + i % 4) for i in range(30)] + ["", "", "a", "b"]
    odd = [(i, "\n".join(r.choice(few) for _ in range(r.randrange(1, 14)))) for i in range(60)]
    odd += [(60 + m, f"{sentence(r, 6)}\n{sentence(r, 7)}\nfirst line of a passage\nand its second line\n"
             f"{sentence(r, 6)}") for m in range(5)]
    odd += [(80, "x\n" * 90), (81, "\n" * 100), (82, "y" * 50 + ("\n" + "y" * 50) * 4), odd[3], (None, odd[4][1])]
    df = spark.createDataFrame(odd, "doc_id long, text string").repartition(4)
    for least in (1, chunks.LEAST, 90):
        out = chunks.remove_repeated_runs(df, least=least).collect()
        assert Counter((x["doc_id"], x["text"], x["n_removed_lines"]) for x in out) == without_runs(odd, least)
        lines = lambda texts: {x for t in texts for x in t.split("\n")}
        assert lines(t for _, t in odd) - {""} == lines(x["text"] for x in out) - {""}
    assert chunks.remove_repeated_runs(none).count() == 0


def test_runs_do_not_depend_on_the_chunks(spark):
    r = random.Random(14)
    whole = "\n".join(sentence(r, 8) for _ in range(30))
    rows = [(i, whole) for i in range(12)]  # copies go as chunks
    rows += [(20 + i, f"{sentence(r, 7)}\n" + "\n".join(whole.split("\n")[i : i + 5])) for i in range(20)]
    rows += [(50 + i, whole.split("\n")[3 * i] + "\n" + whole) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = without_runs(rows, chunks.LEAST)
    for mean in (2, 3, 7):
        got = chunks.remove_repeated_runs(df, mean=mean).collect()
        assert Counter((x["doc_id"], x["text"], x["n_removed_lines"]) for x in got) == want
    texts = df.selectExpr("doc_id as id", "text")
    cut, gone = chunks._repeated_chunks(texts, 2, chunks.LEAST)
    assert cut.count() > 50
    ids, first = pa.array([0, 5]), pa.array([whole, whole])
    p = next(flat.pieces(first))
    found = gone.chunks(p, ids.to_pylist(), 2, chunks.LEAST)
    assert set(found.owner.tolist()) == {1}  # the first copy keeps its chunks
    windows = chunks.windows_of(p, chunks.LEAST)
    left = windows.take(chunks._outside(windows, found))
    assert (left.owner == 0).sum() == (windows.owner == 0).sum()
    assert (left.owner == 1).sum() < (windows.owner == 1).sum()


def test_queries_remove_two_shared_lines(spark, tmp_path):
    from textprov.llm.queries import op7_line_chunks

    r = random.Random(13)
    shared = [sentence(r, 8) + "\n" + sentence(r, 9) for _ in range(20)]
    own = lambda: "\n".join(sentence(r, 7) for _ in range(3))
    texts = [f"{own()}\n{s}\n{own()}" for s in shared * 2]
    df = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: 0 if i < 20 else 2 for i in range(40)}
    got = op7_line_chunks(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["n_removed_lines"] for x in got} == want
    cut = corpus_pipeline.lines(spark, df, str(tmp_path)).collect()
    assert {x["doc_id"]: 7 - x["text"].count("\n") for x in cut} == want


def targets(rows, weights=(5, 2, 1), share=1.5, most=2):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    todo, total, out = set(names), share * sum(size.values()), {}
    while todo:
        level = total / sum(weight[s] for s in todo)
        over = {s for s in todo if level * weight[s] > most * size[s]}
        if not over:
            out |= {s: level * weight[s] for s in todo}
            break
        out |= {s: most * size[s] for s in over}
        total -= sum(out[s] for s in over)
        todo -= over
    return size, out


def test_mix(spark, docs, rows, none):
    got = mix(docs, shard_texts=10).collect()
    again = mix(docs.repartition(5), shard_texts=10).collect()
    size, want = targets(rows)
    assert len(got) == len(rows)
    assert Counter((r[0], len(words(r[1])), r[3]) for r in rows) == Counter(
        (r["doc_id"], r["size"], r["source"]) for r in got
    )
    took = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    for s in want:
        assert abs(took[s] - want[s]) <= 16 * 8
    assert Counter((r["doc_id"], r["key"], r["taken"]) for r in got) == Counter(
        (r["doc_id"], r["key"], r["taken"]) for r in again
    )
    assert mix(none).count() == 0
    empty = spark.createDataFrame([(1, "s", None), (2, None, " ")], "doc_id long, source string, text string")
    assert {(r["size"], r["taken"]) for r in mix(empty).collect()} == {(0, 0)}


def test_quotas_are_sainte_lague(spark):
    from textprov.llm.mixing import quotas

    r = random.Random(3)
    for trial in range(3):
        cells = [(f"s{i % 4}" if i % 7 else None, i, r.choice([1, 40, 700, 9000])) for i in range(25)]
        due = {(s, k): n * r.random() * 2 for s, k, n in cells}
        df = spark.createDataFrame(
            [(s, k, n, due[s, k]) for s, k, n in cells],
            "source string, shard long, shard_size long, target double",
        )
        got = {(x["source"], x["shard"]): x["quota"] for x in quotas(df, block=4).collect()}
        seats = {c: 0 for c in due}
        for _ in range(int(sum(x / 4 for x in due.values()))):
            best = max(due, key=lambda c: (due[c] / 4 / (2 * seats[c] + 1)))
            seats[best] += 1
        sizes = {(s, k): n for s, k, n in cells}
        assert got == {c: min(n, 2 * -(-sizes[c] // 4)) for c, n in seats.items()}


def test_mixing_sql_and_plan(docs):
    from tests.compare import plan_text

    plan = plan_text(mix(docs))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline(spark, tmp_path):
    """All stages on a small corpus with one case of each kind."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    r = random.Random(1)
    long = "\n".join(sentence(r, 30) for _ in range(5))
    near = long.replace("\n", " ").split()
    near[70] = "other"
    item = spark.read.parquet(f"{base}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = [
        (5001, long), (5002, long), (5003, " ".join(near)), (5004, long.replace("\n", " ")),
        (5005, "Before it comes this. " + item + " And after it that."),
    ]
    odd = [(5006, None, None, None, None), (None, sentence(r, 50), "en", None, 1)]
    planted = spark.createDataFrame(
        [(i, t, "en", "src1", len(t)) for i, t in more] + odd,
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{base}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = stages["lines"](spark, now, str(tmp_path)).cache()
    ids = {x["doc_id"] for x in cut.collect()}
    assert 5001 in ids and 5002 not in ids and 5003 in ids
    one = stages["near_duplicates"](spark, cut, str(tmp_path)).cache()
    ids = {x["doc_id"] for x in one.collect()}
    assert ids & {5001, 5003, 5004} == {5001} and {5005, 5006, None} <= ids
    clean = stages["decontamination"](spark, one, str(tmp_path))
    assert 5005 not in {x["doc_id"] for x in clean.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
    kept = {x["doc_id"] for x in out.collect()}
    assert kept and not kept & {5002, 5003, 5004, 5005}
    empty = now.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_duplicates_are_dropped_by_row_not_by_id(spark, tmp_path):
    r = random.Random(14)
    text = [sentence(r, 60) for _ in range(4)]
    rows = [
        (1, text[0]), (2, text[0] + " more"), (2, text[1]),  # one row of id 2 is clean
        (3, text[2]), (3, text[2] + " more"), (3, text[2]), (4, text[2]),  # the least id twice
        (5, text[3]), (6, None), (6, ""), (7, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS
    got = Counter((x["doc_id"], x["text"]) for x in got.collect())
    third = [x for x in got if x[0] == 3]
    assert len(third) == 1 and third[0] in rows
    assert got == Counter([(1, text[0]), (2, text[1]), (5, text[3]), (6, None), (6, ""), (7, ""), *third])


def test_copies_without_an_id(spark, tmp_path):
    r = random.Random(15)
    text = [sentence(r, 60) for _ in range(4)]
    rows = [
        (1, text[0]), (None, text[0]), (None, text[0] + " more"), (None, text[1]), (None, text[1]),
        (None, text[1] + " more"), (None, text[2]), (None, text[2]), (None, None), (None, None), (None, ""),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT).repartition(3)
    got = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    second = [x for x in got if (x[1] or "").startswith(text[1])]
    assert len(second) == 1 and second[0] in rows
    assert got == Counter([(1, text[0]), (None, text[2]), (None, None), (None, ""), *second])


def test_repeated_rows_meet_one_row_of_the_mix(spark):
    r = random.Random(16)
    text = [sentence(r, 40) for _ in range(3)]
    rows = [(None, text[0], "a")] * 6 + [(1, text[1], "a")] * 4 + [(1, text[1], "b"), (2, text[2], "b")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCUMENT).repartition(3)
    got = corpus_pipeline.mixing(spark, df, "")
    assert got.columns == [*corpus_pipeline.COLUMNS, "size", "source_size", "target", "taken"]
    got = got.collect()
    want = mix(df).where("taken > 0").collect()
    total = lambda rows: Counter(
        (x["doc_id"], x["source"], x["source_size"], x["size"], x["taken"]) for x in rows
    )
    assert total(got) == total(want) and len(got) <= len(rows)


def test_archive(spark, tmp_path):
    from textprov.llm import archive

    big, other = "<p>" + "é" * 800, "y" * 1000
    rows = [
        (1, "http://a.Example.com/x?q=1#f", big), (2, "http://b.example.com/", big),
        (3, "http://a.example.com/x?q=1", "small"), (4, None, "small"), (5, "not a url", None),
        (6, "http://[bad", ""), (7, "http://b.example.com/", big), (8, "http://line.example\r\nX: y/", other),
        (None, "http://c.example.org:8080/z", big), (None, "http://d.example.org/", "z" * 2000),
        (None, "http://e.example.org/", "z" * 2000), (9, "http://f.example.org/", "w\r\n\r\nWARC/1.1\r\n" * 90),
        (7, "http://b.example.com/", big),
    ] + [(100 + i, "http://hot.example.com/same", f"page {i} " * 200) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("key", "digest", "payload", "offset", "holder", "n")})
    captures = archive.write_archive(df)
    directory = archive.build_index(captures, lines=4)
    assert directory.count() > 5
    keys = archive.archive_keys(df)
    for limit in (1 << 20, 200):
        found = archive.lookup(keys, directory, limit=limit)
        got = archive.read_records(found, payload=True).collect()
        want = []
        most = {}
        for p, _, html in rows:
            if p is not None:
                most[html] = max(most.get(html, p), p)
        for p, url, html in rows:
            data = (html or "").encode()
            again = len(data) >= 1000 and most.get(html) not in (None, p)
            want.append((
                p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response",
                most[html] if again else None, None if again else data,
            ))
        assert Counter(want) == Counter(
            (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
             r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got
        )
    one = archive.lookup(spark.createDataFrame([("com,example,a)/x?q=1",), ("zz",), (None,)], "key string"), directory)
    assert {r["page_id"] for r in archive.read_records(one).collect()} == {1, 3}
    nothing = archive.build_index(archive.write_archive(df.where("false")))
    assert archive.read_records(archive.lookup(keys, nothing)).count() == 0


def test_contract_columns(spark):
    """The registered queries on the smallest tables: names, types and rows."""
    from __spark_entry__ import queries

    base = "/root/testdata/sf0.001"
    count = lambda t: duckdb.sql(f"select count(*) from '{base}/{t}.parquet'").fetchall()[0][0]
    named = {k: v for k, v in queries().items() if k.startswith("op")}
    assert sorted(int(k[2:].split("_")[0]) for k in named) == list(range(1, 14))
    want = {
        1: ("documents", "doc_id bigint held_out boolean score double predicted int"),
        2: ("documents", "doc_id bigint n_shingles bigint component_id bigint"),
        3: ("documents", "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint "
            "base_labels string labels string score double"),
        4: ("pages", "page_id bigint payload_bytes bigint payload_digest string record_type string "
            "refers_to bigint"),
        5: ("documents", "doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string"),
        6: (None, "conv_id bigint n_turns bigint turns_sha256 string loss_chars bigint "
            "loss_sha256 string formatted_chars bigint"),
        8: ("documents", "doc_id bigint n_words bigint word_chars bigint n_symbols bigint "
            "n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean"),
        9: ("documents", "doc_id bigint size bigint source_size bigint target double taken bigint"),
        11: (None, "item_id bigint rank int doc_id bigint score bigint"),
        12: (None, "conv_id bigint depth bigint parent_conv_id bigint n_convs bigint n_children bigint "
             "n_leaves bigint saved_tokens bigint ends_sha256 string"),
        13: ("documents", "doc_id bigint n_chars bigint edited_sha256 string fingerprint string "
             "edited_fingerprint string near_edited double near_next double"),
    }
    for name, fn in named.items():
        n = int(name[2:].split("_")[0])
        if n not in want:
            continue
        table, columns = want[n]
        out = fn(spark, base)
        kinds = dict(out.dtypes)
        pairs = columns.split()
        assert {c: kinds[c] for c in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2])), name
        if table:
            assert out.count() == count(table), name
