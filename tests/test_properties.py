"""Properties over larger or lopsided tables, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.functions.draws import permutation_keys, permuted
from textprov.functions.tokens import words
from textprov.operators import (
    batches as B, groups as G, losses as L, metrics as M, neighbours as N, pairs as P, prefix as R,
    sampling as S, series, tokens as K, vectors as X,
)
from textprov.operators.skew import salted_join
from textprov.session import materialize


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share prompt 0; a score that repeats."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("int").alias("prompt_id"),
        (F.xxhash64("id") % 5 == 0).cast("int").alias("generated"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200)) / 20.0 - 5.0).alias("logit"),
    )


def test_split_does_not_depend_on_partitions(hot):
    a = {tuple(r) for r in S.hash_split(hot, 0.9, 1).select("id", "fold").collect()}
    b = {tuple(r) for r in S.hash_split(hot.repartition(7), 0.9, 1).select("id", "fold").collect()}
    assert a == b
    assert 0.87 < sum(f == "train" for _, f in a) / len(a) < 0.93


def test_sample_is_exact_and_a_prefix_of_the_shuffle(hot):
    order = [r["id"] for r in S.epoch_order(hot, 0, 0).orderBy("pos").collect()]
    assert sorted(order) == list(range(3000)) and order != sorted(order)
    picked = S.sample_n(hot, 500, 9)
    assert sorted(r["pos"] for r in picked.collect()) == list(range(500))
    assert S.sample_n(hot, 5000, 9).count() == 3000


def test_positions_inside_hot_groups(hot):
    rows = R.shuffled_positions(hot, "id", 4, by=["prompt_id"], name="rank").collect()
    ranks = {}
    for r in rows:
        ranks.setdefault(r["prompt_id"], []).append(r["rank"])
    assert sum(map(len, ranks.values())) == 3000
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_running_over_two_levels(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("step"), F.lit(1).alias("run"))
    out = R.running(
        df,
        ["step"],
        R.step_cells(F.col("step"), bits=3),
        {"total": ("sum", F.col("step")), "low": ("min", -F.col("step"))},
        by=["run"],
    ).collect()
    assert all(r["total"] == r["step"] * (r["step"] + 1) // 2 and r["low"] == -r["step"] for r in out)


def test_balanced_batches(hot):
    rows = B.balanced_batches(hot, 8, 42).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r)
    assert len(by_batch) == 375
    for batch in by_batch.values():
        assert len({r["id"] for r in batch}) == 8 == len({r["slot"] for r in batch})
        assert sum(r["generated"] for r in batch) == 4
        assert len({r["prompt_id"] for r in batch}) == 1
    assert len({r["batch_id"] for r in B.balanced_batches(hot, 7, 42, 10).collect()}) == 10
    assert B.balanced_batches(hot, 7, 42, 10).count() == 60


def test_prompt_batches(hot):
    prompt = {r["id"]: r["prompt_id"] for r in hot.collect()}
    rows = B.prompt_batches(hot, 16, 42).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r)
    sizes = [len(by_batch[b]) for b in sorted(by_batch)]
    assert sizes == [16] * 187 + [8]
    replaced = [b for b in by_batch.values() if b[0]["replaced"]]
    assert 0.7 < len(replaced) / len(by_batch) < 0.9
    for batch in by_batch.values():
        assert len({r["id"] for r in batch}) == len(batch)
        if batch[0]["replaced"]:
            assert len({prompt[r["id"]] for r in batch}) == 1
    none = B.prompt_batches(hot, 5000, 42).collect()
    assert len(none) == 3000 and not any(r["replaced"] for r in none)


def test_requests_for_small_prompts_are_spread(hot, monkeypatch):
    columns = ["batch_id", "slot", "id"]

    def drawn():
        both = B.balanced_batches(hot, 8, 42).select(columns), B.prompt_batches(hot, 16, 42).select(columns)
        return [sorted(map(tuple, df.collect())) for df in both]

    plain = drawn()
    monkeypatch.setattr(B, "REQUESTS_PER_KEY", 0.5)  # every text is repeated
    assert drawn() == plain


def test_drawn_permutations(spark):
    """Every permutation is whole, and those of two batches meet like random ones."""
    df = spark.createDataFrame([(b, n) for b in range(40) for n in (1, 2, 7, 100)], "b long, n long")
    keys = permutation_keys(F.col("n"), 1, F.col("b"))
    each = df.withColumn("keys", keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = each.withColumn("to", permuted(F.col("i"), F.col("n"), F.col("keys"), 1, F.col("b"))).collect()
    got = {}
    for r in rows:
        got.setdefault((r["b"], r["n"]), {})[r["i"]] = r["to"]
    assert all(sorted(m.values()) == list(range(n)) for (_, n), m in got.items())
    first = [{got[b, 100][i] for i in range(10)} for b in range(40)]
    met = [len(a & c) for i, a in enumerate(first) for c in first[i + 1 :]]
    assert 0.7 < sum(met) / len(met) < 1.3  # one of ten is expected
    steps = [(got[b, 100][i + 1] - got[b, 100][i]) % 100 for b in range(40) for i in range(99)]
    assert max(Counter(steps).values()) < 100  # neighbours do not stay neighbours


def test_texts_that_many_batches_ask_for(spark, monkeypatch):
    """A third of the plan asks for one text; its requests are joined in parts."""
    plan = spark.range(6000).select(
        F.floor(F.col("id") / 8).alias("batch_id"), (F.col("id") % 8).alias("slot"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 700).alias("id"),
    )
    rows = spark.range(700).select("id", F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("slot"))
    want = sorted((r["batch_id"], r["slot"], r["id"], f"text {r['id']}") for r in plan.collect())
    for keys in (100_000, 0):
        monkeypatch.setattr(B, "SMALL_KEYS", keys)
        monkeypatch.setattr(B, "REQUESTS_PER_KEY", 100)
        got = B.fetch_rows(plan, rows)
        assert sorted(tuple(r) for r in got.select("batch_id", "slot", "id", "text").collect()) == want
    sizes = got.where("id = 5").groupBy(F.pmod(F.xxhash64("batch_id", "slot"), F.lit(21))).count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    assert B.fetch_rows(plan.where("false"), rows).count() == 0


def test_id_lists_are_whole_and_bounded(hot):
    rows = G.ids_by_prompt(hot, 64).collect()
    assert max(r["n"] for r in rows) == 64
    assert sorted(i for r in rows for i in r["ids"]) == list(range(3000))


def test_pairs_use_every_text_evenly(hot, monkeypatch):
    """The larger class once each, the smaller one's uses differ by one at most."""
    def uses():
        rows = P.human_ai_pairs(hot, 1).collect()
        return Counter(r["human_id"] for r in rows), Counter(r["ai_id"] for r in rows), sorted(map(tuple, rows))

    human, ai, rows = uses()
    of = {r["id"]: (r["prompt_id"], r["generated"]) for r in hot.collect()}
    sizes = Counter(of.values())
    both = {p for p, _ in sizes if sizes[p, 0] and sizes[p, 1]}
    assert len(rows) == sum(max(sizes[p, 0], sizes[p, 1]) for p in both)
    for used, label in ((human, 0), (ai, 1)):
        assert set(used) == {i for i, (p, y) in of.items() if y == label and p in both}
        for p in both:
            most, n = max(sizes[p, 0], sizes[p, 1]), sizes[p, label]
            assert {used[i] for i in used if of[i][0] == p} <= {most // n, -(-most // n)}
    monkeypatch.setattr(P, "RING_ROWS", 1)  # every round of the ring is a block of its own
    assert uses()[2] == rows


def test_one_human_text_is_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "RING_ROWS", 50)
    df = spark.range(2001).select("id", F.lit(1).alias("prompt_id"), (F.col("id") > 0).cast("int").alias("generated"))
    pairs = P.human_ai_pairs(df, 1)
    assert pairs.select("human_id").distinct().count() == 1 and pairs.count() == 2000
    keys = pairs.select(F.floor(F.col("rank") / 50).alias("b")).groupBy("b").count().collect()
    assert len(keys) == 40 and max(k["count"] for k in keys) == 50


def test_auc_of_negated_scores(hot):
    up = M.roc_auc(hot, "logit", "generated", digits=None).first()["auc"]
    down = M.roc_auc(hot.withColumn("logit", -F.col("logit")), "logit", "generated", digits=None)
    assert down.first()["auc"] == pytest.approx(1 - up)
    pos = np.array([r["logit"] for r in hot.where("generated = 1").collect()])
    neg = np.array([r["logit"] for r in hot.where("generated = 0").collect()])
    gap = pos[:, None] - neg[None, :]
    assert up == pytest.approx((gap > 0).mean() + 0.5 * (gap == 0).mean())


def test_ranking_loss_of_hot_groups(hot):
    got = {r["prompt_id"]: r["loss"] for r in L.ranking_loss(hot, "prompt_id").collect()}
    rows = hot.toPandas()
    rows["p"] = 1 / (1 + np.exp(-rows["logit"]))
    for prompt, g in rows.groupby("prompt_id"):
        p, y = g["p"].to_numpy(), g["generated"].to_numpy()
        sign = np.sign(y[:, None] - y[None, :])
        loss = np.clip(-(p[:, None] - p[None, :]) * sign + 0.7, 0, None).mean()
        assert got[prompt] == pytest.approx(loss)


def _unit(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("limit", [64 << 20, 1000])
@pytest.mark.parametrize("text_ids", [False, True])
def test_knn_broadcast_and_tiles(spark, limit, text_ids):
    v = _unit(120, 8, 3)
    v[40:80] = v[0]  # a third of the texts are copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    if text_ids:
        df = df.withColumn("id", F.format_string("t%03d", "id"))
    got = X.knn(df, df, 4, broadcast_bytes=limit, tile_rows=50).collect()
    v = v.astype("float32").astype("float64")
    sim = np.round(v @ v.T, 9)
    np.fill_diagonal(sim, -np.inf)
    expected = {
        (i, r + 1): j for i in range(120) for r, j in enumerate(np.lexsort((np.arange(120), -sim[i]))[:4])
    }
    name = (lambda x: int(x[1:])) if text_ids else (lambda x: x)
    assert {(name(r["query_id"]), r["rank"]): name(r["id"]) for r in got} == expected


def _vectors(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")


def test_all_cells_are_exact(spark):
    v = _unit(300, 8, 3)
    v[100:200] = v[0]  # a third of the texts are copies, all in one cell
    df = _vectors(spark, v)
    exact = X.knn(df, df, 4)
    index = N.fit_index(df, n_cells=7, probes=7)
    everything = N.knn_approx(df, df, 4, index, tile_rows=64)
    assert X.knn_recall(everything, exact).first()["recall"] == 1.0
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    some = N.knn_approx(df, df, 4, index._replace(probes=2), tile_rows=16)
    v = v.astype("float32").astype("float64")
    for r in some.collect():
        assert r["query_id"] != r["id"]
        assert r["sim"] == pytest.approx(v[r["query_id"]] @ v[r["id"]], abs=1e-8)


def test_a_cell_of_more_than_2048_vectors(spark):
    """A draw of 52 bits times the vectors of such a cell is past a long."""
    df = _vectors(spark, _unit(3000, 4, 8))
    index = N.fit_index(df, n_cells=1, probes=1)
    found = N.knn_approx(df, df, 2, index, tile_rows=1000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, X.knn(df, df, 2).collect()))
    places = spark.range(3000).select(*[X._tile("tile", F.lit(n)).alias(f"t{n}") for n in (2047, 5000)])
    for n, most in ((2047, 2046), (5000, 4999)):
        low, high = places.agg(F.min(f"t{n}"), F.max(f"t{n}")).first()
        assert 0 <= low < n // 100 and n - n // 100 < high <= most


def test_cells_do_less_work_as_vectors_grow(spark):
    """Vectors in groups: few cells are enough, and a smaller share of more vectors."""
    shares = []
    for n in (1000, 4000):
        r = np.random.default_rng(4)
        v = r.normal(size=(n // 20, 16))[r.integers(0, n // 20, n)] + 0.15 * r.normal(size=(n, 16))
        df = _vectors(spark, v / np.linalg.norm(v, axis=1, keepdims=True))
        index = N.fit_index(df, 5)
        found = N.knn_approx(df, df, 5, index)
        assert X.knn_recall(found, X.knn(df, df, 5)).first()["recall"] >= 0.95
        shares.append(N.knn_work(df, df, index).first()["share"])
    assert shares[1] < shares[0] < 0.25 and shares[1] < 0.1


def test_cells_are_the_same_on_any_partitioning(spark):
    df = _vectors(spark, _unit(400, 8, 6))
    one, many = N.fit_index(df.coalesce(1)), N.fit_index(df.repartition(9))
    assert (one.centroids == many.centroids).all() and one.probes == many.probes


def test_neighbours_of_nothing(spark):
    df = _vectors(spark, _unit(20, 4, 1))
    empty = df.where("false")
    assert N.knn_approx(df, empty, 3).count() == 0
    assert N.knn_approx(empty, df, 3).count() == 0
    assert N.knn_work(empty, empty, N.fit_index(empty)).first()["products"] == 0


def test_supcon_tiles_agree(spark):
    v = _unit(90, 6, 5)
    df = spark.createDataFrame(
        [(0 if i < 70 else 1, i, x.tolist(), i % 3) for i, x in enumerate(v)],
        "batch_id int, id long, vec array<double>, label int",
    )
    whole = {r["batch_id"]: r["loss"] for r in L.supcon_loss(df).collect()}
    tiled = {r["batch_id"]: r["loss"] for r in L.supcon_loss(df, tile_rows=16).collect()}
    assert tiled == pytest.approx(whole)


def test_mean_pool_without_any_mask(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)],
        "key string, vec array<double>, mask int",
    )
    got = {r["key"]: r["pooled"] for r in X.mean_pool(df, "key", "vec", "mask").collect()}
    assert got == {"a": pytest.approx([2.0, 3.0]), "b": [0.0, 0.0]}


@pytest.fixture(scope="module")
def some_texts(spark):
    rows = [(i, " ".join(f"w{j % (i + 1)}" for j in range(i % 17)) + ("!" * (i % 3))) for i in range(60)]
    rows.append((99, "x" * 5000 + " tail"))  # a token too long for the broadcast head
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("budget", [128 << 20, 2000, 0])
def test_encode_and_decode_round_trip(some_texts, budget):
    vocab = materialize(K.build_vocab(some_texts, specials=K.Specials()), "vocab")
    lists = some_texts.select("id", words("text").alias("t"))
    ids = K.encode(lists, vocab, "t", K.Specials(), budget=budget)
    back = {r["id"]: r["decoded"] for r in K.decode(ids, vocab, budget=budget).collect()}
    assert back == {r["id"]: " ".join(r["t"]) for r in lists.collect()}


@pytest.mark.parametrize("budget", [128 << 20, 2000])
def test_unknown_tokens(some_texts, spark, budget):
    vocab = materialize(K.build_vocab(some_texts.where("id < 30"), specials=K.Specials()), "vocab")
    known = {r["tok"]: r["tok_id"] for r in vocab.collect()}
    lists = some_texts.select("id", words("text").alias("t"))
    got = {r["id"]: r["input_ids"] for r in K.encode(lists, vocab, "t", K.Specials(), budget=budget).collect()}
    assert got == {r["id"]: [known.get(t, 0) for t in r["t"]] for r in lists.collect()}


def test_vocab_difference(some_texts):
    vocab = K.build_vocab(some_texts)
    ids = sorted(r["tok_id"] for r in vocab.collect())
    assert ids == list(range(len(ids)))
    used = K.token_set(some_texts.where("id < 20"))
    left = {r["tok"] for r in K.out_of_corpus(vocab, used).collect()}
    assert left.isdisjoint({r["tok"] for r in used.collect()})


def test_padded_batches(some_texts):
    vocab = materialize(K.build_vocab(some_texts, specials=K.Specials()), "vocab")
    rows = K.tokenize(some_texts, vocab, max_len=100).drop("attention_mask")
    plan = B.assign_batches(rows.select("id"), 8, 1)
    out = K.pad_batch(B.fetch_rows(plan, rows), 0).collect()
    for r in out:
        assert len(r["input_ids"]) == len(r["attention_mask"]) == r["padded_length"]
        assert r["padded_length"] % 64 == 0 and sum(r["attention_mask"]) == r["input_length"] <= 100


def test_salted_join_matches_plain(spark):
    left = spark.range(500).select("id", (F.col("id") % 3 * F.col("id") % 2).alias("k"))
    right = spark.createDataFrame([(0, "a"), (7, "z")], "k long, v string")
    for how in ("inner", "left"):
        salted = salted_join(left, right, ["k"], F.col("id"), how)
        plain = left.join(right, ["k"], how)
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(salted.columns).collect()))


def test_series_with_long_runs(spark):
    df = spark.range(5000).select(
        F.lit("r").alias("run"),
        (F.col("id") * 1000).alias("step"),
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("metric"),
    )
    values = [r["metric"] for r in df.orderBy("step").collect()]
    best, waited, expected = None, 0, []
    for v in values:
        waited = 0 if best is None or v >= best else waited + 1
        best = v if best is None else max(best, v)
        expected.append((best, waited))
    got = series.best_and_patience(df).orderBy("step").collect()
    assert [(r["best"], r["patience"]) for r in got] == expected
    ema = values[0]
    for v in values[1:]:
        ema = 0.01 * v + 0.99 * ema
    assert series.ema(df, 0.99).first()["ema"] == pytest.approx(ema)


@pytest.mark.parametrize("plan", [lambda df: B.prompt_batches(df, 8, 5), lambda df: B.balanced_batches(df, 8, 5)])
def test_places_of_a_batch_are_drawn_in_many_tasks_by_keys_made_once(hot, plan, monkeypatch):
    whole = {tuple(r) for r in plan(hot).collect()}
    monkeypatch.setattr(B, "PLACES_PER_TASK", 512)
    made = plan(hot)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Plans are printed from the top: keys stand once, below the places, above the deal of batches.
    (keys,) = [i for i, line in enumerate(lines) if "AS _keys" in line]
    places = max(i for i, line in enumerate(lines[:keys]) if "Generate explode(" in line)
    dealt = next(i for i, line in enumerate(lines) if i > keys and "RepartitionByExpression [batch_id" in line)
    assert places < keys < dealt and lines[dealt].rstrip().endswith(", 6")
    assert {tuple(r) for r in made.collect()} == whole


def test_arrow_batches_of_models_and_tokens_are_cut_by_bytes(spark):
    from textprov.models.sparse import hashed_rows
    from textprov.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(3000, numPartitions=1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    vocab = spark.createDataFrame([("word", 1, 0)], "tok string, n long, tok_id int")
    makers = (
        lambda: hashed_rows(texts, 64, "text", ["id"]),
        lambda: K.encode(texts.select("id", words("text").alias("t")), vocab, "t", K.NO_SPECIALS),
    )
    for make in makers:
        spark.conf.unset(key)
        made = make()
        assert spark.conf.get(key) == str(BATCH_BYTES)
        assert made.count() == 3000

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    seen = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(seen) > 3 and max(seen) < 2 * BATCH_BYTES


def test_a_query_travels_once_to_a_tile_however_many_cells_it_asks_for(spark, monkeypatch):
    df = _vectors(spark, _unit(300, 8, 3))
    index = N.fit_index(df, n_cells=12, probes=12)
    match, moved = N._match, []

    def seen(left, right, *rest):
        moved.extend([left.count(), right.count()])
        return match(left, right, *rest)

    monkeypatch.setattr(N, "_match", seen)
    found = N.knn_approx(df, df, 4, index, tile_rows=150)
    assert moved == [600, 600]  # two tiles of either side
    assert X.knn_recall(found, X.knn(df, df, 4)).first()["recall"] == 1.0


def test_a_look_up_takes_as_many_entries_as_the_vocabulary_has():
    import pyarrow as pa

    class Shared:
        value = (pa.array([f"w{i}" for i in range(100)]), pa.array(range(100), pa.int32()))

    lists = [[f"w{i}", "none"] if i % 7 else None for i in range(90)] + [[]]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x], pa.list_(pa.string()))], names=["id", "t"])
        for i, x in enumerate(lists)
    ]
    out = list(K._head_lookup(Shared, "t", "tok")(iter(batches)))
    assert len(out) == 2
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in rows] == list(range(91))
    assert [r["_found"] for r in rows] == [[i, None] if i < 90 and i % 7 else [] for i in range(91)]
    assert [r["_at"] for r in rows] == [[1] if i < 90 and i % 7 else [] for i in range(91)]
