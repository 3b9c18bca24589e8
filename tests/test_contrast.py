"""The contrastive embedder: its gradient, its repeatability, and what it learns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textprov.catalog.inputs import essays
from textprov.models import contrast as C
from textprov.models.embedder import count_words, embed, fit_embedder
from textprov.models.sparse import WEIGHT, hashed_rows
from textprov.operators.batches import balanced_batches, fetch_rows
from textprov.operators.losses import _each_group, supcon_loss
from textprov.operators.vectors import knn
from textprov.plans.contrast import contrastive_losses
from textprov.plans.detect import split_essays
from textprov.session import materialize


@pytest.fixture(scope="module")
def folds(spark, sf):
    """All texts under one prompt, so that batches have enough of both classes."""
    rows = essays(spark, sf).withColumn("prompt_id", F.lit(1))
    return [materialize(f, "fold") for f in split_essays(rows, 0.7)]


def _loss(df, plan, model):
    vectors = materialize(C.embed_learned(model, df.select("id", "generated", "text")).drop("text"), "vectors")
    rows = fetch_rows(plan, vectors.select("id", "vec"))
    return supcon_loss(rows, "batch_id", "vec", "generated")


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    z, label = r.normal(size=(12, 5)), r.integers(0, 2, 12)
    gradient = C._batch_gradient(0.1)
    dz, _ = gradient(z, label)
    for i, k in [(0, 0), (3, 2), (11, 4)]:
        step = np.zeros_like(z)
        step[i, k] = 1e-6
        up, down = (gradient(z + d, label)[1].sum() for d in (step, -step))
        assert (up - down) / 2e-6 == pytest.approx(dz[i, k], rel=1e-4, abs=1e-7)


def test_sums_and_losses_agree_with_the_operator(spark, folds):
    """The trained loss is the library's contrastive loss of the same batches."""
    train, _ = folds
    rows = C.batched_rows(train, 256, 16)
    p = np.floor(np.random.default_rng(1).normal(size=(257, 4)) * WEIGHT).astype(np.int64)
    p[256] = 0
    g, loss, n = C.gradient_sums(rows, p, 0.1)
    plan = balanced_batches(train, 16, 42, None)
    each = _loss(train, plan, C.Embedder(256, p)).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("x"))
    assert loss == pytest.approx(each.first()["x"], abs=1e-5) and n == rows.count()
    f = int(np.abs(g).sum(axis=1).argmax())
    step = np.zeros_like(p)
    step[f, 1] = WEIGHT // 1024
    up, down = (C.gradient_sums(rows, p + d, 0.1)[1] for d in (step, -step))
    assert (up - down) * 512 == pytest.approx(g[f, 1], rel=0.05, abs=1e-4)
    again, _, _ = C.gradient_sums(rows.repartition(1).sortWithinPartitions("batch_id", "id"), p, 0.1)
    assert (again == g).all()


def test_loss_falls_on_texts_not_seen_and_neighbours_share_a_class(spark, folds, tmp_path):
    train, valid = folds
    model, log = C.fit_contrastive(train, 1 << 12, 16, batch_size=16, steps=12)
    assert log[-1].loss < log[0].loss
    plan = materialize(balanced_batches(valid, 16, 1, None), "plan")
    before, _ = C.fit_contrastive(train, 1 << 12, 16, batch_size=16, steps=0)
    mean = lambda m: _loss(valid, plan, m).agg(F.avg("loss")).first()[0]
    assert mean(model) < 0.9 * mean(before)

    def same_class(vectors):
        vectors = materialize(vectors.select("id", "vec", "generated"), "vectors")
        near = knn(vectors, vectors, 3)
        a = vectors.select(F.col("id").alias("query_id"), F.col("generated").alias("g"))
        b = vectors.select("id", F.col("generated").alias("h"))
        return near.join(a, "query_id").join(b, "id").agg(F.avg((F.col("g") == F.col("h")).cast("int"))).first()[0]

    assert same_class(C.embed_learned(model, valid)) > same_class(C.embed_learned(before, valid))
    model.save(spark, f"{tmp_path}/embedder")
    assert (C.Embedder.load(spark, f"{tmp_path}/embedder").projection == model.projection).all()


def test_vectors_have_unit_length_or_none(spark, folds):
    model = C.Embedder(64, np.r_[np.ones((64, 3), np.int64) * WEIGHT, np.zeros((1, 3), np.int64)])
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, " "), (4, "x " * 200_000)], "id long, text string")
    size = {r["id"]: sum(x * x for x in r["vec"]) for r in C.embed_learned(model, df).collect()}
    assert size == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0})


def test_vectors_are_made_in_one_pass_of_python(spark):
    model = C.Embedder(64, np.random.default_rng(3).integers(-WEIGHT, WEIGHT, (65, 4)))
    df = spark.createDataFrame([(i, f"a word{i % 5} and b{i}" if i % 9 else None) for i in range(50)], "id long, text string")
    vectors = C.embed_learned(model, df)
    assert vectors._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert vectors.columns == ["id", "text", "vec"] and vectors.select("id", "text").exceptAll(df).count() == 0
    got = {r["id"]: r["vec"] for r in vectors.collect()}
    for r in hashed_rows(df, 64, "text", ["id"]).collect():
        z = (model.projection[r["_idx"]] * np.array(r["_val"])[:, None]).sum(axis=0)
        assert got[r["id"]] == pytest.approx(z / np.linalg.norm(z))


def _essays(spark):
    rows = [(i, f"word{i % 7} and, word{i % 3} again", i % 2, i % 2 * (i % 4) // 2) for i in range(40)]
    return spark.createDataFrame(rows + [(40, None, 0, 1)], "id long, text string, prompt_id int, generated int")


def test_contrastive_losses_read_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    once = _essays(spark).withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    out = {r["batch_id"]: (r["n"], r["loss"]) for r in contrastive_losses(once, 4).collect()}
    assert read.value == 41
    assert out == {r["batch_id"]: (r["n"], r["loss"]) for r in contrastive_losses(_essays(spark), 4).collect()}
    assert len(out) == 10 and {n for n, _ in out.values()} == {4}


def test_stored_counts_embed_as_their_texts(spark):
    t = _essays(spark).where("text is not null").select("id", "text")
    counts = materialize(count_words(t, 64), "counts")
    assert counts.columns == ["id", "_tf"]
    a, b = fit_embedder(t, 64), fit_embedder(counts)
    want = {r["id"]: r["vec"] for r in embed(a, t).collect()}
    for model in (a, b):
        assert {r["id"]: r["vec"] for r in embed(model, counts).collect()} == want
    assert {r["id"]: r["vec"] for r in embed(b, t).collect()} == want


def test_short_groups_share_an_output_batch():
    batches = pa.Table.from_pydict({"k": [1, 1, 2, 3, 3, 4], "x": [1, 2, 3, 4, 5, 6]}).to_batches(max_chunksize=5)
    took = []
    run = _each_group(("k",), lambda rows: (took.append(rows["x"].to_pylist()), rows)[1])
    out = [b.column("x").to_pylist() for b in run(batches)]
    assert took == [[1, 2], [3], [4, 5], [6]]
    assert out == [[1, 2, 3], [4, 5], [6]]
