"""Sources, sinks, models, jobs and the stream."""

import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprov.catalog.inputs import essays, human_essays, texts
from textprov.functions.text import add_question, clean_response
from textprov.models.detector import fit_best, fit_detector, hashed, score
from textprov.models.embedder import embed, fit_embedder
from textprov.models.ranker import fit_ranker, rank_score
from textprov.models.sparse import VALUE, WEIGHT, LinearModel, Trainer, _gradient_sums, logistic
from textprov.operators.infer import batch_infer, map_columns
from textprov.operators.metrics import roc_auc
from textprov.operators.pairs import human_ai_pairs
from textprov.operators.rows import drop_null_text
from textprov.operators.series import best_and_patience
from textprov.operators.tokens import tokenize_pairs
from textprov.operators.vectors import knn
from textprov.plans.detect import pair_texts, run_detection, run_ranking, split_essays
from textprov.plans.generate import run_generation
from textprov.session import materialize, scratch, shared_dir
from textprov.sources import readers as R, writers as W
from textprov.streaming.essays import essay_stream, write_available

NASTY = ["two\nlines", 'say "x", y', " kept blanks ", "a\\b", "", "NA", "null", "é ß 漢", None, "\\N"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(str(i), t, i % 2, i) for i, t in enumerate(NASTY)],
        "id string, text string, generated int, prompt_id int",
    )
    W.write_csv(df, f"{tmp_path}/train_essays.csv")
    raw = {r["id"]: r["text"] for r in R.read_csv(spark, f"{tmp_path}/train_essays.csv").collect()}
    # The null mark itself is the one text that cannot be told from a null.
    assert raw == {str(i): (None if t == "\\N" else t) for i, t in enumerate(NASTY)}
    back = {r["id"]: r["text"] for r in R.read_essays(spark, str(tmp_path)).collect()}
    null = {"", "NA", "null", "\\N", None}
    assert back == {str(i): (None if t in null else t) for i, t in enumerate(NASTY)}


def test_foreign_csv_and_parquet_choice(spark, tmp_path):
    (tmp_path / "train_essays.csv").write_text(
        'prompt_id,id,text,generated,extra\n3.0,a,"x ""y""\nz",1,q\n,b,,0,\nbad,c,t,1,\n'
    )
    rows = {r["id"]: r for r in R.read_essays(spark, str(tmp_path)).collect()}
    assert rows["a"]["text"] == 'x "y"\nz' and rows["a"]["prompt_id"] == 3
    assert rows["b"]["text"] is None and rows["b"]["prompt_id"] is None
    assert rows["c"]["prompt_id"] is None and rows["c"]["generated"] == 1
    other = tmp_path / "p"
    spark.createDataFrame([("a", "t", 1, 2)], "id string, text string, generated int, prompt_id int").write.parquet(
        f"{other}/train_essays.parquet"
    )
    assert R.read_essays(spark, str(other)).count() == 1


def test_failed_rows_are_kept_apart(spark):
    df = spark.range(20).withColumn("prompt", F.concat(F.lit("p"), "id")).coalesce(1)

    def load():
        def run(batch):
            if (batch["id"] % 7 == 3).any():
                raise RuntimeError("bad")
            return [[p, p] for p in batch["prompt"]]

        return run

    rows = {r["id"]: r for r in batch_infer(df, load).collect()}
    assert len(rows) == 20
    assert {i for i, r in rows.items() if r["error"]} == {3, 10, 17}
    assert rows[4]["responses"] == ["p4", "p4"] and rows[3]["responses"] is None


def test_one_bad_row_costs_few_calls(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    calls = spark.sparkContext.accumulator(0)

    def load():
        def run(batch):
            calls.add(1)
            if (batch["id"] == 7777).any():
                raise RuntimeError("bad")
            return [[str(i)] for i in batch["id"]]

        return run

    rows = batch_infer(spark.range(10_000).coalesce(1), load).where("error is not null").collect()
    assert [r["id"] for r in rows] == [7777]
    assert calls.value < 50


def test_shared_folder_has_to_be_named():
    class Other:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Other())
    Other.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Other())


def test_intermediate_tables_go(spark):
    outer = materialize(spark.range(5), "outer")
    with scratch(spark):
        inner = materialize(spark.range(5), "inner")
        paths = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert paths and all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths))
    assert outer.count() == 5


def test_pairs_use_every_text(spark):
    rows = [(i, 1, int(i > 2)) for i in range(20)] + [(30, 2, 1), (31, 3, 0), (32, None, 1), (33, None, 0)]
    df = spark.createDataFrame(rows, "id long, prompt_id int, generated int")
    pairs = human_ai_pairs(df, 1).collect()
    assert {p["human_id"] for p in pairs} == {0, 1, 2}
    assert sorted(p["ai_id"] for p in pairs) == list(range(3, 20))
    assert max(Counter(p["human_id"] for p in pairs).values()) == 6


def test_neighbours_without_a_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.6, 0.8]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    found = {(r["query_id"], r["id"]) for r in knn(df, df, 1).collect()}
    assert found == {(1, 4), (4, 5), (5, 4)}
    with pytest.raises(ValueError):
        knn(df, df.union(spark.createDataFrame([(9, [1.0])], df.schema)), 1)


def test_detector_beats_chance_and_survives_saving(spark, sf, tmp_path):
    train, valid = split_essays(essays(spark, sf), 0.8)
    model = fit_detector(train, 1 << 14, steps=10)
    out = score(model, valid)
    assert roc_auc(out, "predictions", "generated").first()["auc"] > 0.6
    unlabelled = score(model, texts(spark, sf))
    assert unlabelled.where("predictions is null").count() == 0
    model.save(spark, f"{tmp_path}/model")
    again = score(LinearModel.load(spark, f"{tmp_path}/model"), valid)
    assert {tuple(r) for r in again.select("id", "predictions").collect()} == {
        tuple(r) for r in out.select("id", "predictions").collect()
    }


def test_weights_do_not_depend_on_partitions(spark, sf):
    train, valid = split_essays(essays(spark, sf), 0.8)
    few, many = (fit_detector(train.repartition(n), 1 << 10, steps=4) for n in (1, 8))
    assert (few.weights == many.weights).all() and few.weights.any()
    one, eight = (
        {tuple(r) for r in score(few, valid.repartition(n)).select("id", "predictions").collect()} for n in (1, 8)
    )
    assert one == eight


def test_gradient_is_that_of_the_loss(spark):
    """A whole-number gradient against differences of the mean loss."""
    rows = [(f"word{i % 7} common word{i % 3}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "text string, generated int")
    trainer = Trainer(hashed(df, 64, "generated").repartition(3), 64, [{}, {"reg": 0.1}], "generated", logistic)
    trainer.step([0, 1])
    trainer.step([0])
    w = trainer.whole([0])
    sums, loss = _gradient_sums(trainer.rows, w, "generated", logistic)
    for f in np.flatnonzero(sums[:, 0])[:5]:
        step = np.zeros_like(w)
        step[f] = WEIGHT // 256
        up, down = (_gradient_sums(trainer.rows, w + d, "generated", logistic)[1][0] for d in (step, -step))
        assert (up - down) * 128 == pytest.approx(sums[f, 0] / (VALUE * WEIGHT), abs=1e-2)
    assert not np.array_equal(trainer.weights[:, 0], trainer.weights[:, 1])


def test_search_trains_all_settings_and_stops_each(spark, sf):
    train, valid = split_essays(essays(spark, sf), 0.8)
    grid = [{"reg": 0.0, "rate": 0.1}, {"reg": 1000.0, "rate": 0.1}]
    found = fit_best(train, valid, grid, 1, 1 << 12, steps=8, every=2)
    log = found.log.orderBy("run", "step").collect()
    judged = best_and_patience(found.log.select("run", "step", "metric"))
    assert sorted(map(tuple, log)) == sorted(map(tuple, judged.select(found.log.columns).collect()))
    for name in {r["run"] for r in log}:
        own = [r for r in log if r["run"] == name]
        assert all(r["patience"] < 1 for r in own[:-1])  # nothing is trained after it has stopped
        assert own[-1]["patience"] == 1 or own[-1]["step"] == 8
    best = max(r["metric"] for r in log)
    auc = roc_auc(score(found.model, valid), "logit", "generated").first()["auc"]
    assert auc == best
    alone = fit_best(train, valid, grid[:1], 1, 1 << 12, steps=8, every=2)
    assert (alone.model.weights == found.model.weights).all()


def test_texts_without_words(spark):
    rows = [(1, None, 1), (2, "", 0), (3, " \t", 1), (4, "one", 0), (5, "one", 1)]
    df = spark.createDataFrame(rows, "id long, text string, generated int")
    model = fit_detector(df, 16, steps=3)
    got = {r["id"]: r["logit"] for r in score(model, df).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5]
    assert fit_detector(df.where("false"), 16, steps=1).weights.any() == np.False_
    assert score(model, df.where("false")).count() == 0


def test_ranker_orders_its_pairs(spark, sf):
    e = essays(spark, sf)
    pairs = pair_texts(e)
    model = fit_ranker(pairs, 1 << 16, steps=15)
    human = rank_score(model, pairs.select("pair_id", F.col("human").alias("text"))).select(
        "pair_id", F.col("logit").alias("h")
    )
    ai = rank_score(model, pairs.select("pair_id", F.col("ai").alias("text"))).select(
        "pair_id", F.col("logit").alias("a")
    )
    right = human.join(ai, "pair_id").agg(F.avg((F.col("a") > F.col("h")).cast("double"))).first()[0]
    assert right > 0.8


def test_embeddings_have_unit_length(spark, sf):
    t = texts(spark, sf).select("id", "text")
    vectors = embed(fit_embedder(t, 64), t)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    assert vectors.where(F.abs(norm - 1.0) > 1e-9).count() == 0


@pytest.mark.parametrize("job, fit", [(run_detection, {"n_features": 4096, "steps": 5}), (run_ranking, {"n_features": 64, "steps": 5})])
def test_training_jobs_write_predictions(spark, sf, tmp_path, job, fit):
    rows = essays(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "generated", "prompt_id")
    W.write_csv(rows, f"{tmp_path}/in/train_essays.csv")
    report = job(spark, f"{tmp_path}/in", f"{tmp_path}/out", "run1", 0.8, **fit)
    results = R.read_csv(spark, f"{tmp_path}/out/run1/result_df_last")
    submission = R.read_csv(spark, f"{tmp_path}/out/run1/oof_df_last")
    assert results.count() == submission.count() == report.results.count() > 50
    truth = {r["id"]: r["generated"] for r in rows.collect()}
    assert all(int(r["truths"]) == truth[r["id"]] for r in results.collect())
    assert submission.columns == ["id", "generated"]
    best = R.read_csv(spark, f"{tmp_path}/out/run1/result_df_best")
    assert best.exceptAll(results).count() == 0 and best.count() == results.count()


@pytest.mark.parametrize("job", [run_detection, run_ranking])
def test_training_jobs_stop_early_and_write_the_best(spark, sf, tmp_path, job):
    rows = essays(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "generated", "prompt_id")
    W.write_csv(rows, f"{tmp_path}/in/train_essays.csv")
    grid = [{"reg": 1e-4}, {"reg": 1e3}]
    size = {"n_features": 1024, "steps": 8, "every": 2}
    report = job(spark, f"{tmp_path}/in", f"{tmp_path}/out", "run1", 0.8, grid=grid, patience=1, **size)
    auc = {
        tag: roc_auc(
            R.read_csv(spark, f"{tmp_path}/out/run1/result_df_{tag}").select(
                F.col("predictions").cast("double"), F.col("truths").cast("int")
            )
        ).first()["auc"]
        for tag in ("best", "last")
    }
    assert auc["best"] >= auc["last"]
    assert abs(auc["best"] - report.scores.first()["lb"]) < 1e-4
    # A saved model scores another table without fitting again.
    model = LinearModel.load(spark, f"{tmp_path}/out/models/run1_best")
    assert score(model, texts(spark, sf)).where("logit is null").count() == 0


def test_generation_job(spark, sf, tmp_path):
    W.write_csv(
        human_essays(spark, sf).drop("id").withColumnRenamed("text", "full_text"), f"{tmp_path}/essays.csv"
    )

    def load():
        def run(batch):
            out = []
            for prompt, copy in zip(batch["prompt"], batch["copy"]):
                if copy == 2 and "Task: fr" in prompt:
                    raise ValueError("no")
                out.append(f"{prompt} answer {copy}</s></s>")
            return out

        return run

    failed = run_generation(spark, f"{tmp_path}/essays.csv", f"{tmp_path}/out", load, n=30, n_gen=3)
    assert failed.count() > 0 and failed.where("error <> 'ValueError: no'").count() == 0
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(lines) == 30 and len({r["id"] for r in lines}) == 30
    for r in lines:
        assert set(r) == {"id", "prompt", "temperature", "top_k", "guidance_scale", "penalty_alpha", "responses"}
        assert len(r["responses"]) == (2 if "Task: fr" in r["prompt"] else 3)
        assert r["responses"][0].endswith("answer 1")
        assert 0.5 <= r["temperature"] < 2 and 128 <= r["top_k"] <= 256

    # The same seed gives the same records, whatever the files of the input.
    with scratch(spark):
        again = f"{tmp_path}/again.csv"
        W.write_csv(R.read_csv(spark, f"{tmp_path}/essays.csv").repartition(5), again)
        banned = spark.createDataFrame([("zebra",), ("ant",)], "tok string")

        def listening(suppress):
            assert suppress == ["ant", "zebra"]
            return load()

        run_generation(spark, again, f"{tmp_path}/out2", listening, n=30, n_gen=3, suppress=banned)
    lines2 = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out2").collect()]
    assert sorted(lines, key=lambda r: r["id"]) == sorted(lines2, key=lambda r: r["id"])


def test_row_operators_on_a_stream(spark, sf, tmp_path):
    rows = essays(spark, sf).select(F.col("id").cast("string").alias("id"), "text", "generated", "prompt_id")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    model = fit_detector(rows, 1 << 10, steps=3)

    def work(df):
        kept = drop_null_text(df).withColumn("text", add_question("text"))
        return score(model, kept.withColumn("clean", clean_response("text")))

    query = write_available(work(essay_stream(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = work(rows)
    columns = ["id", "clean", "predictions"]
    assert {tuple(r) for r in got.select(columns).collect()} == {
        tuple(r) for r in want.select(columns).collect()
    }


def test_functions_of_columns(spark):
    """Set up once for each task, whole columns at a time, nulls kept."""
    def load():
        import pyarrow.compute as pc

        return lambda a, b: pc.add(a, b)

    df = spark.createDataFrame([(1, 2), (None, 3), (4, 5)], "a long, b long")
    got = map_columns(df, load, ["a", "b"], "sum", "long").collect()
    assert [tuple(r) for r in got] == [(1, 2, 3), (None, 3, None), (4, 5, 9)]
    assert map_columns(df.where("false"), load, ["a", "b"], "sum", "long").collect() == []


def test_pair_tokens(spark):
    rows = [(1, "a b c d", "x"), (2, None, "a a"), (3, "b", ""), (4, "zebra a", "b zebra")]
    pairs = spark.createDataFrame(rows, "pair_id long, human string, ai string")
    vocab = spark.createDataFrame([(t, 1, i + 3) for i, t in enumerate("abcdx")], "tok string, n long, tok_id int")
    got = {r["pair_id"]: (r["input_ids"], r["ai_input_ids"]) for r in tokenize_pairs(pairs, vocab, max_len=5).collect()}
    assert got == {
        1: ([1, 3, 4, 5, 2], [1, 7, 2]), 2: ([1, 2], [1, 3, 3, 2]), 3: ([1, 4, 2], [1, 2]),
        4: ([1, 0, 3, 2], [1, 4, 0, 2]),
    }


def test_unreadable_values_are_counted(spark, tmp_path):
    rows = [("a", "t", "1", "3"), ("b", "t", "0.7", "x"), ("c", "t", "1.0", "NA"), ("d", "t", "", None)]
    raw = spark.createDataFrame(rows, "id string, text string, generated string, prompt_id string")
    got = {r["id"]: (r["generated"], r["prompt_id"]) for r in R.conform(raw, R.ESSAYS).collect()}
    assert got == {"a": (1, 3), "b": (None, None), "c": (1, None), "d": (None, None)}
    assert R.unreadable(raw, R.ESSAYS).first().asDict() == {"id": 0, "text": 0, "generated": 1, "prompt_id": 1}
    W.write_csv(raw, f"{tmp_path}/train_essays.csv")
    assert R.read_essays(spark, str(tmp_path)).count() == 4
    with pytest.raises(ValueError, match="generated"):
        R.read_essays(spark, str(tmp_path), strict=True)


def test_too_many_tokens_to_suppress(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr("textprov.plans.generate.SUPPRESS_BYTES", 20)
    W.write_csv(human_essays(spark, sf).drop("id").withColumnRenamed("text", "full_text"), f"{tmp_path}/essays.csv")
    banned = spark.createDataFrame([("zebra",), ("ant",)], "tok string")
    with pytest.raises(ValueError, match="suppress"):
        run_generation(spark, f"{tmp_path}/essays.csv", f"{tmp_path}/out", lambda suppress: None, n=3, suppress=banned)
