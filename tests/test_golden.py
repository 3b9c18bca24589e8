"""Values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from textprov.functions import text as X, tokens as T, vectors as V
from textprov.operators import losses as L, metrics as M, series as S, tokens as K
from textprov.operators.rows import exclude_prompts, fill_defaults


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(
        column.alias("out")
    ).first()["out"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("no marker at all", "no marker at all"),
        ("a ### Response: b ### Response: c</s>d", "c"),
        ("x </s> y ### Response: z <|endoftext|> w", "z <|endoftext|> w"),
        ("### Response: only this <|endoftext|> not this", "only this"),
        ("### Response: <unk> a <unk></s>", " a "),
        ("### Response:</s>", ""),
        ("", ""),
    ],
)
def test_clean_response(spark, raw, clean):
    assert one(spark, X.clean_response("t"), t=raw) == clean


@pytest.mark.parametrize(
    "raw", ["\ta b\r\n", "  a b  ", "\x1c\x1d\x1e\x1fa b\x1f", "a b", "\u0085 a b "]
)
def test_py_strip_is_pythons(spark, raw):
    assert one(spark, X.py_strip("t"), t=raw) == raw.strip()


def test_whitespace_count():
    assert len(X.PY_WHITESPACE) == 29


def test_instruction_fills_and_numbers(spark):
    df = spark.createDataFrame(
        [("P", None, None, 8.0, None, " Yes "), ("Q", "T", 4.5, None, "No", None)],
        "prompt_name string, task string, holistic_essay_score double, grade_level double, "
        "ell_status string, student_disability_status string",
    )
    rows = [r[0] for r in fill_defaults(df).select(X.instruction()).collect()]
    assert rows == [
        "Prompt: P\nTask: nan\nScore: -1\nStudent Grade Level: 8\n"
        "English Language Learner: Unknown\nDisability Status:  Yes",
        "Prompt: Q\nTask: T\nScore: 4.5\nStudent Grade Level: -1\n"
        "English Language Learner: No\nDisability Status: Unknown",
    ]


def test_question_and_chat(spark):
    assert one(spark, X.add_question("t"), t=" a ") == "a\n###\nIs the essay generated by AI?"
    assert (
        one(spark, X.format_chat("i", "r"), i="do", r="done")
        == "### Instruction:\ndo\n\n### Response: done </s>"
    )


def test_exclude_prompts(spark):
    df = spark.createDataFrame(
        [("Task: Text dependent",), ("task: text dependent",), ("CAR-free",), ("fine",)], "prompt string"
    )
    kept = {r[0] for r in exclude_prompts(df).collect()}
    assert kept == {"task: text dependent", "fine"}


def test_ranking_loss_with_ties(spark):
    logits, labels = [0.3, -1.2, 2.0], [1, 0, 1]
    p = [1 / (1 + math.exp(-x)) for x in logits]
    total = sum(
        max(-(p[i] - p[j]) * ((labels[i] > labels[j]) - (labels[i] < labels[j])) + 0.7, 0)
        for i in range(3)
        for j in range(3)
    )
    df = spark.createDataFrame(list(zip([0] * 3, logits, labels)), "batch_id int, logit double, generated int")
    for n_cells in (None, 1):
        row = L.ranking_loss(df, n_cells=n_cells).first()
        assert row["n"] == 3 and row["loss"] == pytest.approx(total / 9)
    same = df.withColumn("generated", F.lit(0))
    assert L.ranking_loss(same).first()["loss"] == pytest.approx(0.7)


def _supcon(vectors, labels, tau=0.1):
    n, total = len(vectors), 0.0
    for i in range(n):
        pos = neg = 0.0
        for j in range(n):
            h = sum(a * b for a, b in zip(vectors[i], vectors[j])) / tau
            same = labels[i] == labels[j]
            pos += math.exp(h) if same and i != j else 1.0
            neg += math.exp(h) if not same else 1.0
        total += math.log(pos / (pos + neg))
    return -total / n


@pytest.mark.parametrize("labels", [[0, 0, 1, 1], [0, 1, 1, 1]])
def test_supcon_loss(spark, labels):
    vectors = [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [-0.8, 0.6]]
    df = spark.createDataFrame(
        [("b", f"i{i}", v, y) for i, (v, y) in enumerate(zip(vectors, labels))],
        "batch_id string, id string, vec array<double>, label int",
    )
    for tile_rows in (512, 2, 1):
        row = L.supcon_loss(df, tile_rows=tile_rows).first()
        assert row["batch_id"] == "b" and row["n"] == 4
        assert row["loss"] == pytest.approx(_supcon(vectors, labels))


@pytest.mark.parametrize(
    "scores, labels, auc",
    [
        ([0.5, 0.5, 0.5, 0.5], [1, 0, 1, 0], 0.5),
        ([0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], 1.0),
        ([0.9, 0.8, 0.2, 0.1], [0, 0, 1, 1], 0.0),
        ([0.1, 0.2], [1, 1], None),
    ],
)
def test_roc_auc(spark, scores, labels, auc):
    df = spark.createDataFrame(list(zip(scores, labels)), "predictions double, truths int")
    for n_cells in (None, 1, 3):
        assert M.roc_auc(df, n_cells=n_cells).first()["auc"] == auc


def test_roc_auc_of_nothing(spark):
    df = spark.createDataFrame([], "predictions double, truths int")
    assert M.roc_auc(df).count() == 0


def _log(spark, values, run="r"):
    return spark.createDataFrame(
        [(run, i, float(v)) for i, v in enumerate(values)], "run string, step long, metric double"
    )


def test_best_and_patience(spark):
    rows = S.best_and_patience(_log(spark, [1, 3, 2, 2.5, 3, 1, 4])).orderBy("step").collect()
    assert [r["is_best"] for r in rows] == [True, True, False, False, True, False, True]
    assert [r["patience"] for r in rows] == [0, 0, 1, 2, 0, 1, 0]
    down = S.best_and_patience(_log(spark, [3, 1, 1, 2, 0.5]), "min").orderBy("step").collect()
    assert [r["patience"] for r in down] == [0, 0, 0, 1, 0]
    assert S.early_stop(S.best_and_patience(_log(spark, [3, 1, 1, 2, 0.5])), 3).first()["stop_step"] == 3


def test_ema_and_running_mean(spark):
    values = [1.0, 5.0, 2.0, 8.0]
    expected = values[0]
    for v in values[1:]:
        expected = 0.1 * v + 0.9 * expected
    assert S.ema(_log(spark, values), 0.9, bits=1, levels=2).first()["ema"] == pytest.approx(expected)
    rows = S.running_mean(_log(spark, values)).orderBy("step").collect()
    assert [r["avg"] for r in rows] == pytest.approx([1.0, 3.0, 8 / 3, 4.0])


def test_vectors(spark):
    assert one(spark, V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert one(spark, V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.sigmoid(F.lit(-800.0))) == 0.0


def test_bce_is_stable(spark):
    df = spark.createDataFrame([(800.0, 1), (-800.0, 0), (0.0, 1)], "logit double, generated int")
    assert L.bce_with_logits(df).first()["loss"] == pytest.approx(math.log(2) / 3)


def test_specials():
    assert K.Specials().pad_id == 0
    assert K.Specials(pad="<pad>").pad_id == 3
    assert K.Specials(unk=None).pad_id == 1  # the end token
    assert K.Specials(unk=None, bos=None, eos="").names == ["</s>"]


def test_label_mask_and_cut(spark):
    df = spark.createDataFrame([(1, "a b c", "x y")], "id int, instruction string, text string")
    vocab = K.build_vocab(
        df.select(F.concat(X.format_source("instruction"), "text").alias("text")), specials=K.Specials()
    )
    whole = K.supervised_lists(df, vocab).first()
    n_source = len("# # # Instruction : a b c # # # Response :".split()) + 1
    assert whole["labels"][: n_source - 1] == [-100] * (n_source - 1)
    assert whole["labels"][n_source - 1 :] == whole["input_ids"][n_source - 1 :]
    strict = K.supervised_lists(df, vocab, offset=0).first()
    assert strict["labels"][:n_source] == [-100] * n_source
    assert strict["labels"][n_source:] == whole["input_ids"][n_source:]
    assert whole["input_ids"][0] == 1 and whole["input_ids"][-1] == 2
    assert K.supervised_lists(df, vocab, max_len=4).first()["labels"] == whole["input_ids"][-4:]
    cut = K.supervised_lists(df, vocab, max_len=4, offset=0).first()
    assert cut["labels"] == [-100] + whole["input_ids"][-3:]
    literal = K.supervised_lists(df, vocab, max_len=4, offset=1, compat=True).first()
    assert literal["labels"] == [-100] * 4


def test_padding(spark):
    ids = F.array(*[F.lit(i) for i in (7, 8, 9)])
    assert one(spark, T.pad(ids, F.lit(5), 0)) == [0, 0, 7, 8, 9]
    assert one(spark, T.pad(ids, F.lit(5), 0, "right")) == [7, 8, 9, 0, 0]
    assert one(spark, T.attention_mask(ids, F.lit(5))) == [0, 0, 1, 1, 1]
    assert one(spark, T.padded_length(F.lit(65))) == 128
    assert one(spark, T.truncate_tokens(ids, 2, "left")) == [8, 9]
    assert one(spark, T.truncate_tokens(ids, 2, "right")) == [7, 8]
    assert one(spark, T.truncate_tokens(ids, 9, "left")) == [7, 8, 9]


def test_mask_augment_bounds(spark):
    ids = F.array(*[F.lit(i) for i in range(12)])

    def masked(p):
        return one(spark, T.mask_augment(ids, p, 0, [0, 1, 2], 5, F.lit("k")))

    assert masked(0.0) == list(range(12))
    assert masked(1.0) == [0, 1, 2] + [0] * 9
    empty = F.array().cast("array<int>")
    assert one(spark, T.mask_augment(empty, 0.5, 0, [], 5, F.lit("k"))) == []
    wide = F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.lit(7))
    share = one(spark, T.mask_augment(wide, 0.15, 0, [], 5, F.lit("k"))).count(0) / 5000
    assert 0.13 < share < 0.17
