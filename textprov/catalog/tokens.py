"""Vocabulary, encoding, padding and label masks."""

from pyspark.sql import functions as F

from textprov.catalog.batches import BS, SQL_PAIRS, sql_batches
from textprov.catalog.inputs import SQL_ANSWERS, SQL_ESSAYS, SQL_TEXTS, answers, corpus, essays, table, texts
from textprov.catalog.registry import query, sql_draw, sql_words
from textprov.catalog.strings import SQL_SOURCE, SQL_WHITE
from textprov.functions import tokens as T
from textprov.functions.text import format_source
from textprov.operators import batches as B, tokens as K
from textprov.plans.detect import pair_texts
from textprov.session import materialize

SP = K.Specials()  # <unk> 0, <s> 1, </s> 2; padding is <unk>
MAX_LEN = 128


def _list(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def sql_vocab(source: str, text: str = "text", base: int = 3) -> str:
    return f"""counts AS (
  SELECT tok, count(*) AS n FROM (SELECT unnest({sql_words(text)}) AS tok FROM {source}) GROUP BY 1),
vocab AS (
  SELECT tok, n, (row_number() OVER (ORDER BY n DESC, {sql_draw('vocab', 'tok')}, tok) - 1 + {base})::INTEGER AS tok_id
  FROM counts)"""


def sql_encoded(source: str, text: str = "text") -> str:
    """``encoded``: id, ids (whole lists with the begin token)."""
    return f"""long AS (
  SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS at
  FROM (SELECT id, {sql_words(text)} AS toks FROM {source})),
listed AS (
  SELECT l.id, list(v.tok_id ORDER BY l.at) AS ids FROM long l JOIN vocab v ON v.tok = l.tok GROUP BY 1),
encoded AS (
  SELECT s.id, [1] || coalesce(l.ids, []) AS ids FROM {source} s LEFT JOIN listed l ON l.id = s.id)"""


SQL_BASE = f"{SQL_TEXTS}, {sql_vocab('texts')}, {sql_encoded('texts')}"
SQL_CUT = f"list_slice(ids, greatest(len(ids) - {MAX_LEN} + 1, 1), len(ids))"


def vocabulary(df, text="text"):
    return materialize(K.build_vocab(df, text, SP), "vocab")


def encoded(spark, sf):
    t = corpus(spark, sf)
    return K.tokenize(t, vocabulary(t), SP)


@query("token_set", f"SELECT DISTINCT unnest({sql_words('text')}) AS tok FROM documents")
def token_set(spark, sf):
    return K.token_set(corpus(spark, sf))


@query("vocab", f"WITH {SQL_TEXTS}, {sql_vocab('texts', base=0)} SELECT tok, n, tok_id FROM vocab")
def vocab(spark, sf):
    return K.build_vocab(corpus(spark, sf))


@query(
    "out_of_corpus",
    f"""WITH {SQL_TEXTS}, {sql_vocab('texts', base=0)}
        SELECT tok, n, tok_id FROM vocab
        WHERE tok NOT IN (SELECT unnest({sql_words('text')}) FROM benchmark)""",
)
def out_of_corpus(spark, sf):
    used = K.token_set(table(spark, sf, "benchmark"))
    return K.out_of_corpus(K.build_vocab(corpus(spark, sf)), used)


@query(
    "tokenize",
    f"""WITH {SQL_BASE}
        SELECT id, array_to_string(ids, ',') AS input_ids, len(ids)::INTEGER AS input_length,
               array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask FROM encoded""",
)
def tokenize(spark, sf):
    return encoded(spark, sf).withColumns(
        {"input_ids": _list("input_ids"), "attention_mask": _list("attention_mask")}
    )


@query(
    "tokenize_cut",
    f"""WITH {SQL_BASE},
cut AS (SELECT id, [1] || list_slice(ids, greatest(len(ids) - {MAX_LEN - 1} + 1, 2), len(ids)) AS ids FROM encoded)
SELECT id, array_to_string(ids, ',') AS input_ids, len(ids)::INTEGER AS input_length FROM cut""",
)
def tokenize_cut(spark, sf):
    t = corpus(spark, sf)
    out = K.tokenize(t, vocabulary(t), SP, max_len=MAX_LEN, side="left")
    return out.select("id", _list("input_ids").alias("input_ids"), "input_length")


PAIR_LEN = 64


def _sql_side(name: str, of: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, [1] || coalesce(list(tok_id ORDER BY i) FILTER (WHERE tok_id IS NOT NULL), []) || [2] AS ids FROM (
    SELECT pair_id, unnest(list_concat(toks, [NULL])) AS tok, unnest(range(len(toks) + 1)) AS i FROM (
      SELECT pair_id, list_slice({sql_words("text")}, 1, {PAIR_LEN - 2}) AS toks
      FROM named JOIN stripped e ON e.id = {of}))
  LEFT JOIN vocab USING (tok) GROUP BY pair_id)"""


@query(
    "pair_tokens",
    f"""WITH {SQL_ESSAYS}, {SQL_PAIRS}, {sql_vocab('texts')},
stripped AS (SELECT id, trim(text, {SQL_WHITE}) AS text FROM essays),
named AS (SELECT concat_ws('-', human_id, ai_id) AS pair_id, human_id, ai_id FROM pairs),
{_sql_side("humans", "human_id")}, {_sql_side("ais", "ai_id")}
SELECT pair_id, array_to_string(h.ids, ',') AS input_ids, len(h.ids)::INTEGER AS n,
       array_to_string(a.ids, ',') AS ai_input_ids, len(a.ids)::INTEGER AS ai_n
FROM humans h JOIN ais a USING (pair_id)""",
)
def pair_tokens(spark, sf):
    """Both texts of every pair, tokenized in one pass over the vocabulary."""
    pairs = pair_texts(essays(spark, sf))
    out = K.tokenize_pairs(pairs, vocabulary(corpus(spark, sf)), SP, max_len=PAIR_LEN)
    return out.select(
        "pair_id", _list("input_ids").alias("input_ids"), F.size("attention_mask").alias("n"),
        _list("ai_input_ids").alias("ai_input_ids"), F.size("ai_attention_mask").alias("ai_n"),
    )


@query(
    "truncate_left",
    f"""WITH {SQL_TEXTS}, t AS (SELECT id, {sql_words('text')} AS ids FROM texts)
        SELECT id, array_to_string({SQL_CUT}, ' ') AS tokens FROM t""",
)
def truncate_left(spark, sf):
    cut = T.truncate_tokens(T.words("text"), MAX_LEN, "left")
    return corpus(spark, sf).select("id", F.array_join(cut, " ").alias("tokens"))


@query(
    "truncate_right",
    f"""WITH {SQL_TEXTS}, t AS (SELECT id, {sql_words('text')} AS ids FROM texts)
        SELECT id, array_to_string(list_slice(ids, 1, {MAX_LEN}), ' ') AS tokens FROM t""",
)
def truncate_right(spark, sf):
    cut = T.truncate_tokens(T.words("text"), MAX_LEN, "right")
    return corpus(spark, sf).select("id", F.array_join(cut, " ").alias("tokens"))


@query(
    "input_length",
    f"SELECT doc_id AS id, len({sql_words('text')})::INTEGER AS input_length FROM documents",
)
def input_length(spark, sf):
    return corpus(spark, sf).select("id", T.input_length(T.words("text")).alias("input_length"))


def _sql_padded(side: str) -> str:
    fill = "list_transform(range(padded_length - len(ids)), lambda x: {0})"
    if side == "left":
        ids, mask = f"{fill.format(0)} || ids", f"{fill.format(0)} || list_transform(ids, lambda x: 1)"
    else:
        ids, mask = f"ids || {fill.format(0)}", f"list_transform(ids, lambda x: 1) || {fill.format(0)}"
    return f"""WITH {SQL_BASE}, {sql_batches(42, 'texts')},
planned AS (SELECT e.batch_id, e.slot, c.id, c.ids FROM encoded c JOIN epoch e ON e.id = c.id),
padded AS (
  SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 64.0) * 64)::INTEGER AS padded_length
  FROM planned)
SELECT batch_id, slot, id, padded_length, array_to_string({ids}, ',') AS input_ids,
       array_to_string({mask}, ',') AS attention_mask
FROM padded"""


def _padded(spark, sf, side):
    rows = materialize(encoded(spark, sf), "encoded").drop("attention_mask")
    batches = B.assign_batches(rows.select("id"), BS, 42)
    plan = materialize(K.plan_padding(batches, rows), "plan")
    out = K.pad_batch(B.fetch_rows(plan, rows), SP.pad_id, side)
    return out.select(
        "batch_id", "slot", "id", "padded_length",
        _list("input_ids").alias("input_ids"), _list("attention_mask").alias("attention_mask"),
    )


@query("pad_batch", _sql_padded("left"))
def pad_batch(spark, sf):
    return _padded(spark, sf, "left")


@query("pad_batch_right", _sql_padded("right"))
def pad_batch_right(spark, sf):
    return _padded(spark, sf, "right")


SQL_CHATS = f"""{SQL_ANSWERS},
chats AS (SELECT id, {SQL_SOURCE} || text AS chat, len({sql_words('(' + SQL_SOURCE + ')')}) + 1 AS n_source FROM answers),
{sql_vocab('chats', 'chat')}, {sql_encoded('chats', 'chat')},
whole AS (SELECT c.id, c.n_source, e.ids || [2] AS ids FROM chats c JOIN encoded e ON e.id = c.id)"""


def _supervised(spark, sf, **options):
    a = answers(spark, sf)
    voc = vocabulary(a.select(F.concat(format_source("instruction"), "text").alias("text")))
    out = K.supervised_lists(a, voc, SP, **options)
    return out.select(
        "id", _list("input_ids").alias("input_ids"), _list("labels").alias("labels")
    )


@query(
    "mask_labels",
    f"""WITH {SQL_CHATS}
SELECT id, array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= n_source - 1 THEN -100 ELSE x END), ',') AS labels
FROM whole""",
)
def mask_labels(spark, sf):
    return _supervised(spark, sf)


@query(
    "mask_labels_cut",
    f"""WITH {SQL_CHATS},
labelled AS (
  SELECT *, list_transform(ids, lambda x, i: CASE WHEN i <= n_source - 1 THEN -100 ELSE x END) AS labels FROM whole)
SELECT id, array_to_string(list_slice(ids, greatest(len(ids) - 31, 1), len(ids)), ',') AS input_ids,
       array_to_string(list_slice(labels, greatest(len(ids) - 31, 1), len(ids)), ',') AS labels
FROM labelled""",
)
def mask_labels_cut(spark, sf):
    return _supervised(spark, sf, max_len=32)


@query(
    "mask_labels_compat",
    f"""WITH {SQL_CHATS},
cut AS (SELECT id, n_source, list_slice(ids, greatest(len(ids) - 31, 1), len(ids)) AS ids FROM whole)
SELECT id, array_to_string(ids, ',') AS input_ids,
       array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= n_source - 1 THEN -100 ELSE x END), ',') AS labels
FROM cut""",
)
def mask_labels_compat(spark, sf):
    return _supervised(spark, sf, max_len=32, compat=True)


@query(
    "decode",
    f"""WITH {SQL_TEXTS} SELECT id, trim('<s> ' || array_to_string({sql_words('text')}, ' ')) AS decoded FROM texts""",
)
def decode(spark, sf):
    t = corpus(spark, sf)
    voc = vocabulary(t)
    return K.decode(K.tokenize(t, voc, SP), voc)


@query(
    "preview",
    f"""WITH {SQL_TEXTS}, {sql_batches(42, 'texts')}
SELECT e.slot, t.id, len({sql_words('t.text')})::INTEGER + 1 AS input_length,
       trim('<s> ' || array_to_string({sql_words('t.text')}, ' ')) AS decoded
FROM epoch e JOIN texts t ON t.id = e.id WHERE e.batch_id = 0 AND e.slot < 8""",
)
def preview(spark, sf):
    t = texts(spark, sf)
    voc = vocabulary(corpus(spark, sf))
    batches = B.assign_batches(t.select("id"), BS, 42)
    first = B.fetch_rows(batches.where(F.col("batch_id") == 0), t)
    tokens = B.fetch_rows(first.select("id", "slot"), K.tokenize(first, voc, SP))
    return K.preview(tokens, voc, 8).select("slot", "id", "input_length", "decoded")


@query(
    "mask_augment",
    f"""WITH {SQL_BASE},
each AS (SELECT id, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM encoded)
SELECT id, string_agg((CASE WHEN x > 2 AND substr(md5(concat_ws(':', '9', id, i // 5)), (i % 5) * 6 + 1, 6) < '{round(0.15 * (1 << 24)):06x}' THEN 0 ELSE x END)::VARCHAR,
                      ',' ORDER BY i) AS input_ids
FROM each GROUP BY 1""",
)
def mask_augment(spark, sf):
    out = T.mask_augment("input_ids", 0.15, SP.pad_id, SP.ids, 9, F.col("id"))
    return encoded(spark, sf).withColumn("input_ids", out).select(
        "id", _list("input_ids").alias("input_ids")
    )
