"""Vocabulary, encoding and decoding, padding of batches, label masks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textprov.functions import tokens as T
from textprov.functions.draws import draw
from textprov.functions.text import format_source
from textprov.operators.prefix import draw_cell, number_rows
from textprov.operators.skew import salted_join
from textprov.session import lean, materialize

# What a broadcast vocabulary may take in memory, and the longest token of a part of
# it that is broadcast when the whole is larger. An entry takes its bytes (up to 4 per
# character) and about ENTRY_BYTES besides.
BROADCAST_BYTES = 128 << 20
HEAD_CHARS = 32
ENTRY_BYTES = 64


@dataclass(frozen=True)
class Specials:
    """Reserved tokens, in id order from 0. Without a pad token the unknown token
    pads, without that the end token; an empty end token becomes ``</s>``."""

    unk: str | None = "<unk>"
    bos: str | None = "<s>"
    eos: str | None = "</s>"
    pad: str | None = None

    @property
    def names(self) -> list[str]:
        named = [self.unk, self.bos, self.eos if self.eos != "" else "</s>", self.pad]
        return [n for n in named if n is not None]

    def id_of(self, name: str) -> int:
        return self.names.index(name)

    @property
    def eos_name(self) -> str | None:
        return "</s>" if self.eos == "" else self.eos

    @property
    def pad_id(self) -> int:
        for name in (self.pad, self.unk, self.eos_name):
            if name is not None:
                return self.id_of(name)
        raise ValueError("no token can serve as padding")

    @property
    def ids(self) -> list[int]:
        return list(range(len(self.names)))


NO_SPECIALS = Specials(None, None, None, None)


# --- vocabulary ---------------------------------------------------------------


def token_set(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens of the texts: column ``tok``."""
    return df.select(F.explode(T.words(text)).alias("tok")).distinct()


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return (
        df.select(F.explode(T.words(text)).alias("tok"))
        .groupBy("tok")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def build_vocab(df: DataFrame, text: str = "text", specials: Specials = NO_SPECIALS) -> DataFrame:
    """``tok, n, tok_id``: ids by falling count, after the reserved tokens.

    The counts are stored, so the texts are read once. Equal counts, most of the
    vocabulary, are ordered by draw and token, so that they spread over the draw cells.
    """
    spark = df.sparkSession
    stored = materialize(token_counts(df, text), "counts")
    counts = stored.withColumn("_draw", draw("vocab", F.col("tok")))
    numbered = number_rows(
        counts,
        order=[F.col("n").desc(), "_draw", "tok"],
        cells=[-F.col("n"), draw_cell(spark, F.col("_draw"))],
        name="tok_id",
    )
    base = len(specials.names)
    learned = numbered.select("tok", "n", (F.col("tok_id") + base).cast("int").alias("tok_id"))
    if not base:
        return learned
    reserved = spark.createDataFrame(
        [(name, 0, i) for i, name in enumerate(specials.names)], "tok string, n long, tok_id int"
    )
    return reserved.unionByName(learned)


def out_of_corpus(vocab: DataFrame, corpus: DataFrame) -> DataFrame:
    """Vocabulary entries that the corpus tokens (column ``tok``) never use."""
    return vocab.join(corpus.select("tok"), "tok", "left_anti")


def _head_lookup(shared, column: str, key: str):
    """Per Arrow batch: values of every list entry, and the entries not found.

    A look-up hashes the whole vocabulary, so batches are looked up together until they
    hold as many entries as it: the work stays in proportion to the entries.
    """

    def together(batches, entries):
        import pyarrow as pa

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(column).flatten())
            if n >= entries:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def look(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, values = shared.value
        for batch in together(batches, len(keys)):
            lists = batch.column(column)
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=keys)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(sizes, dtype="int64")
            starts = ends - sizes
            offsets = pa.array(np.append(starts, ends[-1:]).astype("int32"))
            miss = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, miss, side="right")
            bounds = pa.array(
                np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype("int32")
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(offsets, pc.take(values, at)),
                    pa.ListArray.from_arrays(bounds, pa.array((miss - starts[row]).astype("int32"))),
                    pa.ListArray.from_arrays(bounds, flat.take(pa.array(miss))),
                ],
                names=[batch.schema.names[0], "_found", "_at", key],
            )

    return look


def _translate(
    df: DataFrame, vocab: DataFrame, column: str, key: str, value: str, id: str, budget: int
) -> DataFrame:
    """``id, _found``: each list's vocabulary values, null for what is not in it.

    The vocabulary is measured. One that fits the budget goes to every task as two
    Arrow arrays and the lists are looked up where they are, without a shuffle. Of a
    larger one the frequent entries go, which cover nearly all tokens; that pass is
    stored, and only the tokens it missed are joined to the rest of the vocabulary,
    salted, since a token in no vocabulary can be frequent too.
    """
    pairs = vocab.select("tok", "tok_id")
    size = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("tok")), F.lit(0)).alias("b")
    ).first()
    whole = size["n"] * ENTRY_BYTES + size["b"] <= budget
    most = budget // (ENTRY_BYTES + 4 * HEAD_CHARS)
    fits = F.lit(True) if whole else (F.col("tok_id") < most) & (F.length("tok") <= HEAD_CHARS)
    head = pairs.where(fits).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        tuple(head[c].combine_chunks() for c in (key, value))
    )
    types = dict(vocab.dtypes)
    looked = lean(df).select(id, column).mapInArrow(
        _head_lookup(shared, column, key),
        f"`{id}` {dict(df.dtypes)[id]}, _found array<{types[value]}>, "
        f"_at array<int>, {key} array<{types[key]}>",
    )
    if whole:
        return looked.select(id, "_found")

    stored = materialize(looked, "lists")
    some = F.size("_at") > 0
    missed = stored.where(some).select(
        id, F.explode(F.arrays_zip("_at", key)).alias("_m")
    ).select(id, "_m.*")
    rest = salted_join(missed, pairs.where(~fits), [key], F.struct(id, "_at"), "left")
    more = rest.groupBy(id).agg(
        F.collect_list(F.struct(F.col("_at").alias("at"), F.col(value).alias("v"))).alias("_more")
    )
    here = F.filter(
        F.transform("_found", lambda v, i: F.struct(i.alias("at"), v.alias("v"))),
        lambda e: e["v"].isNotNull(),
    )
    filled = F.transform(F.array_sort(F.concat(here, "_more")), lambda e: e["v"])
    joined = stored.where(some).join(more, id).select(id, filled.alias("_found"))
    return stored.where(~some).select(id, "_found").unionByName(joined)


def encode(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str,
    specials: Specials,
    id: str = "id",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """``id, input_ids`` for a column of token lists; without an unknown token, tokens
    that are not in the vocabulary are left out."""
    found = _translate(df, vocab, tokens, "tok", "tok_id", id, budget)
    if specials.unk is None:
        ids = F.filter("_found", lambda x: x.isNotNull())
    else:
        ids = F.transform("_found", lambda x: F.coalesce(x, F.lit(specials.id_of(specials.unk))))
    return found.select(id, ids.alias("input_ids"))


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    specials: Specials = Specials(),
    max_len: int | None = None,
    side: str = "left",
    add_bos: bool = True,
    add_eos: bool = False,
    text: str = "text",
    id: str = "id",
) -> DataFrame:
    """``id, input_ids, attention_mask, input_length`` of each text.

    ``vocab`` should be a stored table. The reserved tokens count towards
    ``max_len``; tokens are cut before they are looked up.
    """
    front = [specials.id_of(specials.bos)] if add_bos and specials.bos else []
    back = [specials.id_of(specials.eos_name)] if add_eos and specials.eos_name else []
    toks = T.words(text)
    if max_len is not None:
        toks = T.truncate_tokens(toks, max_len - len(front) - len(back), side)
    ids = encode(df.select(id, toks.alias("_toks")), vocab, "_toks", specials, id)
    parts = [F.array(*[F.lit(i) for i in front])] if front else []
    parts += ["input_ids"]
    parts += [F.array(*[F.lit(i) for i in back])] if back else []
    return ids.withColumn("input_ids", F.concat(*parts)).select(
        id,
        "input_ids",
        F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"),
        T.input_length("input_ids").alias("input_length"),
    )


def tokenize_pairs(
    pairs: DataFrame,
    vocab: DataFrame,
    specials: Specials = Specials(),
    max_len: int | None = None,
    human: str = "human",
    ai: str = "ai",
    id: str = "pair_id",
) -> DataFrame:
    """``id, input_ids, attention_mask, ai_input_ids, ai_attention_mask`` of both texts of each pair.

    Both are cut on the right to ``max_len`` with their begin and end tokens, and looked up
    in one pass over the vocabulary. A null text is empty.
    """
    front = [specials.id_of(specials.bos)] if specials.bos else []
    back = [specials.id_of(specials.eos_name)] if specials.eos_name else []

    def listed(text: str):
        toks = T.words(F.coalesce(F.col(text), F.lit("")))
        return toks if max_len is None else T.truncate_tokens(toks, max_len - len(front) - len(back), "right")

    both = pairs.select(id, listed(human).alias("_human"), listed(ai).alias("_ai"))
    # The size of the first list travels with the id, so that the found ids can be parted.
    tagged = both.select(
        F.struct(F.col(id), F.size("_human").alias("n")).alias("_key"), F.concat("_human", "_ai").alias("_toks")
    )
    found = _translate(tagged, vocab, "_toks", "tok", "tok_id", "_key", BROADCAST_BYTES)

    def side(start, n):
        part = F.slice("_found", start, n)
        if specials.unk is None:
            part = F.filter(part, lambda x: x.isNotNull())
        else:
            part = F.transform(part, lambda x: F.coalesce(x, F.lit(specials.id_of(specials.unk))))
        ends = [F.array(*[F.lit(i) for i in e]) if e else None for e in (front, back)]
        return F.concat(*[p for p in (ends[0], part, ends[1]) if p is not None])

    n = F.col("_key.n")
    ids = found.select(
        F.col(f"_key.{id}").alias(id), side(F.lit(1), n).alias("input_ids"),
        side(n + 1, F.size("_found") - n).alias("ai_input_ids"),
    )
    ones = lambda c: F.array_repeat(F.lit(1), F.size(c))
    return ids.select(
        id, "input_ids", ones("input_ids").alias("attention_mask"),
        "ai_input_ids", ones("ai_input_ids").alias("ai_attention_mask"),
    )


def decode(
    df: DataFrame,
    vocab: DataFrame,
    ids: str = "input_ids",
    id: str = "id",
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """``id, decoded``: the tokens of each id list, joined by blanks."""
    found = _translate(df, vocab, ids, "tok_id", "tok", id, budget)
    return found.select(id, F.array_join("_found", " ").alias("decoded"))


# --- batches of token lists ----------------------------------------------------


def pad_length(
    df: DataFrame, multiple: int = T.PAD_MULTIPLE, batch: str = "batch_id", length: str = "input_length"
) -> DataFrame:
    """``batch_id, padded_length``: the longest list of a batch, rounded up."""
    return df.groupBy(batch).agg(
        T.padded_length(F.max(length), multiple).alias("padded_length")
    )


def plan_padding(
    plan: DataFrame,
    rows: DataFrame,
    multiple: int = T.PAD_MULTIPLE,
    batch: str = "batch_id",
    id: str = "id",
) -> DataFrame:
    """The plan with each batch's ``padded_length``; only ids and lengths move.

    ``rows`` has ``id, input_length``. Lists fetched by this plan are shuffled once.
    """
    lengths = plan.join(rows.select(id, "input_length"), id)
    return plan.join(pad_length(lengths, multiple, batch), batch)


def pad_batch(
    df: DataFrame,
    pad_id: int,
    side: str = "left",
    multiple: int = T.PAD_MULTIPLE,
    batch: str = "batch_id",
    ids: str = "input_ids",
    labels: str | None = None,
) -> DataFrame:
    """Pad the lists of a batch to one length; labels are always padded on the left.

    A plan made by ``plan_padding`` brings the length along, and no row is moved here.
    Otherwise the longest list comes from a narrow aggregate, so the rows are shuffled
    once; store the tokenized table first, with its ``input_length``, to keep it narrow.
    """
    if "padded_length" not in df.columns:
        n = F.col("input_length") if "input_length" in df.columns else F.size(ids)
        df = df.join(pad_length(df.select(batch, n.alias("_n")), multiple, batch, "_n"), batch)
    padded = df.withColumns(
        {
            "attention_mask": T.attention_mask(ids, "padded_length", side),
            ids: T.pad(ids, "padded_length", pad_id, side),
        }
    )
    if labels:
        padded = padded.withColumn(
            labels, T.pad(labels, "padded_length", T.IGNORE_INDEX, "left")
        )
    return padded


def supervised_lists(
    df: DataFrame,
    vocab: DataFrame,
    specials: Specials = Specials(),
    max_len: int | None = None,
    side: str = "left",
    offset: int = 1,
    compat: bool = False,
    instruction: str = "instruction",
    response: str = "text",
    id: str = "id",
) -> DataFrame:
    """``id, input_ids, attention_mask, labels`` of instruction and response texts.

    Labels are the ids with the source (all before the response, less ``offset``)
    ignored; with the usual ``offset`` of one the source's last token is learned too. The mask is set on the whole sequence and cut with it; ``compat`` sets it
    on the cut sequence by the uncut source length, which takes too many labels when
    the cut is on the left.
    """
    source = format_source(instruction)
    parts = df.select(
        id, F.concat(source, F.col(response)).alias("_chat"), T.words(source).alias("_source")
    )
    n_bos = 1 if specials.bos else 0
    sizes = parts.select(id, (F.size("_source") + n_bos - offset).alias("_n_source"))
    whole = tokenize(parts, vocab, specials, add_eos=True, text="_chat", id=id).join(sizes, id)

    def cut(c):
        return c if max_len is None else T.truncate_tokens(c, max_len, side)

    ids = F.col("input_ids")
    labels = (
        T.mask_labels(cut(ids), "_n_source") if compat else cut(T.mask_labels(ids, "_n_source"))
    )
    return whole.select(
        id, cut(ids).alias("input_ids"), cut(F.col("attention_mask")).alias("attention_mask"),
        labels.alias("labels"),
    )


def preview(df: DataFrame, vocab: DataFrame, n: int = 16, slot: str = "slot", id: str = "id") -> DataFrame:
    """The first ``n`` rows of a batch with their decoded text."""
    head = df.orderBy(slot, id).limit(n)
    return head.join(decode(head.select(id, "input_ids"), vocab, id=id), id)
