"""Chat formatting on tokens.

Each text is encoded by itself, and the marks around it are reserved ids that no text
can encode to, so no text can end a turn or begin another. The formatted string is what
the ids decode to, reserved ids standing for their control strings. There, control
strings that a text holds are escaped by one backslash put before each; whatever
backslashes stood there before stay, so taking one away again gives the text back.

The loss mask of a batch comes from prefix sums: plus one where an assistant's text
begins, minus one where it ends. A turn is formatted on its own, in one pass without a
shuffle; ids of a conversation follow by putting its turns in order.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textprov.llm.arrow import lean
from textprov.operators.prefix import running, step_cells
from textprov.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# How texts are cut before byte pairs are merged, as this vocabulary asks for.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

# Reserved ids and the strings they stand for.
FIRST_ID = 50300
SYSTEM, USER, ASSISTANT, OTHER, NAMED, END = range(FIRST_ID, FIRST_ID + 6)
MARKS = {
    SYSTEM: "### System: ", USER: "### User: ", ASSISTANT: "### Assistant: ",
    OTHER: "### Role: ", NAMED: "\n", END: "\n</turn>\n",
}
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {mark: role for role, mark in ROLES.items()}
CONTROL = re.compile(r"### (?:System|User|Assistant|Role):|</turn>")
ESCAPED = re.compile(r"\\(### (?:System|User|Assistant|Role):|</turn>)")

TURN = "conv_id long, turn long, ids array<int>, loss array<tinyint>, formatted string"
CHUNK = 1 << 16  # ids that a chunk of a conversation starts turns in
LONGEST = 1 << 12  # signs of a run of blanks, or of other signs, that is encoded at once
_RUN = re.compile(rf"\s{{{LONGEST}}}|\S{{{LONGEST}}}")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


_encodings: dict[str, object] = {}


def encoding(vocabulary: bytes):
    """The encoding of a vocabulary file, built once in each worker."""
    import tiktoken

    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _encodings:
        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in vocabulary.splitlines() if line)
        }
        if max(ranks.values()) >= FIRST_ID:
            raise ValueError("the vocabulary reaches into the reserved ids")
        _encodings[name] = tiktoken.Encoding(
            "text", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[name]


def encode(code, text: str) -> list[int]:
    """Ids of a text, in time in proportion to its length.

    A run of more than ``LONGEST`` blanks, or of other signs, is cut every ``LONGEST``: the
    splitting pattern would go through it again and again. Texts without one are not cut.
    """
    cuts = [m.end() for m in _RUN.finditer(text)]
    ids = []
    for lo, hi in zip([0, *cuts], [*cuts, len(text)]):
        ids += code.encode_ordinary(text[lo:hi])
    return ids


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The file's bytes, about a megabyte; they go to the tasks, the file need not be there."""
    with open(path, "rb") as f:
        return f.read()


def format_turns(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``conv_id, turn, ids, loss, formatted`` of every turn.

    ``loss`` marks the ids of an assistant's text. Roles other than system, user and
    assistant are spelled out after a mark of their own.

    Defined results: a null text is empty, a null role is the empty role; a null
    conversation is a conversation, a null turn comes first; rows with the same turn
    stand in the order of a digest of their formatted strings, and equal rows are turns
    of their own; other columns are not looked at; an empty table gives an empty result.
    Texts may be very long; a run of more than ``LONGEST`` blanks or other signs is encoded in pieces.
    """
    sent = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = lean(df).select(
        F.col(conv).cast("long"), F.col(turn).cast("long"),
        F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")),
    )

    def run(batches):
        code = encoding(sent.value)
        for b in batches:
            ids, strings, sizes, begin, end = [], [], [], [], []
            for who, said in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                at = len(ids)
                said = escape(said)
                if who in ROLES:
                    ids.append(ROLES[who])
                    string = MARKS[ROLES[who]]
                else:
                    name = escape(who)
                    ids += [OTHER, *encode(code, name), NAMED]
                    string = MARKS[OTHER] + name + MARKS[NAMED]
                if who == "assistant":
                    begin.append(len(ids))
                ids += encode(code, said)
                if who == "assistant":
                    end.append(len(ids))
                ids.append(END)
                strings.append(string + said + MARKS[END])
                sizes.append(len(ids) - at)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, np.array(begin, np.int64), 1)
            np.add.at(edge, np.array(end, np.int64), -1)
            loss = np.cumsum(edge[:-1]).astype(np.int8)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(loss)), pa.array(strings, pa.string()),
                ],
                names=["conv_id", "turn", "ids", "loss", "formatted"],
            )

    return rows.mapInArrow(run, TURN)


def conversations(turns: DataFrame, limit: int = CHUNK) -> DataFrame:
    """``conv_id, chunk, ids, loss, formatted``: a conversation as one training example.

    It comes in chunks, whole but bounded: a chunk starts turns in ``limit`` ids at most, and
    the last of them may end beyond. Numbers of chunks rise along the conversation; a turn
    of more than ``limit`` ids leaves some out.
    """
    rows = materialize(turns.withColumn("tie", F.xxhash64("formatted")), "turns")
    size = F.size("ids").cast("long")
    placed = running(
        rows, ["turn", "tie"], step_cells(F.col("turn")), {"_before": ("sum", size)}, by=["conv_id"],
        inclusive=False,
    )
    each = F.sort_array(F.collect_list(F.struct("turn", "tie", "formatted", "ids", "loss")))
    chunk = F.floor(F.col("_before") / F.lit(limit)).cast("long")
    whole = placed.groupBy("conv_id", chunk.alias("chunk")).agg(each.alias("turns"))
    return whole.select(
        "conv_id", "chunk",
        F.flatten("turns.ids").alias("ids"), F.flatten("turns.loss").alias("loss"),
        F.array_join("turns.formatted", "").alias("formatted"),
    )


def _segments(ids: np.ndarray, loss: np.ndarray, code):
    """Role, text, text under the mask and formatted length of every turn in some ids."""
    marks = np.flatnonzero(ids >= FIRST_ID)
    role, chars = None, 0
    for at, upto in zip(marks, [*marks[1:], len(ids)]):
        mark = int(ids[at])
        chars += len(MARKS[mark])
        if mark == END:
            yield role, text, under, chars
            role, chars = None, 0
            continue
        text = code.decode(ids[at + 1 : upto].tolist())
        chars += len(text)
        on = loss[at + 1 : upto]
        if on.all():
            under = text
        else:
            under = code.decode(ids[at + 1 : upto][on].tolist()) if on.any() else ""
        if mark == OTHER:
            role = text
        elif mark in NAMES:
            role = NAMES[mark]


def read_back(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of what the ids and masks say, one row for each conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Turns
    of a conversation stream through a task in order and only digests are kept, so a
    conversation may have any number of turns.
    """
    sent = turns.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    ordered = (
        lean(turns).select("conv_id", "turn", F.xxhash64("formatted").alias("tie"), "ids", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "tie")
        .select("conv_id", "ids", "loss")
    )

    class Digest:
        def __init__(self, conv):
            self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
            self.said, self.under = hashlib.sha256(), hashlib.sha256()

        def add(self, ids, loss, code):
            for role, text, under, chars in _segments(ids, loss, code):
                self.turns += 1
                self.chars += chars
                self.said.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                under = unescape(under)
                self.loss += len(under)
                self.under.update(under.encode())

        def row(self):
            return (
                self.conv, self.turns, self.said.hexdigest(), self.loss,
                self.under.hexdigest(), self.chars,
            )

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        code = encoding(sent.value)
        now, done = None, []
        for b in batches:
            ends = b.column(1).offsets.to_numpy()
            ids = b.column(1).values.to_numpy()
            loss = b.column(2).values.to_numpy().astype(bool)
            shift = b.column(2).offsets.to_numpy() - ends  # the two lists may begin apart
            for c, lo, hi, d in zip(b.column(0).to_pylist(), ends, ends[1:], shift):
                i, on = ids[lo:hi], loss[lo + d : hi + d]
                if now is None or now.conv != c:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(c)
                now.add(i, on, code)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(zip(*done), _KINDS)], names=names
                )
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(now.row(), _KINDS)], names=names
            )

    return ordered.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
