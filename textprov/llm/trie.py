"""A prefix trie of conversations, built by peeling off last turns.

A node is a distinct sequence of first turns. Peeling starts at the greatest depth: the
conversations that end there are its nodes. Then the last turn of every node is stripped,
what is left is grouped together with the conversations that end one turn earlier, and each
group is a node of that depth, whose sums come from the groups below it. So nodes are
found and summed up in the same pass, down to the root.

A prefix is known by two 64-bit digests, each the exclusive or of its turns' digests, which
hold their places. Depths are peeled in bands. Prefixes as long as a band's lowest depth
are spread over the tasks, and each task peels all depths of its prefixes; where one such
prefix has more than ``GROUP`` turns above it, the band is halved, down to bands of a single
depth, which are one aggregation with partial sums. No prefix, however many
conversations share it, is collected in one task, and equal conversations are one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textprov.operators.prefix import number_rows, step_cells
from textprov.session import materialize

GROUP = 1 << 13  # turns that one task peels together, for each prefix
SEGMENT = 1 << 12  # turns of a conversation that are one row
CHUNK = 1 << 16  # ids that are one piece of a digest's input
NOBODY = hashlib.sha256(b"").hexdigest()

PATH = "a array<long>, b array<long>, chars array<long>"
NODES = (
    "depth long, k1 long, k2 long, up1 long, up2 long, conv long, parent long, n long, "
    f"children long, leaves long, saved long, ends string, {PATH}"
)


def numbered_turns(talk: DataFrame) -> DataFrame:
    """``conv, pos, a, b, chars``: each turn's place from 1, two digests of it, its code points.

    Turns stand by ``turn``, null first, then by role and a digest of the text.
    """
    said = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = talk.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), F.md5(said).alias("digest"),
        F.xxhash64(role, said).alias("a"), F.xxhash64(F.lit(1), said, role).alias("b"),
        F.length(said).cast("long").alias("chars"),
    )
    turns = materialize(turns, "turns")
    numbered = number_rows(
        turns, order=["turn", "role", "digest"], cells=step_cells(F.col("turn")), by=["conv"], name="pos"
    )
    return numbered.select("conv", (F.col("pos") + 1).alias("pos"), "a", "b", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first one of their block, and their lengths.

    Conversation ``c`` gets the first ``h`` turns of conversation ``c - c % block``, then its
    own turns after its first ``h``; ``h`` is the CRC-32 of the decimal ``c`` modulo ``most``.
    """
    turns = materialize(turns, "numbered")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % block
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": head, "base": base})
    bases = convs.where("conv = base").select("base", F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left")
    convs = convs.withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("n", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv", "base", "h", "given", "n"), "convs")
    tails = turns.join(convs.select("conv", "h", "given"), "conv").where("pos > h")
    tails = tails.withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    names = ["conv", "pos", "a", "b", "chars"]
    heads = turns.where((F.col("pos") < most) & (base == F.col("conv"))).withColumnRenamed("conv", "base")
    heads = heads.join(convs.select("conv", "base", "given"), "base").where("pos <= given")
    return tails.select(*names).unionByName(heads.select(*names)), convs.select("conv", "n")


def paths(turns: DataFrame) -> DataFrame:
    """``conv, segment, a, b, chars``: digests of all prefixes, ``SEGMENT`` to a row, and the one before."""
    placed = turns.select(
        "conv", F.expr(f"(pos - 1) div {SEGMENT}").alias("segment"), "pos",
        F.xxhash64("pos", "a").alias("a"), F.xxhash64("pos", "b").alias("b"), "chars",
    )
    rows = placed.groupBy("conv", "segment").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("turns"),
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"),
    )
    before = Window.partitionBy("conv").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv", "segment", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ab"],
        *[F.col(f"turns.{c}").alias(c) for c in ("a", "b", "chars")],
    )

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            offsets = a.offsets.to_numpy()
            out = []
            for side, start in ((a, "a0"), (b, "b0")):
                flat = side.values.to_numpy().copy()
                first = batch.column(start).to_numpy()
                for i in range(len(first)):
                    own = flat[offsets[i] : offsets[i + 1]]
                    np.bitwise_xor.accumulate(own, out=own)
                    own ^= first[i]
                out.append(pa.ListArray.from_arrays(side.offsets, pa.array(flat)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "segment", "a0", "b0")), *out, batch.column("chars")],
                names=["conv", "segment", "a0", "b0", "a", "b", "chars"],
            )

    done = rows.mapInArrow(run, f"conv long, segment long, a0 long, b0 long, {PATH}")
    return done.select(
        "conv", "segment", F.concat(F.array("a0"), "a").alias("a"), F.concat(F.array("b0"), "b").alias("b"),
        F.concat(F.array(F.lit(0).cast("long")), "chars").alias("chars"),
    )


def shared_ends(members: DataFrame) -> DataFrame:
    """``k1, k2, ends``: digest of the ids of each sequence, in order with commas between.

    Ids are sorted and joined in chunks over all tasks; only the chunks of a sequence meet,
    and stream through a running digest.
    """
    def chunks(batches):
        key, ids = None, []

        def made():
            return pa.RecordBatch.from_pylist([
                {"k1": key[0], "k2": key[1], "first": ids[0], "text": ",".join(map(str, ids))}
            ])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv"))):
                if ids and (key != (k1, k2) or len(ids) >= CHUNK):
                    yield made()
                    ids = []
                key = (k1, k2)
                ids.append(conv)
        if ids:
            yield made()

    def digests(batches):
        key, running = None, None
        for batch in batches:
            out = []
            for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
                if key != (k1, k2):
                    if key is not None:
                        out.append({"k1": key[0], "k2": key[1], "ends": running.hexdigest()})
                    key, running = (k1, k2), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends": running.hexdigest()}])

    ordered = members.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    pieces = ordered.mapInArrow(chunks, "k1 long, k2 long, first long, text string")
    met = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return met.mapInArrow(digests, "k1 long, k2 long, ends string")


def ended(paths_: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each distinct conversation: ``depth, k1, k2, conv, n, ends``."""
    last = F.expr(f"(n - 1) div {SEGMENT}")
    rows = paths_.join(lengths.where("n > 0"), "conv").where(F.col("segment") == last).select(
        F.element_at("a", -1).alias("k1"), F.element_at("b", -1).alias("k2"), "conv", F.col("n").alias("depth")
    )
    none = lengths.where("n = 0").select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv", F.col("n").alias("depth")
    )
    rows = materialize(rows.unionByName(none), "ends")
    each = rows.groupBy("k1", "k2", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    each = materialize(each, "distinct")
    several = each.where("n > 1").select("k1", "k2")
    members = materialize(rows.join(several, ["k1", "k2"], "left_semi").select("k1", "k2", "conv"), "members")
    digests = materialize(shared_ends(members), "digests")
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return each.join(digests, ["k1", "k2"], "left").withColumn("ends", F.coalesce("ends", alone))


def peel_rows(low: int, floor: int):
    """A task's part of a band: peel all depths down to ``low + 1``.

    Rows come sorted by ``g1, g2``, the prefix of ``low + 1`` turns, and are taken in whole
    groups. A row's path starts with the prefix of ``floor`` turns.
    """
    def peeled(t: pa.Table) -> pa.RecordBatch:
        cut = lambda c: t.column(c).combine_chunks()
        a = cut("a")
        start = a.offsets.to_numpy().astype(np.int64) - floor  # plus a depth: its place
        flat = {c: cut(c).values.to_numpy() for c in ("a", "b", "chars")}
        given = {c: t.column(c).to_numpy() for c in ("depth", "conv", "n", "children", "leaves", "saved")}
        ends = cut("ends")
        by_depth = np.argsort(given["depth"], kind="stable")
        depths = given["depth"][by_depth]
        sums = ("n", "children", "leaves", "saved")
        live = {c: np.zeros(0, np.int64) for c in ("row", "conv", "ends", *sums)}
        child = np.zeros(0, np.int64)  # number of the node that a live row was, or -1
        out, parents, made, below = [], [], 0, -1
        for d in range(int(depths[-1]), low, -1):
            new = by_depth[np.searchsorted(depths, d) : np.searchsorted(depths, d, side="right")]
            fresh = {c: given[c][new] for c in ("conv", *sums)} | {"row": new}
            fresh["ends"] = np.where(ends.is_null().to_numpy(zero_copy_only=False)[new], -1, new)
            live = {c: np.concatenate([live[c], fresh[c]]) for c in live}
            child = np.concatenate([child, np.full(len(new), -1)])
            at = start[live["row"]] + d
            k1, k2 = flat["a"][at], flat["b"][at]
            order = np.lexsort((k2, k1))
            k1, k2, at = k1[order], k2[order], at[order]
            first = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            node = {c: np.add.reduceat(live[c][order], first) for c in sums}
            node["conv"] = np.minimum.reduceat(live["conv"][order], first)
            node["ends"] = np.maximum.reduceat(live["ends"][order], first)
            node["row"] = live["row"][order][first]
            node["leaves"] = np.where(node["children"] == 0, 1, node["leaves"])
            node["saved"] = node["saved"] + (node["n"] - 1) * flat["chars"][at[first]]
            # What was a node one turn deeper now knows its parent.
            owner = np.empty(len(order), np.int64)
            owner[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
            was = child >= 0
            if below >= 0:
                up = np.empty(was.sum(), np.int64)
                up[child[was] - below] = node["conv"][owner[was]]
                parents.append(up)
            top = at[first] - 1
            out.append({
                "depth": np.full(len(first), d), "k1": k1[first], "k2": k2[first],
                "up1": flat["a"][top], "up2": flat["b"][top], **node,
            })
            below, made = made, made + len(first)
            child = np.arange(below, made)
            live = {c: node[c] for c in ("row", "conv", "n", "leaves", "saved")} | {
                "children": np.ones(len(first), np.int64), "ends": np.full(len(first), -1),
            }
        every = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
        lowest = every["depth"] == low + 1
        parent = np.concatenate([*parents, np.zeros(lowest.sum(), np.int64)])
        found = every["ends"] >= 0
        shown = ends.take(pa.array(np.where(found, every["ends"], 0), mask=~found)).fill_null(NOBODY)
        # Nodes of the lowest depth go on to the next band with what is left of their paths.
        size = np.where(lowest, low - floor + 1, 0)
        spots = np.repeat(start[every["row"]] + floor - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        columns = {c: pa.array(every[c], mask=lowest if c == "parent" else None) for c in (
            "depth", "k1", "k2", "up1", "up2", "conv"
        )}
        columns["parent"] = pa.array(parent, mask=lowest)
        columns |= {c: pa.array(every[c]) for c in sums}
        columns["ends"] = shown
        columns |= {c: pa.ListArray.from_arrays(offsets, pa.array(flat[c][spots])) for c in ("a", "b", "chars")}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches):
        held, turns = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            turns += len(batch.column("a").values)
            if turns < 4 * GROUP:
                continue
            t = pa.Table.from_batches(held)
            last = (t.column("g1")[-1], t.column("g2")[-1])
            g1, g2 = t.column("g1").to_numpy(), t.column("g2").to_numpy()
            same = (g1 == last[0].as_py()) & (g2 == last[1].as_py())
            whole = len(same) - int(same.sum())  # rows are sorted: the last group is at the end
            if whole:
                yield peeled(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                turns = sum(int(b.column("a").value_lengths().to_numpy().sum()) for b in held)
        if held:
            yield peeled(pa.Table.from_batches(held))

    return run


def peel(open_: DataFrame, low: int, high: int, floor: int, made: list[DataFrame], bounds: list[int], group: int) -> DataFrame:
    """Nodes of the depths from ``high`` down to ``low + 1`` go to ``made``; gives the open rows of ``low``.

    ``open_`` has a row for each conversation that ends there and each node of the depth
    above that has lost its last turn.
    """
    prefix = [F.element_at(c, low + 2 - floor).alias(g) for c, g in (("a", "g1"), ("b", "g2"))]
    if high - low > 1:
        work = open_.groupBy(*prefix).agg(F.sum(F.col("depth") - low).alias("turns"))
        if (work.agg(F.max("turns")).head()[0] or 0) > group:
            mid = (low + high) // 2
            upper = open_.where(F.col("depth") > mid)
            rest = peel(upper, mid, high, floor, made, bounds, group)
            rest = materialize(open_.where(F.col("depth") <= mid).unionByName(rest), "open")
            return peel(rest, low, mid, floor, made, bounds, group)
        rows = open_.select("*", *prefix).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
        nodes = rows.mapInArrow(peel_rows(low, floor), NODES)
    else:
        up = [F.element_at(c, low + 1 - floor) for c in ("a", "b")]
        nodes = open_.select(
            "depth", "conv", "n", "children", "leaves", "saved", "ends", *prefix,
            *[u.alias(n) for u, n in zip(up, ("up1", "up2"))],
            F.element_at("chars", low + 2 - floor).alias("last"),
            *[F.slice(c, 1, low + 1 - floor).alias(c) for c in ("a", "b", "chars")],
        )
        nodes = summed(nodes, ["g1", "g2"], "up1", "up2", "last", "a", "b", "chars").select(
            F.lit(high).cast("long").alias("depth"), F.col("g1").alias("k1"), F.col("g2").alias("k2"), "up1", "up2",
            "conv", F.lit(None).cast("long").alias("parent"), "n", "children", "leaves", "saved", "ends",
            "a", "b", "chars",
        )
    nodes = materialize(nodes, "nodes")
    made.append(nodes.drop("a", "b", "chars"))
    bounds.append(low)
    return stripped(nodes.where(F.col("depth") == low + 1))


def stripped(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn, as open rows one depth lower."""
    return nodes.select(
        (F.col("depth") - 1).alias("depth"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved",
        F.lit(None).cast("string").alias("ends"), "a", "b", "chars",
    )


def summed(rows: DataFrame, by: list[str], *first: str) -> DataFrame:
    """Nodes of open rows of one depth; ``last`` is the size of the last turn."""
    groups = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
        *[F.any_value(c).alias(c) for c in first],
    )
    return groups.withColumns({
        "leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")),
        "saved": F.col("saved") + (F.col("n") - 1) * F.col("last"),
        "ends": F.coalesce("ends", F.lit(NOBODY)),
    })


def prefix_trie(turns: DataFrame, lengths: DataFrame, group: int = GROUP) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv, pos, a, b, chars`` with places from 1, and ``lengths`` the ``conv, n`` of
    all conversations, those without turns too. A node is named by the least conversation
    that starts with it; several nodes of one path may have the same name. ``saved_tokens``
    counts the code points that need not be stored again if each node is stored once.

    Defined results: without conversations there is no node; equal turns of equal
    conversations are one node, whatever their number; a conversation's turns may be very
    many and its texts very long, since only digests and sizes are moved.
    """
    every = materialize(paths(turns), "paths")
    ends = materialize(ended(every, lengths), "ended")
    deepest = ends.agg(F.max("depth")).head()[0]
    made: list[DataFrame] = []
    bounds: list[int] = []
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    open_ = None
    for segment in range(((deepest or 0) - 1) // SEGMENT, -1, -1):
        low, high = segment * SEGMENT, min((segment + 1) * SEGMENT, deepest)
        fresh = ends.where((F.col("depth") > low) & (F.col("depth") <= high)).select(
            "depth", "conv", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends"
        )
        rows = fresh if open_ is None else fresh.unionByName(open_.drop("a", "b", "chars"))
        rows = rows.join(every.where(F.col("segment") == segment).drop("segment"), "conv")
        keep = (F.col("depth") - low + 1).cast("int")
        rows = rows.withColumns({c: F.slice(c, F.lit(1), keep) for c in ("a", "b", "chars")})
        rows = materialize(rows.select(
            "depth", "conv", "n", "children", "leaves", "saved", "ends", "a", "b", "chars"
        ), "open")
        open_ = peel(rows, low, high, low, made, bounds, group)
    rows = ends.where("depth = 0").select(
        "depth", "conv", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends",
        none.alias("a"), none.alias("b"), none.alias("chars"),
    )
    rows = rows if open_ is None else rows.unionByName(open_)
    root = summed(rows.select("*", zero.alias("k1"), zero.alias("k2"), zero.alias("last")), ["k1", "k2"], "last")
    root = root.select(
        zero.alias("depth"), "k1", "k2", zero.alias("up1"), zero.alias("up2"), "conv",
        F.lit(None).cast("long").alias("parent"), "n", "children", "leaves", "saved", "ends",
    )
    nodes = materialize(root, "root")
    for part in made:
        nodes = nodes.unionByName(part)
    # Nodes of a band's lowest depth have their parents in another band.
    upper = nodes.where(F.col("depth").isin(bounds)).select(
        F.col("depth").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv").alias("_conv")
    )
    edge = F.col("depth").isin([b + 1 for b in bounds]) & F.col("parent").isNull()
    inner, outer = nodes.where(~edge | F.col("depth").isNull()), nodes.where(edge)
    met = (F.col("depth") - 1 == F.col("_depth")) & (F.col("up1") == F.col("_k1")) & (F.col("up2") == F.col("_k2"))
    outer = outer.join(upper, met).withColumn("parent", F.col("_conv")).drop("_depth", "_k1", "_k2", "_conv")
    return inner.unionByName(outer).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(talk: DataFrame, group: int = GROUP) -> DataFrame:
    """The prefix trie of conversations as they are: see ``prefix_trie``.

    ``talk`` has ``conv_id, turn, role, text``. Turns stand by ``turn``, null first, ties by
    role and a digest of the text; a null role or text is empty; rows without an id belong
    to no conversation and are left out; rows that repeat are turns of their own; other
    columns are not looked at; an empty table gives an empty result.
    """
    turns = materialize(numbered_turns(talk), "numbered")
    return prefix_trie(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), group)


def rebuilt_trie(talk: DataFrame, block: int = 100, most: int = 6, group: int = GROUP) -> DataFrame:
    """The prefix trie of conversations that share their first turns by blocks of ids.

    See ``rebuilt`` for how turns are shared, and ``conversation_trie`` for odd rows. A
    conversation that is left without turns ends at the root.
    """
    turns, lengths = rebuilt(numbered_turns(talk), block, most)
    return prefix_trie(turns, lengths, group)
