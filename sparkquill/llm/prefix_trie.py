"""Prefix trie of conversations by prefix doubling: every distinct beginning of a conversation is a node.

1. Turns are put in order over all machines at once: a range sort gives every turn its rank and running length in the
   whole table, and a conversation's first turn gives those inside the conversation. No conversation is ever in one task.
2. Equal turns get the same dense number. Blocks of 2, 4, 8, ... turns that start at multiples of their size are named by
   the pair of names of their halves: one round of grouping and joining for each power of two.
3. A beginning of d turns is the beginning of d - 2 ** j turns and a named block, with 2 ** j the lowest bit of d. From
   the highest power down, every round names all beginnings with that lowest bit by such a pair, so a beginning is made
   once, after as many steps as it has bits. Names are dense, from 0 for the empty beginning on.
4. Nodes are groups of equal names. A conversation owns the nodes of which it is the smallest member; these are the lower
   end of its path. So sums over a subtree are sums over the members of its top, of what each of them owns below, and need
   no walk through the tree.

Joins on names and on conversations deal hot keys over tasks; grouping is partial first. The member lists that are hashed
are sorted over all machines, joined to one string a node and range, and those strings stream through one hash a node in
their order: SHA-256 can't be split, but the task that works on a node with very many ends holds one string at a time.

Defined results. Rows with a null conv_id belong to no conversation. Null roles and texts are empty. Turns are ordered by
turn, null first, and turns of equal number by the SHA-256 of their length-prefixed role and text; repeated rows are
turns of their own. Conversations without turns are members of the root. An empty table has no nodes, not even the root.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import lean
from sparkquill.skew import dealt_join, share
from sparkquill.tables import written

#: monotonically_increasing_id(): partition above, row of the partition below.
_BITS = 33


def _part(mid: str = "mid") -> Column:
    return F.shiftright(mid, _BITS)


def _row(mid: str = "mid") -> Column:
    return F.col(mid).bitwiseAND(F.lit((1 << _BITS) - 1))


def _offsets(table: DataFrame, *sums: str) -> tuple[DataFrame, list[int]]:
    """Per partition of a table written with `mid`: rows before it, and what the columns `sums` add up to before it; and the totals.

    A row for each partition of a job, gathered and shared."""
    each = table.groupBy(_part().alias("part")).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).orderBy("part").collect()
    rows, now = [], [0] * (1 + len(sums))
    for r in each:
        rows.append((r["part"], *now))
        now = [a + (b or 0) for a, b in zip(now, r[1:], strict=True)]
    schema = ", ".join(["part long", "rows_before long", *[f"{c}_before long" for c in sums]])
    return table.sparkSession.createDataFrame(rows, schema), now


def named(rows: DataFrame, keys: list[str], by: list[str], first: int = 0, label: str = "names") -> tuple[DataFrame, int]:
    """`rows`, written, with a dense `name` from `first` on for each distinct value of `keys`, and the next free name."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("mid", F.monotonically_increasing_id())
    found = written(found, f"{label}-keys")
    offsets, (distinct, total) = _offsets(found, "n")
    names = found.withColumn("part", _part()).join(F.broadcast(offsets), "part")
    names = names.select(F.struct(*keys).alias("__key"), F.col("n").alias("__n"), (F.lit(first) + F.col("rows_before") + _row()).alias("name"))
    joined = dealt_join(rows.withColumn("__key", F.struct(*keys)), names, "__key", "__n", share(rows, total), by)
    return written(joined.drop("__key", "__n"), label), first + distinct


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, i (from 0), digest, chars, run (code points up to here); conv_id, n, chars."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", "turn", "digest", "tie"]
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "tie").withColumn("mid", F.monotonically_increasing_id()), "sorted")
    offsets, (total, _) = _offsets(rows, "chars")
    inside = Window.partitionBy("part").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", _part()).withColumn("here", F.sum("chars").over(inside)).join(F.broadcast(offsets), "part")
    rows = rows.select("conv_id", "digest", "chars", (F.col("rows_before") + _row()).alias("rank"), (F.col("chars_before") + F.col("here")).alias("run"))
    rows = written(rows, "ranked")
    whole = written(rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"), F.min("rank").alias("rank0"), F.min(F.col("run") - F.col("chars")).alias("run0")), "conversations")
    rows = dealt_join(rows, whole.drop("all_chars"), "conv_id", "n", share(rows, total), ["rank"])
    turns = rows.select("conv_id", (F.col("rank") - F.col("rank0")).alias("i"), "digest", "chars", (F.col("run") - F.col("run0")).alias("run"))
    return turns, whole.select("conv_id", "n", "all_chars")


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h = crc32(c) % heads turns of conversation c - c % block, then its own after h.

    (turns, conversations): conv_id, depth (from 1), turn (a dense name), chars, tail (code points from here to the end),
    last; conv_id, n, tail (of the whole). Conversations may have no turn."""
    turns, whole = ordered(conversations)
    turns, _ = named(turns, ["digest"], ["conv_id", "i"], label="named-turns")
    turns = turns.drop("digest").withColumnRenamed("name", "turn")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    # At most heads - 1 turns a conversation, and one at least.
    head = turns.filter(F.col("i") < max(1, heads - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "turn", "chars", "run"))).alias("head"))
    facts = whole.join(head, "conv_id").withColumn("h", h)
    base = head.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    facts = facts.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")
    taken = F.coalesce(F.filter("base_head", lambda x: x["i"] < F.col("h")), F.filter("head", lambda x: F.lit(False)))
    facts = facts.withColumn("taken", taken).withColumn("n_taken", F.size("taken"))
    base_run = F.coalesce(F.try_element_at("taken", F.lit(-1))["run"], F.lit(0))
    own_run = F.when(F.col("h") == 0, 0).when(F.col("n") <= F.col("h"), F.col("all_chars")).otherwise(F.get("head", (F.col("h") - 1).cast("int"))["run"])
    facts = facts.withColumn("run_shift", base_run - own_run).withColumn("shift", F.col("n_taken") - F.col("h"))
    facts = facts.withColumn("length", F.col("n_taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).withColumn("tail", F.col("all_chars") + F.col("run_shift"))
    facts = written(facts.select("conv_id", "n", "length", "tail", "shift", "run_shift", "taken"), "rebuilt-conversations")
    borrowed = facts.select("conv_id", "length", "tail", F.explode("taken").alias("x"))
    borrowed = borrowed.select("conv_id", (F.col("x.i") + 1).alias("depth"), "x.turn", "x.chars", F.col("x.run").alias("run"), "length", "tail")
    own = turns.filter(F.col("i") >= h)
    n = facts.agg(F.sum("n")).first()[0] or 0
    own = dealt_join(own, facts.drop("taken"), "conv_id", "n", share(own, n), ["i"])
    own = own.select("conv_id", (F.col("i") + 1 + F.col("shift")).alias("depth"), "turn", "chars", (F.col("run") + F.col("run_shift")).alias("run"), "length", "tail")
    rows = borrowed.unionByName(own).select("conv_id", "depth", "turn", "chars", (F.col("tail") - F.col("run") + F.col("chars")).alias("tail"), (F.col("depth") == F.col("length")).alias("last"))
    return written(rows, "rebuilt"), facts.select("conv_id", F.col("length").alias("n"), "tail")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, turn) -> (conv_id, depth, name) for depth >= 1: equal names, equal beginnings; names are 1, 2, ..."""
    longest = turns.agg(F.max("depth")).first()[0] or 0
    blocks = [turns.select("conv_id", (F.col("depth") - 1).alias("i"), F.col("turn").alias("name"))]
    for _ in range(1, longest.bit_length()):
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(half(0).alias("a"), half(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
        blocks.append(named(pairs, ["a", "b"], ["conv_id", "i"], label="blocks")[0].select("conv_id", "i", "name"))
    made: DataFrame | None = None
    free = 1
    for j in range(len(blocks) - 1, -1, -1):
        rows = blocks[j].filter("i % 2 = 0").select("conv_id", F.shiftleft("i", j).alias("start"), F.col("name").alias("block"))
        begun = rows.filter("start = 0").withColumn("prefix", F.lit(0).cast("long"))
        if made is not None:
            begun = begun.unionByName(rows.filter("start > 0").join(made.select("conv_id", F.col("depth").alias("start"), F.col("name").alias("prefix")), ["conv_id", "start"]))
        found, free = named(begun, ["prefix", "block"], ["conv_id", "start"], free, "prefixes")
        found = found.select("conv_id", (F.col("start") + F.lit(1 << j)).alias("depth"), "name")
        made = found if made is None else made.unionByName(found)
    assert made is not None
    return made


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (name, part) -> a hash for each name, with one chunk held at a time."""
    name, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hashes, pa.string())], names=["name", "ends_sha256"])

    for batch in batches:
        names, hashes = [], []
        for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids"), strict=True):
            if n == name:
                state.update(b",")
            else:
                if name is not None:
                    names.append(name)
                    hashes.append(state.hexdigest())
                name, state = n, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield row()
    if name is not None:
        names, hashes = [name], [state.hexdigest()]
        yield row()


def ends(rows: DataFrame) -> DataFrame:
    """(name, conv_id) -> name, SHA-256 of its conv_ids in ascending order, joined by commas."""
    spread = rows.repartitionByRange("name", "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = spread.groupBy("name", "part").agg(ids.alias("ids"))
    return chunks.repartition("name").sortWithinPartitions("name", "part").mapInArrow(lean(_hashed), "name long, ends_sha256 string")


def trie(turns: DataFrame, whole: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, depth, turn, chars, tail, last), with the conversations (conv_id, n, tail), as `rebuilt` gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = prefixes(turns).join(turns.select("conv_id", "depth", "chars", "tail", "last"), ["conv_id", "depth"])
    root = whole.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"), "tail", (F.col("n") == 0).alias("last"))
    paths = written(paths.unionByName(root), "paths")
    nodes = paths.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.min_by("tail", "conv_id").alias("own_tail"))
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = written(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # What a conversation owns: its path from the highest node of which it is the smallest member, and a leaf at its end.
    owned = nodes.groupBy("conv_id").agg(F.max("own_tail").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    owned = whole.join(owned, "conv_id", "left").select("conv_id", (F.col("n") + 1).alias("__n"), F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    n_paths = nodes.agg(F.sum("n_convs")).first()[0] or 0
    shared = dealt_join(paths.select("conv_id", "depth", "name", "tail"), owned, "conv_id", "__n", share(paths, n_paths), ["depth"])
    sums = shared.groupBy("name").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("tail") - F.col("owned"), F.lit(0))).alias("saved_tokens"))
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below = dealt_join(nodes.filter("parent IS NOT NULL"), parents, "parent", "__n", share(nodes, n_paths), ["name"])
    every = below.select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children").unionByName(
        nodes.filter("parent IS NULL").select("name", "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children")
    )
    hashes = ends(paths.filter("last").select("name", "conv_id"))
    out = every.join(sums, "name").join(hashes, "name", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def nodes(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations; with heads=1 that of the conversations as they are."""
    turns, whole = rebuilt(conversations, block, heads)
    return trie(turns, whole)
