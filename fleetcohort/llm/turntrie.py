"""Prefix trie of conversations by van Emde Boas recursion, as joins and sums of turn rows.

A trie of height 2h is cut at half depth: the distinct prefixes of length h (cut prefixes) are
named, the upper trie is built from them and, below each, a lower forest from what follows.
All tries of one height are cut in the same pass, upper and lower ones together, so a trie of
height D takes log2(D) passes down. Going up again, what the lower forests hold is grafted onto
the upper tries: the sum of a forest is added to the cut prefix above it and to each of that
prefix's ancestors in its upper trie.

Sequences are rows of (sequence, position), never arrays, so one conversation may hold any
share of all turns. A trie is told by its root: depth ``a`` and the smallest conversation
through it, ``g``. A sequence inside a trie is told by ``a`` and ``seq``, the smallest
conversation that runs along it; equal sequences are merged first, and equal cut prefixes at
every cut, so no pass moves more rows than there are distinct turns. At height 1 a row is a
node and ``seq`` its name. Prefixes are compared by 128 bits: the exclusive or, over their
positions, of two 64-bit hashes of position and turn.

Turns are ordered by number (null first), role and text; a null role or text is empty; rows
that repeat all of these are turns of their own. Rows without a conversation key are left out.
Very long texts and long conversations need no more memory. An empty table gives no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcohort.llm.common import Scratch

#: A word, in the dialect of Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Turns a conversation may inherit at most.
MOST_INHERITED = 3
#: Keys of a group that differ in so many last bits only are joined to text together.
KEY_BITS = 10


def _two_hashes(*parts: str | Column) -> tuple[Column, Column]:
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, place (from 1), t1 and t2 (hashes of role and text) and words of every turn.

    Turns are dealt out by ranges, so that a long conversation spans several partitions. They
    are counted inside a partition; only the conversation that a partition begins with has
    turns before it, so what is carried over is one row a partition at most. Rows that are
    equal in all that orders them are spread by their place in the input.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    dealt = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    t1, t2 = _two_hashes("role", "text")
    narrow = dealt.sortWithinPartitions(*order).select(
        "conv",
        t1.alias("t1"),
        t2.alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            begins = np.flatnonzero(np.concatenate(([conv[0] != last], conv[1:] != conv[:-1])))
            place = np.arange(1, len(conv) + 1) + seen
            lengths = np.diff(np.concatenate((begins, [len(conv)])))
            if len(begins):
                place[begins[0] :] = np.arange(begins[0], len(conv)) + 1 - np.repeat(begins, lengths)
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place), pa.array(np.full(len(conv), part))],
                names=[*batch.schema.names, "place", "part"],
            )

    counted = scratch.put(
        narrow.mapInArrow(number, "conv long, t1 long, t2 long, words long, place long, part long"),
        "turns",
    )
    ends = counted.groupBy("part", "conv").agg(F.max("place").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", "conv", F.sum("n").over(earlier).alias("before")).where("before > 0")
    # One row a partition at most: the conversation it begins with.
    whole = counted.join(F.broadcast(carried), ["part", "conv"], "left")
    return whole.select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "t1", "t2", "words"
    )


def inherited_count(conv: str = "conv") -> Column:
    """Turns that a conversation takes over: crc32 of its decimal number, modulo 4."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv), and their rows (conv, pos, t1, t2, words) after each took over
    the first turns of the one whose key is the multiple of 20 before (towards zero)."""
    base = F.col("conv") - F.col("conv") % 20
    convs = turns.where("place = 1").select(
        "conv", inherited_count().alias("h"), base.alias("base")
    )
    first = turns.where(f"place <= {MOST_INHERITED} AND conv % 20 = 0")
    given = first.select(F.col("conv").alias("base"), "place", "t1", "t2", "words")
    taken = (
        convs.where("h > 0")
        .join(given, "base")
        .where("place <= h")
        .select("conv", F.col("place").alias("pos"), "t1", "t2", "words")
    )
    held = first.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("held"))
    own = (
        turns.withColumns({"h": inherited_count(), "base": base})
        .where("place > h")
        .join(held, "base", "left")
        .select(
            "conv",
            (F.col("place") - F.col("h") + F.least("h", F.coalesce("held", F.lit(0)))).alias("pos"),
            "t1",
            "t2",
            "words",
        )
    )
    return convs.select("conv"), own.unionByName(taken)


def _print_of(rows: DataFrame, *keys: str) -> DataFrame:
    """128-bit print of the rows of each key: two exclusive ors over position and turn."""
    one, two = _two_hashes("pos", "t1", "t2")
    return rows.groupBy(*keys).agg(
        F.bit_xor(one).alias("f1"), F.bit_xor(two).alias("f2"), F.max("pos").alias("top")
    )


def ends_hash(members: DataFrame) -> DataFrame:
    """``seq`` and the SHA-256 of its members' decimal keys, ascending, joined by commas.

    Keys are joined to text in blocks first; a group's blocks then pass one by one through the
    hash, so that no group is ever held in memory.
    """
    block = F.shiftright("conv", KEY_BITS)
    texts = (
        members.groupBy("seq", block.alias("block"))
        .agg(F.array_sort(F.collect_list("conv")).alias("own"))  # 2 ** KEY_BITS at most
        .select("seq", "block", F.array_join(F.col("own").cast("array<string>"), ",").alias("keys"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for own, keys in zip(
                batch.column("seq").to_pylist(), batch.column("keys").to_pylist(), strict=True
            ):
                if own != seq:
                    if state is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = own, hashlib.sha256(keys.encode())
                else:
                    state.update(b"," + keys.encode())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(seq, state.hexdigest())])

    def _pairs(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
            names=["seq", "ends_sha256"],
        )

    dealt = texts.repartition("seq").sortWithinPartitions("seq", "block")
    return dealt.select("seq", "keys").mapInArrow(digest, "seq long, ends_sha256 string")


def _due(rows: DataFrame, tallest: int, height: int) -> DataFrame:
    """Rows of a table of sequences of at most ``tallest`` positions that a cut of tries of this
    height concerns: those that reach half depth. Shorter ones wait for a lower cut, so a row
    takes part in as many cuts as its own sequence is long, whatever the longest one is.
    """
    reach = F.col("length") - F.col("a")
    due = reach * 2 >= height
    return rows.where(due if height == tallest else due & (reach < height))


def _cut(rows: DataFrame, height: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Cut tries of this height at half depth.

    Gives the rows of the tries of half the height, and (a, seq, name, whole): the cut prefix
    that each sequence runs through or is, and whether the sequence fills its trie. The prefixes
    and their names are tables, so that a prefix shared by a large part of all sequences is
    a skewed join between shuffles, which adaptive execution splits.
    """
    middle = F.col("a") + height // 2
    upper, lower = F.col("pos") <= middle, F.col("pos") > middle
    heads = scratch.put(
        _print_of(rows.where(upper), "a", "seq", "g", "n", "ender", "length"), f"heads{height}"
    )
    cuts = scratch.put(
        heads.groupBy("a", "g", "f1", "f2").agg(
            F.min("seq").alias("name"),
            F.sum("n").alias("n_cut"),
            F.max(F.when(F.col("length") <= middle, F.col("ender"))).alias("ender_cut"),
        ),
        f"names{height}",
    )
    named = heads.join(cuts, ["a", "g", "f1", "f2"]).select(
        "a", "seq", "name", "n_cut", "ender_cut", (F.col("length") == F.col("a") + height).alias("whole")
    )
    named = scratch.put(named, f"cuts{height}")
    parts = rows.join(named.drop("whole"), ["a", "seq"]).where(lower | (F.col("seq") == F.col("name")))
    half = parts.select(
        F.when(upper, F.col("a")).otherwise(middle).alias("a"),
        "seq",
        F.when(upper, F.col("g")).otherwise(F.col("name")).alias("g"),
        F.when(upper, F.col("n_cut")).otherwise(F.col("n")).alias("n"),
        F.when(upper, F.col("ender_cut")).otherwise(F.col("ender")).alias("ender"),
        F.when(upper, F.least("length", middle)).otherwise(F.col("length")).alias("length"),
        "pos",
        "t1",
        "t2",
        "words",
    )
    half = scratch.put(half, f"rows{height}")
    scratch.drop(f"heads{height}")
    scratch.drop(f"names{height}")
    return half, named.select("a", "seq", "name", "whole")


def _graft(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """Add the sums of the lower forests, of this height, to the upper tries above them.

    ``paths`` has the node at each position of every sequence that fills an upper trie.
    """
    place = (F.col("depth") - 1) % (2 * height)
    below = nodes.where(place == height)
    forests = below.groupBy(
        (F.col("depth") - 1 - height).alias("a"), F.col("parent").alias("seq")
    ).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    added = (
        paths.join(forests, ["a", "seq"])
        .groupBy(F.col("pos").alias("depth"), F.col("node").alias("conv"))
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    rest = [c for c in nodes.columns if c not in added.columns]
    filled = added.select("*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in rest])
    # A node's own row is the only one with these columns; the sums are added to it.
    upper = (
        nodes.where(place < height)
        .unionByName(filled)
        .groupBy("depth", "conv")
        .agg(
            F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"),
            *[F.max(c).alias(c) for c in rest],
        )
    )
    return upper.unionByName(nodes.where(place >= height))


def _longer_paths(cuts: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """Paths of the sequences that fill a trie of twice this height: that of their cut prefix,
    then that of what follows it."""
    halves = F.array(
        F.struct(F.col("a").alias("from_a"), F.col("name").alias("from_seq")),
        F.struct((F.col("a") + height).alias("from_a"), F.col("seq").alias("from_seq")),
    )
    wanted = cuts.where("whole").select("a", "seq", F.inline(halves))
    known = paths.select(F.col("a").alias("from_a"), F.col("seq").alias("from_seq"), "pos", "node")
    return wanted.join(known, ["from_a", "from_seq"]).select("a", "seq", "pos", "node")


def turn_trie(conversations: DataFrame) -> DataFrame:
    """Per trie node, as whole numbers: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens; and ends_sha256, of the members that end there.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    convs, rows = rebuilt(ordered_turns(conversations, scratch))
    rows = scratch.put(rows, "rebuilt")

    # Equal conversations are one sequence; the smallest stands for them.
    prints = _print_of(rows, "conv")
    prints = scratch.put(
        convs.join(prints, "conv", "left").select(
            "conv",
            F.coalesce("f1", F.lit(0)).alias("f1"),
            F.coalesce("f2", F.lit(0)).alias("f2"),
            F.coalesce("top", F.lit(0)).alias("length"),
        ),
        "prints",
    )
    same = ["f1", "f2", "length"]
    groups = scratch.put(
        prints.groupBy(*same).agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("n")), "groups"
    )
    several = groups.where("n > 1").select(*same, "seq")
    members = prints.join(several, same).select("seq", "conv")
    alone = groups.where("n = 1").select(
        "seq", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends_sha256")
    )
    ends = alone.unionByName(ends_hash(members))
    total = groups.agg(
        F.sum("n").alias("n"), F.min("seq").alias("root"), F.max("length").alias("length")
    ).first()
    if total["n"] is None:
        total = {"n": 0, "root": None, "length": 0}

    # Down: cut at half depth until every trie is one level.
    deep = 1
    while deep < total["length"]:
        deep *= 2
    rows = scratch.put(
        rows.join(groups.where("length > 0").select(F.col("seq").alias("conv"), "n", "length"), "conv").select(
            F.lit(0).cast("long").alias("a"),
            F.col("conv").alias("seq"),
            F.lit(total["root"]).cast("long").alias("g"),
            "n",
            F.col("conv").alias("ender"),
            "length",
            "pos",
            "t1",
            "t2",
            "words",
        ),
        "rows",
    )
    tables, cuts, height = [(rows, deep)], {}, deep
    while height > 1:
        due = reduce(DataFrame.unionByName, [_due(df, tallest, height) for df, tallest in tables])
        rows, cuts[height] = _cut(due, height, scratch)
        height //= 2
        tables.append((rows, height))

    # At height 1 every row is a node.
    own = rows.select(
        F.col("pos").alias("depth"),
        F.col("seq").alias("conv"),
        F.col("g").alias("parent"),
        "n",
        "ender",
        ((F.col("n") - 1) * F.col("words")).alias("saved"),
    )
    children = own.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(
        F.count(F.lit(1)).alias("children")
    )
    # The root has no turn, and may have members that end there.
    rootless = groups.where("length = 0").agg(F.max("seq")).scalar()
    root = spark.range(1 if total["n"] else 0).select(
        F.lit(0).cast("long").alias("depth"),
        F.lit(total["root"]).cast("long").alias("conv"),
        F.lit(None).cast("long").alias("parent"),
        F.lit(total["n"]).cast("long").alias("n"),
        rootless.alias("ender"),
        F.lit(0).cast("long").alias("saved"),
    )
    nodes = scratch.put(
        own.unionByName(root)
        .join(children, ["depth", "conv"], "left")
        .withColumn("children", F.coalesce("children", F.lit(0)))
        .withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long")),
        "nodes1",
    )
    paths = own.select((F.col("depth") - 1).alias("a"), F.col("conv").alias("seq"),
                       F.col("depth").alias("pos"), F.col("conv").alias("node"))

    # Up: graft what the lower forests hold onto the upper tries.
    for height in sorted(cuts):
        half = height // 2
        nodes = scratch.put(_graft(nodes, paths, half), f"nodes{height}")
        scratch.drop(f"nodes{half}")
        if height < deep:
            paths = scratch.put(_longer_paths(cuts[height], paths, half), f"paths{height}")
            scratch.drop(f"paths{half}")
    top = nodes.where("depth = 1").agg(
        F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
    )
    at_root = F.col("depth") == 0
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    done = nodes.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        (F.col("leaves") + F.when(at_root, top.select("leaves").scalar()).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + F.when(at_root, top.select("saved").scalar()).otherwise(0)).alias("saved_tokens"),
        "ender",
    )
    ended = done.join(ends.withColumnRenamed("seq", "ender"), "ender")
    passed = done.where(F.col("ender").isNull()).withColumn("ends_sha256", empty)
    return passed.unionByName(ended).drop("ender")
