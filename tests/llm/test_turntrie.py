"""The conversation trie against one built turn by turn in plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetcohort.llm import queries, turntrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def brute_force(rows) -> set[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    sequences = {}
    for c, found in own.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        sequences[c] = tuple(own.get(base, [])[:h] + found[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    return {
        (
            min(found),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(found),
            len(children[node]),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, found in members.items()
    }


def built(df) -> list[tuple]:
    return [tuple(r) for r in turntrie.turn_trie(df).select(*COLUMNS).collect()]


def check(spark, rows, df=None):
    found = built(spark.createDataFrame(rows, SCHEMA) if df is None else df)
    assert len(found) == len(set(found))
    assert set(found) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [
        # Null and repeated turns, nulls, empties, ties, repeated rows, a null conversation.
        (20, None, "user", "first"), (20, 1, "user", "b"), (20, 1, "user", "a"), (20, 1, "user", "a"),
        (20, 7, None, None), (21, 0, "user", "first"), (21, 1, "user", "x y z"), (21, 2, "", ""),
        (22, 3, "user", "x y z"), (None, 0, "user", "lost"), (None, None, None, None),
        # No conversation to inherit from; negative keys; a long text.
        (45, 0, "u", "q"), (46, 0, "u", "q"), (47, 0, "u", "q"), (48, 0, "u", "q"),
        (-7, 0, "u", "neg"), (-8, 0, "u", "neg"), (0, 0, "u", "zero"), (0, 1, "u", "one two"),
        (61, 0, "u", "word " * 50_000), (62, 0, "u", "word " * 50_000),
        # The parts of a turn do not run into each other.
        (80, 0, "ab", "c"), (100, 0, "a", "bc"),
    ]
    check(spark, rows)
    extra = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "seq", "a", "g", "n", "pos", "t1", "place", "row", "part", "ender", "depth"):
        extra = extra.withColumn(name, F.lit("clash"))
    check(spark, rows, extra)


def test_large_groups_and_a_long_conversation(spark):
    same = [(c, t, "user", f"turn {t} of all") for c in range(0, 3000) for t in range(3)]
    long = [(5000, t, "user", f"step {t}") for t in range(150)]
    branch = [(5020, t, "user", f"step {t}" if t < 100 else f"other {t}") for t in range(140)]
    check(spark, same + long + branch)


def test_equal_turns_of_one_conversation(spark):
    rows = [(40, 3, "user", "again") for _ in range(60)] + [(60, 3, "user", "again") for _ in range(33)]
    check(spark, rows)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 8, 9])
def test_every_depth(spark, depth):
    rows = [(20 * c, t, "u", f"{(c >> t) & 1} said") for c in range(40) for t in range(1 + c % depth)]
    check(spark, rows)


def test_empty_table(spark):
    assert built(spark.createDataFrame([], SCHEMA)) == []
    assert built(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_partitions_do_not_matter(spark):
    rows = [(c, t, "user", f"text {(c * t) % 5}") for c in range(60) for t in range(c % 7 + 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 5, 33):
        check(spark, rows, df.repartition(n))


def test_query_over_the_test_table(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = queries.op11_turn_trie(spark, small)
    assert sorted(found.columns) == sorted(COLUMNS)
    assert {tuple(r) for r in found.select(*COLUMNS).collect()} == brute_force(rows)
