"""Conversation trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import prefix_trie
from panelforge.llm.lookup import looked_up

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def walked(paths):
    """Rows of the trie of {conversation: [(role, text), ...]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def listed(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def conversations(seed):
    r = random.Random(seed)
    made = {0: [(r.choice("ua"), f"t{r.randrange(2)}") for _ in range(23)]}
    for c in range(1, 60):
        base = made[r.choice(list(made))]
        cut = r.randrange(len(base) + 1)
        made[c * r.choice([1, 3])] = base[:cut] + [(r.choice("ua"), r.choice(["", "é", "long text", "x"])) for _ in range(r.choice([0, 0, 1, 2, 9]))]
    for c in range(500, 560):  # one path for many: more than one chunk of ids
        made[c] = made[0]
    return made


def frame(spark, paths):
    rows = [(c, i, role, text, "x", 1) for c, turns in paths.items() for i, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, k string, owner int")
    return turns, spark.createDataFrame([(c,) for c in paths], "conv bigint")


@pytest.mark.parametrize("block", [1, 2, 4, 7])
def test_every_node(spark, monkeypatch, small_segments, block):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 8)
    paths = conversations(block)
    turns, ids = frame(spark, paths)
    assert listed(prefix_trie.trie(prefix_trie.in_order(turns), ids, block)) == walked(paths)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, None), (1, 1, "u", "b"), (1, 1, "u", "a"), (1, 1, "u", "a"), (2, 0, "", ""), (None, 0, "u", "lost"), (3, 0, "u", "word " * 40_000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    first = ("", "")
    want = walked({1: [first, ("u", "a"), ("u", "a"), ("u", "b")], 2: [first], 3: [("u", "word " * 40_000)]})
    assert listed(prefix_trie.trie(prefix_trie.in_order(turns))) == want
    none = prefix_trie.in_order(turns.filter("false"))
    assert listed(prefix_trie.trie(none)) == []
    assert listed(prefix_trie.trie(none, spark.createDataFrame([(7,), (8,), (None,)], "conv bigint"))) == walked({7: [], 8: []})


def test_rebuilt_and_its_trie(spark):
    r = random.Random(11)
    own = {c: [(r.choice("ua"), r.choice("xyz") * r.randrange(4)) for _ in range(r.randrange(1, 9))] for c in [*range(-3, 40), *range(100, 130), 205, 206]}
    own[205], own[206] = own[205][:1], own[206][:1]  # no 200: they may lose all turns

    def made(c):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        return own.get(base, [])[:h] + own[c][h:]

    turns, _ = frame(spark, own)
    assert listed(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == walked({c: made(c) for c in own})


def test_looked_up_keeps_every_row(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 2000, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = looked_up(rows, facts, ["k"], "n", 3000)
    assert got.count() == 3000 and got.filter("k = 0 and n <> 2000").count() == 0
