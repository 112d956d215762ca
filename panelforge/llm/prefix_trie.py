"""Trie of conversation prefixes by fixed-length block hashing.

Conversations are cut into blocks of a few turns, and each block start carries the digest of all turns before
it. Conversations are grouped by these digests first. A group whose members all go on with the same next block,
or that has one member, needs no further look: the turns of its smallest member are its nodes. Only inside
blocks where siblings diverge are turns grouped one by one, by the digest at each turn boundary.

A digest is a pair of running sums of 64-bit hashes of (place, role, text): prefix sums, so a conversation of
any length is digested in segments. Two different prefixes of one length are taken for one only if both sums
agree, about 2 ** -128 for each pair.

Sums over subtrees need no walk over the tree. A conversation owns the nodes whose smallest member it is: all of
its path from some depth on. Let q be the characters of its path above that depth. In the subtree of a node
with n members and c characters above it, the repeated characters are the sum of q over the members other than
the node's owner, less (n - 1) c; and its leaves are the members that own the childless end of their path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelforge.operators.ordered import positions, running, splitters
from panelforge.session import stored

from .lookup import looked_up
from .registry import query, table

BLOCK_TURNS = 4
CHUNK_IDS = 4096
KEY = ["depth", "a", "b"]
NO_SUM = "cast(0 as decimal(30,0))"


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    c = lambda x: F.col(f"`{x}`")
    blank = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    return turns.filter(c(conv).isNotNull()).select(c(conv).cast("bigint").alias("conv"), c(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("body"))


def in_order(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, body): turns numbered from 1 in each conversation by turn (NULL first), role and text.

    A NULL role or text becomes empty. Rows without a conversation are left out; repeated rows are repeated turns.
    """
    rows, order = _turns(turns, conv, turn, role, text), ["turn", "role", "body"]
    return positions(rows, "conv", order, "place", split=splitters(rows, "conv", order)).select("conv", "place", "role", "body")


def _digested(placed: DataFrame) -> DataFrame:
    """Per turn: depth, size of the text, digest a, b at its end, and cum, the characters up to there."""
    hashed = lambda seed: F.xxhash64(F.lit(seed), "place", "role", "body").cast("decimal(20,0)")
    lean = placed.select("conv", F.col("place").alias("depth"), F.length("body").cast("bigint").alias("size"), hashed(1).alias("ha"), hashed(2).alias("hb"))
    names = {"ha": "a", "hb": "b", "size": "cum"}
    summed = running(lean, "conv", ["depth"], list(names), ["sum"], split=splitters(lean, "conv", ["depth"]), names=lambda c, _: names[c])
    wide = "decimal(30,0)"
    return summed.select("conv", "depth", "size", "cum", F.col("a").cast(wide).alias("a"), F.col("b").cast(wide).alias("b"),
                         (F.col("a") - F.col("ha")).cast(wide).alias("up_a"), (F.col("b") - F.col("hb")).cast(wide).alias("up_b"))


def _blocks(turns: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """One row per conversation and block that it reaches: start (k, p, q), its turns, and the digest at its end if it is whole.

    A conversation that ends where a block starts has that block without turns.
    """
    k = F.floor((F.col("depth") - 1) / size)
    each = turns.groupBy("conv", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("depth", "size", "cum", "a", "b", "up_a", "up_b"))).alias("turns"))
    whole = F.size("turns") == size
    last = F.element_at("turns", -1)
    filled = each.select("conv", "k", F.col("turns")[0]["up_a"].alias("p"), F.col("turns")[0]["up_b"].alias("q"), "turns",
                         F.when(whole, F.struct(last["a"].alias("a"), last["b"].alias("b"))).alias("end"))
    none = F.expr("cast(array() as array<struct<depth:bigint,size:bigint,cum:bigint,a:decimal(30,0),b:decimal(30,0),up_a:decimal(30,0),up_b:decimal(30,0)>>)")
    bare = convs.filter(F.col("n_turns") % size == 0).select(
        "conv", (F.col("n_turns") / size).cast("bigint").alias("k"), F.col("a").alias("p"), F.col("b").alias("q"), none.alias("turns"),
        F.lit(None).cast("struct<a:decimal(30,0),b:decimal(30,0)>").alias("end"))
    return filled.unionByName(bare)


def _id_hasher():
    """SHA-256 of the joined chunks of each node; chunks of a node come in order, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        schema = None

        def done(keys, digests):
            columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            schema = batch.schema
            keys, digests = [], []
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)], batch.column(4).to_pylist()):
                if key != now:
                    if state is not None:
                        keys.append(now), digests.append(state.hexdigest())
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(keys, digests)
        if state is not None:
            yield done([now], [state.hexdigest()])

    return run


def _ends(convs: DataFrame) -> DataFrame:
    """Per node where a conversation ends: SHA-256 of their ids, ascending and comma-joined.

    Ids are joined in chunks of bounded size first; a node's chunks are then hashed one after the other.
    """
    at = convs.select(F.col("n_turns").alias("depth"), "a", "b", "conv")
    placed = positions(at, KEY, ["conv"], "place", split=splitters(at, KEY, ["conv"]))
    chunk = F.floor((F.col("place") - 1) / CHUNK_IDS).alias("chunk")
    chunks = placed.groupBy(*KEY, chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.mapInArrow(_id_hasher(), "depth bigint, a decimal(30,0), b decimal(30,0), ends_sha256 string")


def trie(placed: DataFrame, ids: DataFrame | None = None, block: int = BLOCK_TURNS) -> DataFrame:
    """One row per different prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, (n_convs - 1) times the characters of each node's last text) and ends_sha256 (of the
    ids that end there, ascending; of the empty text if none).

    ``placed``: conv, place (1, 2, ... without a gap), role, body, as ``in_order`` gives them. ``ids``: a column conv of
    all conversations, for those without turns, who are members of the root only. The root has depth 0 and no
    parent. Equal conversations are members of the same nodes. No conversations give no rows. ``block`` steers
    how much is grouped at once, never the result. No task holds a conversation, a node's members or its children.
    """
    empty = hashlib.sha256().hexdigest()
    turns = stored(_digested(placed))
    last = F.max(F.struct("depth", "a", "b", "cum")).alias("last")
    having = turns.groupBy("conv").agg(last)
    every = having if ids is None else ids.select("conv").filter("conv is not null").distinct().join(having, "conv", "left")
    convs = stored(every.select("conv", F.coalesce("last.depth", F.lit(0).cast("bigint")).alias("n_turns"), F.coalesce("last.cum", F.lit(0).cast("bigint")).alias("n_chars"),
                                F.coalesce("last.a", F.expr(NO_SUM)).alias("a"), F.coalesce("last.b", F.expr(NO_SUM)).alias("b")))
    blocks = stored(_blocks(turns, convs, block))
    total = blocks.count()

    # groups by block digest; ``unlike``: two members or more, and not all go on with the same whole block
    start = ["k", "p", "q"]
    groups = blocks.groupBy(*start).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("owner"), F.count("end").alias("whole"), F.min("end").alias("lo"), F.max("end").alias("hi"))
    unlike = (F.col("n") > 1) & ~F.coalesce((F.col("whole") == F.col("n")) & (F.col("lo") == F.col("hi")), F.lit(False))
    met = stored(looked_up(blocks, stored(groups.select(*start, "n", "owner", unlike.alias("unlike"))), start, "n", total))
    own = met.filter("not unlike and conv = owner").select("k", "p", "q", "n", F.col("conv").alias("owner"), F.explode("turns").alias("t")).select("k", "p", "q", "n", "owner", "t.*")
    fine = met.filter("unlike").select("conv", F.explode("turns").alias("t")).select("conv", "t.*")
    # what the members of a node share is the same in each of their rows
    shared = [F.min(c).alias(c) for c in ("up_a", "up_b", "size", "cum")]
    split = fine.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("owner"), *shared)
    cols = [*KEY, "up_a", "up_b", "n", "owner", "size", "cum"]
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("owner")).filter("n > 0").select(
        F.lit(0).cast("bigint").alias("depth"), F.expr(f"{NO_SUM} a"), F.expr(f"{NO_SUM} b"), F.lit(None).cast("decimal(30,0)").alias("up_a"),
        F.lit(None).cast("decimal(30,0)").alias("up_b"), "n", "owner", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("cum"))
    nodes = stored(own.select(*cols).unionByName(split.select(*cols)).unionByName(root.select(*cols)))

    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = stored(nodes.filter("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")))
    counted = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    first = counted.groupBy("owner").agg(F.min(F.struct("depth", (F.col("cum") - F.col("size")).alias("before"))).alias("at"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    facts = convs.join(first.withColumnRenamed("owner", "conv"), "conv", "left").select(
        "conv", F.coalesce("at.before", "n_chars").alias("q_chars"), F.coalesce("leaf", F.lit(0)).cast("bigint").alias("leaf"), (F.floor(F.col("n_turns") / block) + 1).alias("held"))
    facts = stored(facts)

    # sums over the members of groups and nodes, for those with two or more
    sums = [F.sum("q_chars").alias("q_sum"), F.sum("leaf").alias("n_leaves"), F.min(F.struct("conv", "q_chars")).alias("mine")]
    shares = stored(looked_up(met.filter("n > 1"), facts, ["conv"], "held", total))
    of_group = shares.filter("not unlike").groupBy(*start).agg(*sums)
    of_node = shares.filter("unlike").select("conv", "q_chars", "leaf", F.explode("turns").alias("t")).select("conv", "q_chars", "leaf", "t.depth", "t.a", "t.b").groupBy(*KEY).agg(*sums)
    of_root = facts.groupBy().agg(*sums).select(F.lit(0).cast("bigint").alias("depth"), F.expr(f"{NO_SUM} a"), F.expr(f"{NO_SUM} b"), "*")
    in_group = own.filter("n > 1").select(*start, *KEY).join(of_group, start).drop(*start)
    summed = in_group.unionByName(of_node).unionByName(of_root.filter("mine is not null"))
    saved = F.col("q_sum") - F.col("mine.q_chars") - (F.col("n") - 1) * (F.col("cum") - F.col("size"))
    told = counted.join(summed, KEY, "left").join(_ends(convs), KEY, "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("depth").alias("d"), "a", "b", "up_a", "up_b", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"), F.coalesce(saved, F.lit(0).cast("bigint")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    told = stored(told)
    parents = told.filter("n_children > 0").select(F.col("depth").alias("over"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held"))
    below = told.filter("depth > 0").withColumn("over", F.col("depth") - 1)
    tied = looked_up(below, parents, ["over", "up_a", "up_b"], "held", told.count())
    top = told.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return tied.select(*out).unionByName(top.select(*out))


def rebuilt(turns: DataFrame, hundred: int = 100, starts: int = 6) -> tuple[DataFrame, DataFrame]:
    """(placed, ids): every conversation c with its first h turns replaced by those of conversation c - c % ``hundred``
    (all if that has fewer, none if it is not there), h = crc32 of c in decimal % ``starts``."""
    first = F.crc32(F.col("conv").cast("string").cast("binary")) % starts
    placed = stored(in_order(turns))
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("held"))
    plan = sizes.select("conv", "held", (F.col("conv") - F.col("conv") % hundred).alias("base"), first.alias("h"))
    has = sizes.select(F.col("conv").alias("base"), F.col("held").alias("base_held"))
    plan = stored(plan.join(has, "base", "left").select("conv", "held", "base", "h", F.least("h", F.coalesce("base_held", F.lit(0))).alias("taken")))
    head = placed.filter((F.col("place") < starts) & (F.col("conv") % hundred == 0)).withColumnRenamed("conv", "base")
    lent = head.join(plan.select("conv", "base", "h"), "base").filter("place <= h").select("conv", "place", "role", "body")
    kept = looked_up(placed.withColumn("h", first).filter("place > h"), plan.select("conv", "held", "taken"), ["conv"], "held", placed.count())
    kept = kept.select("conv", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "role", "body")
    return lent.unionByName(kept), plan.select("conv")


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i] || range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
placed AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, c - c % 100 AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda x, b: xor(crc_of[xor(x & 255, b) + 1], x >> 8)), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM placed), bits
), t AS (
    SELECT i.c, place AS pos, role, body FROM ids i JOIN placed p ON p.c = i.base AND p.place <= h
    UNION ALL
    SELECT i.c, place + 1000000, role, body FROM ids i JOIN placed p ON p.c = i.c AND p.place > h
), n AS (SELECT c, role, body, row_number() OVER (PARTITION BY c ORDER BY pos) AS d FROM t),
path AS (SELECT c, list(struct_pack(role := role, body := body) ORDER BY d) AS turns FROM n GROUP BY c),
seq AS (SELECT ids.c, coalesce(turns, []) AS turns FROM ids LEFT JOIN path USING (c)),
pre AS (SELECT c, u.d AS depth, turns[1 : u.d] AS p, len(turns) = u.d AS at_end FROM seq, unnest(range(0, len(turns) + 1)) AS u(d)),
node AS (
    SELECT p, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(c, ',' ORDER BY c) FILTER (at_end) AS ends,
        CASE WHEN any_value(depth) = 0 THEN 0 ELSE length(p[-1].body) END AS size
    FROM pre GROUP BY p
), kid AS (SELECT p[1 : len(p) - 1] AS up, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
told AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kid ON node.p = kid.up),
sub AS (
    SELECT told.p[1 : u.d] AS top, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS leaves
    FROM told, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT told.conv_id::BIGINT AS conv_id, told.depth::BIGINT AS depth, over.conv_id::BIGINT AS parent_conv_id, told.n_convs::BIGINT AS n_convs, told.n_children::BIGINT AS n_children,
    leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(told.ends, '')) AS ends_sha256
FROM told JOIN sub ON told.p = sub.top LEFT JOIN told AS over ON told.depth > 0 AND over.p = told.p[1 : told.depth - 1]
"""


@query("op11_conversation_trie", OP11_SQL)
def op11(spark, sf_dir):
    placed, ids = rebuilt(table(spark, sf_dir, "conversations"))
    return trie(placed, ids)
