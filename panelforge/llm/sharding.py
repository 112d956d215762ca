"""Shards by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the number of shards alone: no ring, no table. With one shard
more, a key either stays or moves to the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.operators.ordered import positions, splitters
from panelforge.session import stored

from .registry import query, table

#: Fixed values of the method: multiplier of its generator, and 2 ** 31.
MULTIPLIER, SPAN = 2862933555777941757, 2147483648.0
WORD = "18446744073709551616"  # 2 ** 64


def _unsigned(key: Column) -> Column:
    d = key.cast("decimal(20,0)")
    return F.when(key < 0, d + F.lit(WORD).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def _jumps(state: Column, steps: Column, shards: int) -> Column:
    """Follow the jumps of ``state`` (at, next, seed) for some steps, or until the next lies past the last shard.

    Products of two 64-bit numbers are below 10 ** 38, so a decimal holds them exactly; bigint would overflow.
    """

    def step(s, _):
        seed = ((s["seed"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1).cast("decimal(38,0)") % F.lit(WORD).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(seed / F.lit(8589934592).cast("decimal(10,0)")).cast("bigint")  # seed >> 33
        jump = F.floor((s["next"] + 1).cast("double") * (F.lit(SPAN) / (high + 1).cast("double"))).cast("bigint")
        return F.when(s["next"] >= shards, s).otherwise(F.struct(s["next"].alias("at"), jump.alias("next"), seed.alias("seed")))

    return F.aggregate(steps, state, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a bigint column, read as an unsigned 64-bit key; NULL counts as key 0.

    Nearly all keys need about ln(shards) jumps, so these come first; a key that needs more goes on up to
    the ``shards`` jumps there can be, so the result is exact.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    likely = min(shards, 4 * math.ceil(math.log(shards + 1)) + 4)
    start = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("next"), _unsigned(key).alias("seed"))
    state = _jumps(start, F.sequence(F.lit(1), F.lit(likely)), shards)
    if likely < shards:
        rest = F.when(state["next"] >= shards, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(likely + 1), F.lit(shards)))
        state = _jumps(state, rest, shards)
    return state["at"].cast("int")


def stable_key(col: str, kind: T.DataType) -> Column:
    """A bigint key: whole numbers as they are, all else by its 64-bit hash."""
    c = F.col(f"`{col}`")
    return c.cast("bigint") if isinstance(kind, T.IntegralType) else F.when(c.isNotNull(), F.xxhash64(c))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, size (UTF-8 bytes of the text and 8), text_crc32, shard, grown_shard
    (with one shard more) and slot, the row's place in its shard by key and then size and checksum, from 0.

    A NULL text has size 8 and the checksum of the empty text. NULL keys share a shard; rows with equal keys
    are there too, each with a slot of its own. Shards are cut at splitters while the slots are numbered, so
    none is sorted by one task. An empty table gives no rows; other columns are left out.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    at = stable_key(key, docs.schema[key].dataType)
    narrow = stored(docs.select(
        F.col(f"`{key}`").alias("key"), (F.octet_length(body).cast("bigint") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(at, shards).alias("shard"), jump_shard(at, shards + 1).alias("grown_shard"),
    ))
    order = ["key", "size", "text_crc32"]
    placed = positions(narrow, "shard", order, "slot", split=splitters(narrow, "shard", order))
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"), "grown_shard")


SHARDS = 24
OP1_SQL = f"""
WITH RECURSIVE n AS (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS shards),
jump(doc_id, shards, cur, nxt, seed) AS (
    SELECT DISTINCT doc_id, shards, -1::BIGINT, 0::BIGINT, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + {WORD}::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END) FROM documents, n
    UNION ALL
    SELECT doc_id, shards, nxt, floor((nxt + 1)::DOUBLE * ({SPAN}::DOUBLE / (grown // 8589934592::HUGEINT + 1)::DOUBLE))::BIGINT, grown
    FROM (SELECT *, (seed * {MULTIPLIER}::HUGEINT + 1) % {WORD}::HUGEINT AS grown FROM jump WHERE nxt < shards)
), placed AS (SELECT doc_id, max(cur) FILTER (shards = {SHARDS}) AS shard, max(cur) FILTER (shards = {SHARDS + 1}) AS grown_shard FROM jump WHERE nxt >= shards GROUP BY doc_id),
bits AS (SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([i] || range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
sums AS (
    SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
        xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
            lambda c, b: xor(crc_of[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS text_crc32
    FROM documents, bits
)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot
FROM sums JOIN placed USING (doc_id)
"""


@query("op1_sharding", OP1_SQL)
def op1(spark, sf_dir):
    placed = shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
