"""A bitmap of fixed size over 64-bit hashes, to keep most rows out of a join.

It has WORDS rows of 64 bits at most, whatever it is made from, so it is broadcast. Its answer is "perhaps" or
"certainly not": an exact join has to follow. When it fills up, more rows go on to that join; nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WORDS = 1 << 18


def perhaps_in(df: DataFrame, members: DataFrame, hashed: str, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false where the hash in column ``hashed`` is certainly not in that of ``members``."""
    word = F.pmod(F.col(hashed), F.lit(WORDS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(`{hashed}`, 18), 64L) as int))")
    words = members.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = df.withColumn("_at", word).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return met.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_at", "_word", "_bits")
