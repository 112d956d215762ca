"""Benchmark decontamination by pigeonhole edit matching.

An item within k edits of a passage leaves one of its k + 1 pieces unharmed in that passage. All pieces are
searched for at once with an Aho-Corasick automaton; around each hit, Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .registry import query, table
from .texts import free_name

RATE = 0.05
MIN_PIECE = 8
BLOCK_CHARS = 1_000_000
HITS = T.ArrayType(T.StructType([
    T.StructField("item", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("errors", T.LongType()),
]))


def normal(text: str) -> str:
    """Lower case, white space in single spaces, none at the ends."""
    return " ".join(text.lower().split())


def normal_places(text: str) -> list[int]:
    """For each character of ``normal(text)``, the place in ``text`` that it comes from."""
    out, gap = [], None
    for i, c in enumerate(text):
        if c.isspace():
            gap = i if out and gap is None else gap
            continue
        if gap is not None:
            out.append(gap)
            gap = None
        out += [i] * len(c.lower())
    return out


def budget(length: int, rate: float = RATE) -> int:
    """Edits allowed for an item of ``length``: a share of it, while every piece keeps MIN_PIECE characters."""
    return max(0, min(int(length * rate), length // MIN_PIECE - 1))


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """``errors`` + 1 spans of nearly equal size."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(eq: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distance of a pattern of ``m`` characters to the best piece of ``text`` that ends at each place;
    ``anchored``: to the whole text up to there."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, first = ones, 0, m, int(anchored)
    for c in text:
        match = eq.get(c, 0)
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up = minus | (~(horizontal | plus) & ones)
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | first, down << 1
        plus = (down | ~(vertical | up)) & ones
        minus = up & vertical & ones
        yield score


def best_match(item: str, text: str, lo: int, hi: int, errors: int) -> tuple[int, int, int] | None:
    """(errors, start, end) of the best match within text[lo:hi], the first to end on ties, if within ``errors``."""
    at = text.find(item, lo, hi)
    if at >= 0:
        return 0, at, at + len(item)
    if not errors:
        return None
    window, m = text[lo:hi], len(item)
    score, end = min(((d, j) for j, d in enumerate(distances(masks(item), m, window))), default=(errors + 1, 0))
    if score > errors:
        return None
    back = window[end::-1] if end >= 0 else ""
    length = next(j + 1 for j, d in enumerate(distances(masks(item[::-1]), m, back, True)) if d == score)
    return score, lo + end + 1 - length, lo + end + 1


class Block:
    """Items and the automaton of their pieces; it is built once in each Python worker task."""

    def __init__(self, items: Sequence[tuple[str, str]], rate: float):
        import ahocorasick

        self.items = [(key, normal(text)) for key, text in items]
        self.errors = [budget(len(t), rate) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for a, b in pieces(len(t), self.errors[i]):
                if b > a:
                    where.setdefault(t[a:b], []).append((i, a))
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for word, places in where.items():
                self.automaton.add_word(word, (len(word), places))
            self.automaton.make_automaton()

    def search(self, text: str | None, first: bool = False) -> list[tuple[str, int, int, int]]:
        """(key, start, end, errors) of the best match of each item, in places of ``normal(text)``; ``first``: any one."""
        if not text or self.automaton is None:
            return []
        text = normal(text)
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, a in places:
                start, k = end + 1 - size - a, self.errors[i]
                lo, hi = max(0, start - k), min(len(text), start + len(self.items[i][1]) + k)
                held = spans.setdefault(i, [])
                if held and lo <= held[-1][1] and held[-1][0] <= hi:
                    held[-1] = min(lo, held[-1][0]), max(hi, held[-1][1])
                else:
                    held.append((lo, hi))
        out = []
        for i, held in sorted(spans.items()):
            key, item = self.items[i]
            found = [m for lo, hi in held if (m := best_match(item, text, lo, hi, self.errors[i]))]
            if found:
                errors, start, end = min(found)
                out.append((key, start, end, errors))
                if first:
                    break
        return out


def _finder(items: Sequence[tuple[str, str]], rate: float):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(items, rate)
        kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64())]))
        for texts in batches:
            out = []
            for value in texts:
                text = value.as_py()
                hits = block.search(text)
                place = normal_places(text) if hits else []
                out.append([{"item": k, "start": place[s], "end": place[e - 1] + 1, "errors": n} for k, s, e, n in hits])
            yield pa.array(out, kind)
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    return arrow_udf(find, HITS).asNondeterministic()


def _tester(items: Sequence[tuple[str, str]], rate: float):
    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(items, rate)
        for texts in batches:
            yield pa.array([bool(block.search(t.as_py(), True)) for t in texts], pa.bool_())
        pa.default_memory_pool().release_unused()

    return arrow_udf(test, T.BooleanType()).asNondeterministic()


def _digest(text):
    return F.sha2(text, 256)


def blocks(items: DataFrame, text: str = "text") -> Iterator[list[tuple[str, str]]]:
    """Different texts of the items with their digests, in blocks of about BLOCK_CHARS characters.

    The benchmark is a query set against all documents: each block is held by the driver and searched for in
    one pass, so a benchmark of any size goes through bounded memory. An item longer than a block is a block.
    """
    body = F.col(f"`{text}`").cast("string")
    one = items.select(body.alias("text")).filter("length(text) > 0").distinct().select(_digest(F.col("text")).alias("item"), "text")
    chars = one.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(chars / BLOCK_CHARS)
    for i in range(n):
        held = one.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == i).collect()
        if held:
            yield [(r["item"], r["text"]) for r in sorted(held)]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` and item that it holds: the keys, start, end, errors of the item's best match.

    Both sides are compared in lower case with single spaces; ``errors`` counts edits (at most ``rate`` of the
    item's length), start and end are code points of the text as it is, end exclusive, the earliest of the
    best. NULL, empty or blank texts on either side match nothing. Repeated documents and repeated items give
    their rows as often as they occur. An empty side gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    named = items.select(F.col(f"`{item}`").alias("item_key"), _digest(F.col(f"`{text}`").cast("string")).alias("item"))
    found = None
    for block in blocks(items, text):
        part = rows.select("key", F.explode(_finder(block, rate)("text")).alias("hit")).select("key", "hit.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.filter(F.lit(False)).select("key", F.explode(F.lit(None).cast(HITS)).alias("hit")).select("key", "hit.*")
    met = found.join(named, "item")
    return met.select(F.col("key").alias(key), F.col("item_key").alias(item), "start", "end", "errors")


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match of any item, columns unchanged."""
    for block in blocks(items, "text"):
        name = free_name(docs, "leaked")
        docs = docs.withColumn(name, _tester(block, rate)(F.col(f"`{text}`").cast("string"))).filter(~F.col(name)).drop(name)
    return docs


@query("op6_decontaminate")
def op6(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
