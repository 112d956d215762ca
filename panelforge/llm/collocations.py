"""Phrase collocations from depth-truncated suffix subtrees, partitioned vertically as in ERA (Mansour et al., 2011).

The suffixes of all pieces of text, cut off after three words, form one tree per language. It is partitioned
by prefix: words are counted first; the counts, summed in a fixed number of cells by hash, say how many suffixes
start in each cell. Cells are put together into groups of about a memory budget, and a cell beyond the budget is
divided by what follows its first word. Each group's subtree is built on its own, as a sorted array of suffixes:
equal suffixes are its leaves, and the count of a phrase is the total of the leaves below its node. In a divided
cell the totals of two words are parts, which are added up after.

A suffix ends before a word that is too rare for any phrase with it to be a candidate, as ERA stops reading where
nothing branches any more. Equal suffixes are added up in each task before they are shuffled. Words are 64-bit hashes
of word and language until the phrases are put out; two words of one hash would be one, about 2 ** -64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from panelforge.session import stored

from .jaccard_join import mixed
from .lookup import looked_up
from .registry import query, table
from .texts import slices

LEAST, TOP, WITHIN = 10, 2000, 50
CELLS = 1 << 18
BUDGET = 1 << 18
CHUNK = 1 << 18
SLICE_BYTES = 1 << 20
NONE = np.uint64(0)  # no word: a hash of 0 is put up to 1
#: Classes of bytes: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(codes of all words in order, the words by code, piece of each word, text of each word), A-Z in lower case."""
    texts = pa.concat_arrays([pc.ascii_lower(texts).cast(pa.large_binary())])
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] == 0) != (kind[:-1] == 0)
    cut[bounds] = True
    cuts = np.flatnonzero(cut)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    at = np.flatnonzero(kind[cuts[:-1]] == 0)
    coded = runs.take(pa.array(at)).dictionary_encode()
    start = cuts[at]
    text = np.searchsorted(bounds, start, side="right") - 1
    piece = np.concatenate([[0], np.cumsum(kind == 2)])[start] + text  # a text's end parts as well
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), piece, text


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _hashes(codes: np.ndarray, words: list[bytes], langs: np.ndarray) -> np.ndarray:
    own = np.array([_hash(w) for w in words], np.uint64)[codes] if words else np.zeros(0, np.uint64)
    return np.maximum(mixed(own ^ langs), np.uint64(1))


def _lang_hashes(names: list[str]) -> np.ndarray:
    return mixed(np.array([_hash(b"lang " + n.encode()) for n in names], np.uint64))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, word, c) of the words of each slice."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        seen = sorted(set(names))
        which = np.array([seen.index(n) for n in names], np.int64)
        done = 0
        for part in slices(batch.column("text"), SLICE_BYTES):
            codes, words, _, text = _words(part)
            lang = which[done + text]
            done += len(part)
            if not len(codes):
                continue
            both, counts = np.unique(lang * len(words) + codes, return_counts=True)
            lang, code = both // len(words), both % len(words)
            h = _hashes(code, words, _lang_hashes(seen)[lang])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(seen).take(pa.array(lang)), pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(code)), pa.array(counts.astype(np.int64))],
                ["h", "lang", "word", "c"])
    pa.default_memory_pool().release_unused()  # the worker stays, for other tasks


def _groups(totals: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell, from the suffixes that start in it."""
    parts = np.maximum(1, -(-totals // budget))
    light = np.where(parts == 1, totals, 0)
    base = (np.cumsum(light) - light) // budget
    heavy = parts > 1
    base[heavy] = base.max(initial=0) + 1 + (np.cumsum(parts[heavy]) - parts[heavy])
    return base.astype(np.int64), parts.astype(np.int64)


BLOCKS = "grp bigint, divided boolean, dictionary binary, codes binary, counts binary"


def _suffixes(plan):
    """Blocks of equal suffixes added up, one per group and chunk."""

    def added(a, b, c) -> pa.RecordBatch:
        base, parts, _ = plan.value
        cell = (a % np.uint64(CELLS)).astype(np.int64)
        n = parts[cell]
        group = base[cell] + np.where(n > 1, (mixed(b ^ mixed(c)) % n.astype(np.uint64)).astype(np.int64), 0)
        order = np.lexsort((c, b, a, group))
        a, b, c, group, divided = a[order], b[order], c[order], group[order], n[order] > 1
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
        counts = np.diff(np.append(new, len(a))).astype("<u4")
        a, b, c, group, divided = a[new], b[new], c[new], group[new], divided[new]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        rows = []
        for i, j in zip(first, np.append(first[1:], len(group))):
            held, codes = np.unique(np.concatenate([a[i:j], b[i:j], c[i:j]]), return_inverse=True)
            codes = codes.astype("<u2" if len(held) <= 1 << 16 else "<u4")
            rows.append((int(group[i]), bool(divided[i]), held.astype("<u8").tobytes(), codes.tobytes(), counts[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["grp", "divided", "dictionary", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = plan.value[2]
        held, size = [], 0
        for batch in batches:
            own = dict(zip(names := sorted(set(batch.column("lang").to_pylist())), _lang_hashes(names).tolist()))
            langs = np.array([own[n] for n in batch.column("lang").to_pylist()], np.uint64)
            done = 0
            for part in slices(batch.column("text"), SLICE_BYTES):
                codes, words, piece, text = _words(part)
                h = _hashes(codes, words, langs[done + text])
                done += len(part)
                word = h % np.uint64(CELLS)
                h = np.where((frequent[word.astype(np.int64)] >> ((h // np.uint64(CELLS)) % np.uint64(64))) & np.uint64(1), h, NONE)
                h, piece = np.concatenate([h, [NONE, NONE]]), np.concatenate([piece, [-1, -2]])
                a, b, c = h[:-2], np.where(piece[1:-1] == piece[:-2], h[1:-1], NONE), np.where(piece[2:] == piece[:-2], h[2:], NONE)
                keep = (a != NONE) & (b != NONE)
                if keep.any():
                    held.append((a[keep], b[keep], c[keep]))
                    size += int(keep.sum())
                if size >= CHUNK:
                    yield added(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield added(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker stays, for other tasks

    return run


NODES = "a bigint, b bigint, c bigint, n bigint, part boolean"


def _subtree(least: int):
    """Nodes (a, b, c, n) of a group with at least ``least`` suffixes; c is 0 for nodes of two words, which are all put out as parts in a divided cell."""

    def build(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, weights, divided = ([], [], []), [], False
        for batch in blocks:
            for split, held, codes, counts in zip(*[batch.column(x) for x in ("divided", "dictionary", "codes", "counts")]):
                words = np.frombuffer(held.as_buffer(), "<u8")
                code = np.frombuffer(codes.as_buffer(), "<u2" if len(words) <= 1 << 16 else "<u4").reshape(3, -1)
                for col, x in zip(cols, code):
                    col.append(words[x])
                weights.append(np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64))
                divided = divided or split.as_py()
        a, b, c = (np.concatenate(x) for x in cols)
        weight = np.concatenate(weights)
        order = np.lexsort((c, b, a))
        a, b, c, weight = a[order], b[order], c[order], weight[order]
        pair = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        leaf = np.flatnonzero(np.concatenate([[True], pair[1:] | (c[1:] != c[:-1])]))
        total = np.add.reduceat(weight, leaf)
        node = np.flatnonzero(pair[leaf])
        two = np.add.reduceat(total, node)
        at3 = (total >= least) & (c[leaf] != NONE)
        at2 = np.full(len(two), True) if divided else two >= least
        i3, i2 = leaf[at3], leaf[node][at2]
        signed = lambda x: pa.array(np.concatenate(x).view(np.int64))
        n = np.concatenate([total[at3], two[at2]])
        part = np.concatenate([np.zeros(len(i3), bool), np.full(len(i2), divided)])
        yield pa.RecordBatch.from_arrays(
            [signed([a[i3], a[i2]]), signed([b[i3], b[i2]]), signed([c[i3], np.zeros(len(i2), np.uint64)]), pa.array(n), pa.array(part)], ["a", "b", "c", "n", "part"])

    return build


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words, phrases). ``words``: h, lang, word, f for every word; ``phrases``: a, b, c, n for the phrases of two words
    (c is 0) and three words with at least ``least`` occurrences, as hashes of their words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words = stored(rows.mapInArrow(_counter, "h bigint, lang string, word string, c bigint").groupBy("h", "lang", "word").agg(F.sum("c").alias("f")))
    # one row per cell, so of a fixed size: which words are frequent, and how many suffixes start with one
    cell = F.expr(f"cast(((h % {CELLS}) + {CELLS}) % {CELLS} as int)")  # CELLS divides 2 ** 64: the same for the unsigned hash
    bit = F.expr(f"shiftleft(1L, cast(shiftright(h, {CELLS.bit_length() - 1}) & 63L as int))")
    cells = words.filter(F.col("f") >= least).groupBy(cell.alias("cell")).agg(F.bit_or(bit).alias("bits"), F.sum("f").alias("total")).toPandas()
    totals, bits = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    totals[cells["cell"]], bits[cells["cell"]] = cells["total"], cells["bits"]
    plan = docs.sparkSession.sparkContext.broadcast((*_groups(totals, budget), bits.view(np.uint64)))
    nodes = stored(rows.mapInArrow(_suffixes(plan), BLOCKS).groupBy("grp").applyInArrow(_subtree(least), NODES))
    parts = nodes.filter("part").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return words, nodes.filter("not part").select("a", "b", "c", "n").unionByName(parts)


def collocations(docs: DataFrame, least: int = LEAST, within: int = WITHIN, lang: str = "lang", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """All kept collocations: lang, phrase, a (occurrences), l, r (those of the two sides of the cut), n (words of the
    language) and score, floor(1,000,000 a a / (l r)) of the cut with the lowest score, of equal ones the first.

    Texts are in lower case (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at spaces and tabs.
    A phrase of two words is dropped if one of three words that holds it has ``within`` percent of its occurrences or
    more. NULL languages are ``und``; NULL, empty and blank texts have no words; repeated rows count as often as they
    occur; an empty table gives no rows; other columns are left out. ``budget``: suffixes a group should have at
    most; it steers memory, never the result.
    """
    words, phrases = phrase_counts(docs, least, lang, text, budget)
    known = stored(phrases)
    frequent = stored(words.filter(F.col("f") >= least).select("h", "lang", "word", "f"))
    size = known.count()

    def with_word(df, at):
        """``df`` with word and count of the hash in column ``at``; no phrase is without, as each has its words' counts at least."""
        held = df.groupBy(at).agg(F.count(F.lit(1)).alias("held"))
        facts = frequent.join(held, F.col("h") == F.col(at)).select(at, F.col("word").alias(f"{at}_word"), F.col("f").alias(f"{at}_f"), F.col("lang").alias(f"{at}_lang"), "held")
        return looked_up(df, facts, [at], "held", size).drop("held")

    pairs = stored(with_word(with_word(known.filter("c = 0").drop("c"), "a"), "b"))
    three = known.filter("c <> 0")
    left = pairs.select("a", "b", F.col("n").alias("ab_f"), "a_word", "b_word", "a_f", F.col("a_lang").alias("lang"))
    right = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc_f"), F.col("b_word").alias("c_word"), F.col("b_f").alias("c_f"))
    triples = stored(three.join(left, ["a", "b"]).join(right, ["b", "c"]))
    over = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("most"))
    kept = pairs.join(over, ["a", "b"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * within))

    def scored(n, left, right):
        exact = [f"cast({x} as decimal(15,0))" for x in (n, left, right)]  # products stay below 10 ** 38
        return F.expr("cast(1000000 as decimal(7,0)) * ({0} * {0}) div ({1} * {2})".format(*exact))

    two = kept.select(F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_word", "b_word").alias("phrase"), F.col("n").alias("a"), F.col("a_f").alias("l"), F.col("b_f").alias("r"), scored("n", "a_f", "b_f").alias("score"))
    first, second = scored("n", "a_f", "bc_f"), scored("n", "ab_f", "c_f")
    cut = lambda x, y: F.when(first <= second, F.col(x)).otherwise(F.col(y))
    longer = triples.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), F.col("n").alias("a"), cut("a_f", "ab_f").alias("l"), cut("bc_f", "c_f").alias("r"), F.least(first, second).alias("score"))
    of_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return two.unionByName(longer).join(of_lang, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents
), p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, w[i : i + k - 1] AS ph, k FROM p, unnest([1, 2, 3]) AS k(k), unnest(range(1, len(w) - k + 2)) AS i(i)),
f AS (SELECT lang, ph, k, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (
    SELECT c.lang, c.ph, c.f AS a, j, x.f AS l, y.f AS r, 1000000 * c.f * c.f // (x.f * y.f) AS score
    FROM cand c, unnest(range(1, c.k)) AS j(j) JOIN f x ON x.lang = c.lang AND x.ph = c.ph[1 : j] JOIN f y ON y.lang = c.lang AND y.ph = c.ph[j + 1 : c.k]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
gone AS (SELECT s.lang, s.ph FROM cand s JOIN cand t ON s.lang = t.lang AND s.k = 2 AND t.k = 3 AND (t.ph[1:2] = s.ph OR t.ph[2:3] = s.ph) AND 100 * t.f >= 50 * s.f),
kept AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM best ANTI JOIN gone USING (lang, ph))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, a (both descending) and phrase, with their rank."""
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    return found.withColumn("rank", place).filter(F.col("rank") <= top)


@query("op13_collocations", OP13_SQL)
def op13(spark, sf_dir):
    return ranked(collocations(table(spark, sf_dir, "documents")))
