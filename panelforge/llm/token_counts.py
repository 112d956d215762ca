"""Exact token counts of every prefix of a text, by dynamic programming over the prefixes of its words.

Byte pairs merged by rank have this property: the last token of a word's encoding and the encoding of what is
before that token settle each other. So the tokens of a prefix are one token more than those of a shorter prefix,
namely the one whose last token stays apart from the new token. Each place of a word is filled in once from
the places before it, with at most as many looks as the longest token has symbols; nothing is merged. A prefix
that ends inside a word ends a shorter word, whose last symbol carries the mark of word ends; it is one more look
from the same places.

The steps between the counts of neighbouring prefixes are stored beside the text: how many tokens its first n
characters have, or where it has to be cut for a budget, is read from them without encoding again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .registry import query, table
from .texts import slices

LIMIT = 2048
CACHE_CHARS = 4 << 20
CACHE_PREFIXES, CACHE_WORD = 1 << 19, 64
#: Classes of bytes: 1 white space, 2 letters, 3 digits, 4 others, and 0 for those that no cut may touch.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 2
_CLASS[48:58] = 3
_CLASS[[39, 124, *range(128, 256)]] = 0  # apostrophes make contractions, bars special strings; marks join what is before them
_ASCII = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")  # how the library cuts text of these characters that has no apostrophe
#: Characters below this, but for one, are changed by the normalizer one by one.
_SIMPLE, _ODD = "̀", "İ"


def vocabulary() -> str:
    """Where the 49k vocabulary of lower-case words lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Which tokens may stand side by side. A token is its symbols as a string; one at the end of a word has ``mark`` after it."""

    def __init__(self, pairs: list[tuple[str, str]], symbols: list[str], mark: str):
        self.mark = mark
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in pairs}
        if len(self.parts) < len(pairs):
            raise ValueError("a token that two merges make is not supported")
        self.tokens = {*symbols, *self.parts}
        self.longest = max(len(t.removesuffix(mark)) for t in self.tokens)
        #: symbols of all tokens: 1 if they are one inside a word, 2 at its end, 3 both
        self.kinds: dict[str, int] = {}
        for t in self.tokens:
            bare = t.removesuffix(mark)
            self.kinds[bare] = self.kinds.get(bare, 0) | (2 if bare != t else 1)
        self.apart_cache: dict[tuple[str, str], bool] = {}

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The tokens that stand at one end (0 left, 1 right) while ``token`` is made, from the first: (token, rank of the merge that ends it)."""
        out, until = [], len(self.rank)
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the symbols of both gives just these two tokens: no merge over their border comes first.

        Of equal ranks the leftmost pair is merged first, so the left token's own merge goes before one over the
        border, and that before the right token's own.
        """
        held = self.apart_cache.get((left, right))
        if held is None:
            held = self._apart(left, right)
            if len(self.apart_cache) > 1 << 20:
                self.apart_cache.clear()
            self.apart_cache[left, right] = held
        return held

    def _apart(self, left: str, right: str) -> bool:
        a, b = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            border = self.rank.get((x, y))
            if border is not None and border < x_until and border <= y_until:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


class Word:
    """The prefixes of one word: for each the last token and the number of tokens, as far as the word goes on."""

    def __init__(self, merges: Merges):
        self.m, self.text, self.last, self.count = merges, "", [""], [0]

    def _step(self, text: str, end: int, mark: str) -> tuple[str, int]:
        """The last token of the first ``end`` symbols, with ``mark`` after them, and the number of tokens."""
        m = self.m
        for size in range(min(m.longest, end), 0, -1):
            token = text[end - size : end] + mark
            if token in m.tokens and (size == end or (self.last[end - size] and m.apart(self.last[end - size], token))):
                return token, self.count[end - size] + 1
        raise ValueError(f"no token ends at symbol {end}")

    def push(self, symbols: str) -> None:
        self.text += symbols
        for end in range(len(self.last), len(self.text) + 1):
            token, n = self._step(self.text, end, "")
            self.last.append(token), self.count.append(n)

    def ended(self, end: int) -> int:
        """Tokens of the word if it had only its first ``end`` symbols."""
        return self._step(self.text, end, self.m.mark)[1] if end else 0

    def tail(self, end: int) -> Word:
        """A word that goes on from the first ``end`` symbols; it holds only the places that can still matter."""
        other = Word(self.m)
        start = max(0, end - self.m.longest - 1)  # no token reaches back to where it is cut
        other.text, other.last, other.count = self.text[start:end], self.last[start : end + 1], self.count[start : end + 1]
        return other


class Prefixes:
    """Prefixes of words met before, as a trie: words that begin alike share the places of what they have in common."""

    def __init__(self, merges: Merges):
        self.m, self.long = merges, ("", [])
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.last, self.count, self.end_count = [""], [0], [0]

    def counts(self, word: str) -> list[int]:
        """Counts of the first 1, 2, ... symbols of a word, each taken as a whole word."""
        if len(word) > CACHE_WORD:  # not kept, but for the latest
            if word != self.long[0]:
                w = Word(self.m)
                w.push(word)
                self.long = word, [w.ended(i) for i in range(1, len(word) + 1)]
            return self.long[1]
        if len(self.last) > CACHE_PREFIXES:
            self.clear()
        at, path, follow = 0, [0], self.next
        for end, symbol in enumerate(word, 1):
            link = at << 16 | ord(symbol)
            at = follow.get(link)
            if at is None:
                at = follow[link] = self._add(word, end, path)
            path.append(at)
        ends = self.end_count
        return [ends[i] for i in path[1:]]

    def _add(self, word: str, end: int, path: list[int]) -> int:
        kinds, last, count, mark = self.m.kinds, self.last, self.count, self.m.mark
        inside = ended = 0
        for start in range(max(0, end - self.m.longest), end):
            token = word[start:end]
            kind = kinds.get(token)
            if kind is None:
                continue
            before = path[start]
            if kind & 1 and not inside and (not start or self.m.apart(last[before], token)):
                inside = count[before] + 1
                last.append(token)
            if kind & 2 and not ended and (not start or self.m.apart(last[before], token + mark)):
                ended = count[before] + 1
            if inside and ended:
                break
        count.append(inside), self.end_count.append(ended)
        return len(last) - 1


class Counter:
    """Token counts of all prefixes of a piece of text, as the tokenizers library would count each of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        made = {a + b for a, b in pairs}
        mark = model["end_of_word_suffix"]
        if not mark:
            raise ValueError("the vocabulary has no mark of word ends")
        self.merges = Merges(pairs, [t for t in model["vocab"] if t not in made], mark)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.codes = {i: self.cut(chr(i))[0][0] for i in range(128) if self.cut(chr(i))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.word = Prefixes(self.merges).counts

    def whole(self, text: str) -> int:
        """Tokens of a normalized text that holds no special string."""
        return sum(self.word(symbols)[-1] for symbols, _ in self.cut(text))

    def piece(self, text: str) -> list[int]:
        """Counts of the first 1, 2, ... characters of a piece, with its special strings as one token each."""
        found = [(at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0]
        if not found:
            return self.ordinary(text)
        at, _, name = min(found)
        before = self.ordinary(text[: at + len(name) - 1])  # until its last character it is text like any other
        own = (before[at - 1] if at else 0) + 1
        rest = text[at + len(name) :]
        return [*before, own, *(own + n for n in (self.piece(rest) if rest else []))]

    def ordinary(self, text: str) -> list[int]:
        """Counts of the prefixes of a text without special strings.

        The text is cut into clusters: a character that can't be joined to the one before it, and all that can be
        joined to it. The normal form of a run of clusters is that of each, one after the other. A prefix that
        ends inside a cluster goes on from the cluster's beginning with the normal form of what it has of it.
        """
        if not text:
            return []
        simple = max(text) < _SIMPLE and _ODD not in text
        if simple and "'" not in text:
            return self._plain(text)
        starts = list(range(len(text))) if simple else [0, *(i for i in range(1, len(text)) if _begins(text[i]))]
        ends = [*starts[1:], len(text)]
        forms = list(self.normal(text)) if simple else [self.normal(text[a:b]) for a, b in zip(starts, ends)]
        if len(forms) < len(starts):  # white space that the normalizer draws together
            forms = [self.normal(c) for c in text]
        normal = "".join(forms)
        places = np.concatenate([[0], np.cumsum([len(f) for f in forms])]).tolist()
        pieces = [(symbols, a, b) for symbols, (a, b) in self.cut(normal)]
        states, out, k, before = {}, [0] * len(text), 0, 0
        for i, (a, b) in enumerate(zip(starts, ends)):
            here = places[i]  # where the cluster begins in the normal form
            while k < len(pieces) and pieces[k][2] <= here:
                before += self.word(pieces[k][0])[-1]
                k += 1
            for p in range(a + 1, b):  # inside the cluster
                out[p - 1] = self._inside(normal, pieces, k, before, here, self.normal(text[a:p]), states)
            end = places[i + 1]
            n, j = before, k
            while j < len(pieces) and pieces[j][2] <= end:
                n += self.word(pieces[j][0])[-1]
                j += 1
            if j < len(pieces) and pieces[j][1] < end:
                n += self._part(normal, pieces[j], end)
            out[b - 1] = n
        return out

    def _plain(self, text: str) -> list[int]:
        """As ``ordinary``, where each character is normalized by itself and each prefix of a word is one word."""
        if text.isascii():
            pieces = [(w.group().translate(self.codes) if not w.group().isalnum() else w.group(), w.span()) for w in _ASCII.finditer(text.lower())]
        else:
            normal = self.normal(text)
            if len(normal) < len(text):  # white space that the normalizer draws together
                normal = "".join(map(self.normal, text))
            pieces = self.cut(normal)
        out, before = [], 0
        for symbols, (a, b) in pieces:
            if len(out) < a:  # white space
                out += [before] * (a - len(out))
            counts = self.word(symbols)
            if len(symbols) > b - a:  # two symbols for each character past ASCII
                place, kept = -1, []
                for c in normal[a:b]:
                    place += 1 if c < "\x80" else 2
                    kept.append(counts[place])
                counts = kept
            out += [before + n for n in counts] if before else counts
            before = out[-1]
        return out + [before] * (len(text) - len(out))

    def _part(self, normal: str, piece: tuple, end: int) -> int:
        """Tokens of a piece that is cut off at ``end``."""
        symbols, a, b = piece
        part = normal[a:end]
        if part[0] == "'" and b - a <= 3:  # a contraction that is not complete is cut in another way
            return self.whole(part)
        return self.word(symbols)[len(part.encode()) - 1]

    def _inside(self, normal: str, pieces: list, k: int, before: int, here: int, more: str, states: dict) -> int:
        """Tokens of the first ``here`` characters of the normal form, followed by ``more``."""
        open_piece = pieces[k] if k < len(pieces) and pieces[k][1] < here else None
        if open_piece is None and k and pieces[k - 1][2] == here:  # what follows may go on with the piece that just ended
            open_piece = pieces[k - 1]
            before -= self.word(open_piece[0])[-1]
        if open_piece is None:
            return before + self.whole(more)
        symbols, a, _ = open_piece
        if a and normal[a - 1] == "'" and here - a < 2 and ("'", a - 1, a) in pieces[max(0, k - 2) : k]:
            a, before = a - 1, before - self.word("'")[-1]  # with what follows it may be a contraction
        if here - a <= 8:
            return before + self.whole(normal[a:here] + more)
        like = "a" if normal[here - 1].isalpha() else "-"
        (first, (_, cut)), *others = self.cut(like + more)
        if id(open_piece) not in states:
            states.clear()
            states[id(open_piece)] = Word(self.merges)
            states[id(open_piece)].push(symbols)
        word = states[id(open_piece)].tail(len(normal[a:here].encode()))
        word.push(first[1:])
        return before + word.ended(len(word.text)) + sum(self.word(s)[-1] for s, _ in others)


def _begins(c: str) -> bool:
    """Whether a character is never joined to, or moved before, the one before it in normal form C.

    Marks, Hangul letters and the vowel signs of one script that compose without being marks do not begin a cluster.
    """
    return not (
        unicodedata.category(c)[0] == "M" or "ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿" or "\U00016d40" <= c <= "\U00016d7f")


class Steps:
    """Steps between prefix counts of pieces met before, in one flat array."""

    def __init__(self, counter: Counter):
        self.counter = counter
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in ``starts``; new ones are counted and added."""
        counts, ends, at = [], [], self.at
        base = len(at)
        for piece in pieces:
            if piece not in at:
                at[piece] = base + len(ends)
                if piece.isascii() and piece.isalpha():
                    counts += self.counter.word(piece.lower())
                else:
                    counts += [0] * len(piece) if piece[0] in " \t\n\v\f\r" else self.counter.piece(piece)
                ends.append(len(counts))
        if ends:
            steps = np.diff(np.array(counts, np.int32), prepend=0)
            first = np.array([0, *ends[:-1]])
            steps[first] = np.array(counts, np.int32)[first]
            self.starts = np.concatenate([self.starts, len(self.flat) + np.array(ends)])
            self.flat = np.concatenate([self.flat, steps])
        return np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))


PREFIXES = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("width", T.IntegerType()), T.StructField("steps", T.BinaryType()),
])


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces whose counts add up, and for each text the number of its first one (one entry more).

    Texts are cut beside white space, and between letters, digits and others where the library always cuts.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    kind = _CLASS[data]
    white = kind == 1
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = ((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) | (white[1:] != white[:-1])
    cut[bounds] = True
    cuts = np.flatnonzero(cut)
    offsets = pa.py_buffer(cuts.astype(np.int64).tobytes())
    pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, offsets, pa.py_buffer(data.tobytes())])
    return pieces, np.searchsorted(cuts, bounds)


def _measured(texts: pa.Array, steps: Steps) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, steps) of each text."""
    pieces, firsts = _pieces(texts)
    coded = pieces.dictionary_encode() if len(pieces) else None
    if coded is None:
        yield from ((0, np.zeros(0, np.int32)) for _ in range(len(texts)))
        return
    if len(steps.flat) > CACHE_CHARS:
        steps.clear()
    each = steps.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    starts = steps.starts[each]
    sizes = steps.starts[each + 1] - starts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flat = steps.flat[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
    widths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        yield int(widths[i]), flat[ends[firsts[i]] : ends[firsts[i + 1]]]


_HELD: dict[str, Steps] = {}


def _prefix_counter(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _HELD:  # a worker that is used again keeps what it knows
            _HELD[path] = Steps(Counter(path))
        steps = _HELD[path]
        for texts in batches:
            cols = [], [], [], [], []
            for part in slices(pc.fill_null(texts, "")):
                for n_bytes, moves in _measured(part, steps):
                    small = not len(moves) or (-128 <= moves.min() and moves.max() <= 127)
                    kind = "<i1" if small else "<i4"
                    row = n_bytes, len(moves), int(moves.sum()), 1 if small else 4, moves.astype(kind).tobytes()
                    for col, v in zip(cols, row):
                        col.append(v)
            types = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.name for f in PREFIXES])

    return arrow_udf(run, PREFIXES).asNondeterministic()


def prefix_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the key, n_bytes (UTF-8), n_chars, n_tokens, and steps: for each character how many
    tokens the prefix that ends with it has more than the one before, as little-endian signed numbers of ``width`` bytes.

    Counts are those of the tokenizers library for each prefix as a text of its own, without added tokens; special
    strings inside a text are one token. A step may be below zero, as a longer word can have fewer tokens. NULL
    counts as the empty text, which has no tokens and no steps. Repeated rows are counted each; an empty table
    gives no rows; other columns are left out. ``tokenizer``: a byte-level BPE file with marks of word ends.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.withColumn("x", _prefix_counter(tokenizer or vocabulary())("text")).select(F.col("key").alias(key), "x.*")


def _sums(steps: pa.Array, widths: pa.Array) -> Iterator[np.ndarray]:
    """Counts of the prefixes of 0, 1, 2, ... characters of each row."""
    for s, w in zip(steps, widths.to_pylist()):
        moves = np.frombuffer(s.as_buffer(), "<i1" if w == 1 else "<i4") if s.is_valid else np.zeros(0, np.int8)
        yield np.concatenate([[0], np.cumsum(moves, dtype=np.int64)])


@arrow_udf(T.LongType())
def _at(steps: pa.Array, widths: pa.Array, chars: pa.Array) -> pa.Array:
    return pa.array([None if n is None else int(c[min(max(n, 0), len(c) - 1)]) for c, n in zip(_sums(steps, widths), chars.to_pylist())], pa.int64())


@arrow_udf(T.LongType())
def _cut(steps: pa.Array, widths: pa.Array, budgets: pa.Array) -> pa.Array:
    return pa.array([None if n is None or n < 0 else int(np.flatnonzero(c <= n)[-1]) for c, n in zip(_sums(steps, widths), budgets.to_pylist())], pa.int64())


def tokens_at(chars: Column | int) -> Column:
    """Over rows of ``prefix_counts``: tokens of the first ``chars`` characters; of all, if there are fewer. NULL gives NULL."""
    return _at(F.col("steps"), F.col("width"), F.lit(chars).cast("bigint"))


def cut_at(budget: Column | int) -> Column:
    """Over rows of ``prefix_counts``: characters of the longest prefix of at most ``budget`` tokens; NULL for NULL or less than 0."""
    return _cut(F.col("steps"), F.col("width"), F.lit(budget).cast("bigint"))


@query("op12_token_counts")
def op12(spark, sf_dir):
    return prefix_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
