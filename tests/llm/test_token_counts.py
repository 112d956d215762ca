"""Prefix counts against the tokenizers library, prefix by prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import token_counts

PARTS = [
    "a", "b", "th", "e", "'", "'s", "'re", "'ll", "1", "-", "--", "é", "é", "́", "İ", "Σ", "ß", " ", "\u0085", "\x1c", "日本",
    "क्षि", "한", "한", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\U0001f600", "‍", "ﬁ", "in", "the", "ing", "Ünï",
    "ͅ", "̈", "o", "oo", "\U00016d63\U00016d67", " ", "  ", "\n", "\t", "　",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(token_counts.vocabulary())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.vocabulary())


def test_every_prefix_of_random_pieces(counter, library):
    r = random.Random(12)
    for _ in range(1500):
        text = "".join(c for c in "".join(r.choice(PARTS) for _ in range(r.randrange(1, 14))) if c not in " \t\n")
        if text:
            assert counter.piece(text) == [library(text[:i]) for i in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "é" * 1500, "the" * 1000 + "'s", "-" * 3000, "한" * 700, "क्षि" * 500])
def test_very_long_words(counter, library, text):
    got = counter.piece(text)
    assert len(got) == len(text)
    assert all(got[i - 1] == library(text[:i]) for i in [*random.Random(1).sample(range(1, len(text)), 40), len(text)])


def test_texts_on_spark(spark, library, rows, empty):
    r = random.Random(5)
    texts = [None, "", " ", "the cat", "<|endoftext|> x<|endoftext|>", "word " * 20_000] + ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "n", 3) for i, t in enumerate(texts)], "doc_id int, text string, steps string, n_tokens int").repartition(3)
    counted = token_counts.prefix_counts(docs)
    asked = counted.withColumn("at_7", token_counts.tokens_at(7)).withColumn("cut_5", token_counts.cut_at(5)).withColumn("cut_all", token_counts.cut_at(F.col("n_tokens")))
    for x in asked.collect():
        text = texts[x["doc_id"]] or ""
        assert (x["n_bytes"], x["n_chars"], x["n_tokens"]) == (len(text.encode()), len(text), library(text))
        assert x["at_7"] == library(text[:7]) and x["cut_all"] == len(text)
        sums = np.cumsum(np.frombuffer(x["steps"], "<i1" if x["width"] == 1 else "<i4"), dtype=np.int64)
        if len(text) < 1000:
            assert sums.tolist() == [library(text[:i]) for i in range(1, len(text) + 1)]
            assert x["cut_5"] == max(i for i in range(len(text) + 1) if library(text[:i]) <= 5)
    assert token_counts.prefix_counts(rows).count() == rows.count() and token_counts.prefix_counts(empty).count() == 0
    none = counted.select(token_counts.tokens_at(F.lit(None)).alias("a"), token_counts.cut_at(-1).alias("b")).distinct().collect()
    assert [tuple(r) for r in none] == [(None, None)]


def test_wide_steps_and_a_full_cache(monkeypatch):
    class Jumping:
        def piece(self, text):
            return [200 * (i % 2) for i in range(len(text))]

        word = piece

    monkeypatch.setattr(token_counts, "CACHE_CHARS", 4)
    import pyarrow as pa

    steps = token_counts.Steps(Jumping())
    for _ in range(3):
        got = list(token_counts._measured(pa.array(["abc  de", "", "x"]), steps))
        assert [(n, m.tolist()) for n, m in got] == [(7, [0, 200, -200, 0, 0, 0, 200]), (0, []), (1, [0])]
