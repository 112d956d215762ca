"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelforge.llm import collocations


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(docs, least=10, within=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, g in f.items():
        rows, gone = [], set()
        for p, a in g.items():
            if len(p) == 3 and a >= least:
                gone |= {q for q in (p[:2], p[1:]) if 100 * a >= within * g[q]}
        for p, a in g.items():
            if len(p) > 1 and a >= least and p not in gone:
                score, k = min((1_000_000 * a * a // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def got(df, **kw):
    rows = collocations.ranked(collocations.collocations(df, **kw), kw.get("top", 2000))
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows.collect())


def made(seed, n=60):
    r = random.Random(seed)
    words = ["New", "york", "city", "ÉTÉ", "été", "a", "b", "c", "naïve", "x y", "日本", "the"]
    docs = [(r.choice(["en", "de", None]), "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(r.randrange(80)))) for _ in range(n)]
    docs += [("en", "hot pair of " * 400), ("en", "hot pair"), ("und", "a b c"), ("fr", ""), ("fr", None), (None, None), ("en", "hot pair of " * 400)]
    return docs


@pytest.mark.parametrize("budget, chunk", [(1 << 19, 1 << 20), (7, 50), (40, 300)])
def test_every_phrase(spark, monkeypatch, budget, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    docs = made(budget)
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, text string, h int, a string, n int").repartition(4)
    assert got(df, budget=budget) == counted(docs)


def test_edges(spark, rows, empty):
    few = spark.createDataFrame([("en", "one two " * 9)], "lang string, text string")
    assert got(few) == [] and got(few.filter("false")) == [] and counted([("en", "one two " * 9)]) == []
    long = [("en", " ".join(f"w{i * i % 7}" for i in range(30_000)))]
    assert got(spark.createDataFrame(long, "lang string, text string")) == counted(long)


def test_groups_hold_about_the_budget():
    totals = np.random.default_rng(3).pareto(1.0, 5000).astype(np.int64) * 10
    base, parts = collocations._groups(totals, 1000)
    held = Counter()
    for t, b, p in zip(totals.tolist(), base.tolist(), parts.tolist()):
        for i in range(p):
            held[b + i] += t / p
    assert max(held.values()) <= 2000 and len(held) <= 2 * totals.sum() / 1000 + 2
    heavy = parts > 1
    assert len({b + i for b, p in zip(base[heavy], parts[heavy]) for i in range(p)} & set(base[~heavy])) == 0
