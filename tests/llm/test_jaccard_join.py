import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import jaccard_join


def brute(docs, near=80, words=5):
    sets = []
    for key, text in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= near * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(sets[i]), (least.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(docs)), key=repr)


def corpus(seed, n=260):
    """Groups of near copies that chain, shared passages, short texts and copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(50)]
    docs = []
    while len(docs) < n:
        base = [word() for _ in range(r.choice([3, 6, 20, 60, 150]))]
        if r.random() < 0.3:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        for _ in range(r.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:
                base = copy
            text = " ".join(copy)
            docs.append((len(docs), text.upper() if r.random() < 0.1 else text))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCS", 60)
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 700)
    docs = corpus(seed)
    got = jaccard_join.groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_every_link_and_count(spark, monkeypatch):
    """No link between different texts is lost, also inside a group, whatever the size of the blocks."""
    docs = corpus(4, 200) + [(1000, None), (1001, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in docs]
    near = {(x, y) for x, s in enumerate(sets) for y, o in enumerate(sets) if x != y and s and 100 * len(s & o) >= 80 * len(s | o)}
    for block in (3, 512):
        monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", block)
        members, links = jaccard_join.links(df)
        own = {k: frozenset(s) for (k, _), s in zip(docs, sets)}
        known = {r["class"]: own[r["doc_id"]] for r in members.collect()}
        got = [tuple(r) for r in links.collect()]
        want = {frozenset((frozenset(sets[x]), frozenset(sets[y]))) for x, y in near if sets[x] != sets[y]}
        assert len(got) == len(want) and {frozenset((known[a], known[b])) for a, b in got} == want
    assert len(jaccard_join.classes(df)[1].distinct().collect()) < len(want)
    counts = {r["doc_id"]: r["n_links"] for r in jaccard_join.link_counts(df).collect()}
    assert [counts[k] for k, _ in docs] == [sum((i, j) in near for j in range(len(docs))) for i in range(len(docs))]


def test_other_thresholds(spark):
    docs = corpus(3, 120)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for near, words in ((70, 3), (95, 5)):
        assert sorted(map(tuple, jaccard_join.groups(df, near=near, words=words).collect()), key=repr) == brute(docs, near, words)


def test_edges(spark, rows, empty):
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    assert sorted(map(tuple, jaccard_join.groups(rows).collect()), key=repr) == brute(docs)
    assert jaccard_join.groups(empty).count() == 0


def test_one_of_each(spark, rows, empty, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([1, 5, 6, 7, 8, 10, 12, 13, None], key=repr)
    twice = docs.filter("doc_id = 3")
    twice.coalesce(1).write.parquet(str(tmp_path / "twice"))
    assert jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "twice"))).count() == 1
    assert jaccard_join.one_of_each(empty).count() == 0


def test_prefix_size():
    for n in range(1, 300):
        need = next(k for k in range(n + 1) if 100 * k >= 80 * n)
        assert jaccard_join.prefix_size(n) == n - need + 1


def test_indexer_on_many_near_copies():
    """3,000 classes with 400 shared shingles each: in bounded parts, equal to a sort of each class."""
    r = np.random.default_rng(2)
    token = r.integers(-(2**62), 2**62, (3000, 400))
    df = r.integers(2, 50, (3000, 400))
    pairs = pa.StructArray.from_arrays([pa.array(df.ravel()), pa.array(token.ravel())], ["df", "token"])
    shared = pa.ListArray.from_arrays(pa.array(np.arange(0, 400 * 3001, 400, np.int32)), pairs)
    rest = np.array([7, 8], np.int64).tobytes()
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(3000)), pa.array([1000] * 3000), pa.array([450] * 3000), pa.array([rest] * 3000, pa.binary()), shared], ["fp", "n", "n_front", "rest", "shared"])
    made = list(jaccard_join._indexer(80, 1.0)(iter([batch])))
    size = jaccard_join.prefix_size(1000) - (450 - 2 - 400)
    assert max(m.num_rows for m in made) < jaccard_join.CHUNK_SHINGLES + 1000 and sum(m.num_rows for m in made) == 3000 * size
    first = made[0].to_pydict()
    want = [t for _, t in sorted(zip(df[0].tolist(), token[0].tolist()))] + [7, 8]
    assert first["token"][:size] == want[:size] and first["place"][:size] == list(range(48, 48 + size))
