import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelforge.llm import packing


def test_best_fill_is_optimal():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.randrange(1, 40)
        lengths = [r.randrange(1, 25) for _ in range(r.randrange(0, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        got = packing.best_fill(counts, capacity)
        assert all(n <= counts[x] for x, n in got)
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= capacity)
        assert sum(x * n for x, n in got) == best


def test_fill_window_uses_each_place_once():
    lengths = [random.Random(i).randrange(1, 65) for i in range(400)]
    rows = packing.fill_window(lengths, 64)
    assert sorted(i for row in rows for i in row) == list(range(400))
    assert all(sum(lengths[i] for i in row) <= 64 for row in rows)
    assert len(rows) <= sum(lengths) / 64 * 1.02 + 1


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, docs, reference, capacity):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
    want = sorted((k, reference(t)) for k, t in docs)
    assert sum(p["length"] for p in pieces) == sum(len(x) for _, x in want)
    for key, ids in want:
        mine = sorted(by_doc[(key, len(ids))], key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in mine) == np.array(ids, "<u4").tobytes()
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1]] and ends[-1] + own[0]["pad"] == capacity
    return len(by_seq)


@pytest.mark.parametrize("capacity, window", [(64, 7), (1024, 8192)])
def test_round_trip(spark, reference, capacity, window):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["the", "Zoë", "naïve", "x1", "12345", "<|endoftext|>", "\n\n", "été"]) for _ in range(r.choice([0, 3, 50, 900])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 5000), (103, "  \n\t "), (104, "<|endoftext|>")]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), capacity, window).collect()
    n = check(pieces, docs, reference, capacity)
    assert n <= -(-sum(p["length"] for p in pieces) // capacity) * 1.2 + 3


def test_digest_and_edges(spark, rows, empty):
    for p, d in zip(packing.pack(rows).collect(), packing.digest(packing.pack(rows)).collect()):
        assert d["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and d["doc_id"] == p["doc_id"]
    assert sum(p["length"] for p in packing.pack(rows).collect() if p["doc_tokens"] == 1) == 3
    assert packing.pack(empty).count() == 0
