import random

from panelforge.llm import decontaminate as d


def distance_table(item, text):
    """Least edit distance of item to any piece of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distances():
    r = random.Random(2)
    for _ in range(300):
        item = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 60)))
        assert min(d.distances(d.masks(item), len(item), text)) <= len(item)
        assert min(min(d.distances(d.masks(item), len(item), text)), len(item)) == distance_table(item, text)


def edited(r, text, n):
    x = list(text)
    for _ in range(n):
        i = r.randrange(len(x))
        how = r.randrange(3)
        if how == 0:
            x[i] = r.choice("qzj")
        elif how == 1 and len(x) > 1:
            del x[i]
        else:
            x.insert(i, r.choice("qzj"))
    return "".join(x)


def test_matches_against_brute_force(spark):
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [(i, words(r.choice([2, 10, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "  ")]
    docs = []
    for k in range(60):
        body = words(r.choice([0, 5, 40]))
        if r.random() < 0.7:
            item = items[r.randrange(12)][1]
            body = f"{body} {edited(r, item, r.choice([0, 0, 1, 3, 8, 15]))}\n {words(4)}"
        docs.append((k, body.upper() if r.random() < 0.2 else body))
    found = d.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(m["doc_id"], m["item_id"]): m["errors"] for m in found}
    want = {}
    for k, text in docs:
        for i, item in items[:12]:
            n = distance_table(d.normal(item), d.normal(text))
            if n <= d.budget(len(d.normal(item))):
                want[(k, i)] = n
    assert got == want and len(want) > 20
    text, item = dict(docs), dict(items)
    for m in found:
        span = d.normal(text[m["doc_id"]][m["start"] : m["end"]])
        assert distance_table(d.normal(item[m["item_id"]]), span) == m["errors"]


def test_clean_and_edges(spark, rows, empty):
    items = spark.createDataFrame([(1, "n10 n11 n12 n13 n14 n15 N16"), (1, "n10 n11 n12 n13 n14 n15 N16"), (2, None)], "item_id int, text string")
    kept = d.clean(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 5
    assert d.matches(rows, items).count() == 10  # repeated items and repeated rows
    assert d.clean(empty, items).count() == 0 and d.matches(rows, items.filter("false")).count() == 0
    assert d.clean(rows, items.filter("false")).count() == rows.count()


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, d.matches(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 1500)
    assert sum(1 for _ in d.blocks(items)) > 3
    assert sorted(map(tuple, d.matches(docs, items).collect())) == whole and whole
