"""Row-wise operators against plain Python: sharding, chat, quality rules, line dedup, secrets, URLs, components."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import chat, line_dedup, quality_rules, secret_scan, sharding, url_filter
from panelforge.llm.components import components


def jump(key, n):
    """The published loop."""
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 7, 24, 1000])
def test_jump_shard(spark, shards):
    r = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [r.randrange(-(2**63), 2**63) for _ in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
    assert all(r["s"] == jump(r["k"], shards) for r in got)


def test_shards_grow_and_slots_are_gapless(spark, rows, empty, small_segments):
    got = sharding.shard(rows, 3).collect()
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x["slot"])
        assert x["grown_shard"] in (x["shard"], 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(got) == rows.count()
    want = sorted((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows.collect())
    assert sorted((x["size"], x["text_crc32"]) for x in got) == want
    assert sharding.shard(empty, 3).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    slots = sharding.shard(many, 5).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(s["n"] == s["d"] == s["m"] + 1 for s in slots)
    names = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    key = sharding.stable_key("k", names.schema["k"].dataType)
    assert {r["s"] for r in names.select(sharding.jump_shard(key, 9).alias("s")).collect()} <= set(range(9))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, rows, empty):
    r = random.Random(4)
    texts = ["", None, "a a a a", "a b a b a b", "a b c", "x\u00a0y \u2003z\x1cw", "l\n\nl\n l\nl", "#*# <|> é"]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "\t", "ü", "#", "\x0b", " ", "\u3000"]) for _ in range(r.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    for x in quality_rules.ledger(df).collect():
        assert tuple(x["ledger"])[:-1] == measured(x["text"])
    with pytest.raises(ValueError):
        quality_rules.ledger(rows)  # it has a column of that name
    held = quality_rules.ledger(rows, name="held")
    assert held.columns == [*rows.columns, "held"] and held.count() == rows.count() and quality_rules.ledger(empty, name="held").count() == 0
    kept = quality_rules.apply_policy(rows, quality_rules.STRICT)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None}  # 10 and 11 repeat themselves


def test_ablation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality_rules.ledger(docs).select("source", "ledger").cache()
    bits = [r["ledger"]["fail_bits"] for r in held.collect()]
    for row in quality_rules.ablation(held).collect():
        policy = next(p for p in quality_rules.POLICIES if p.version == row["version"])
        one, whole = quality_rules.mask(quality_rules.Policy("x", (row["rule"],))), quality_rules.mask(policy)
        assert row["n_failed"] == sum(b & one != 0 for b in bits) and row["n_only"] == sum(b & whole == one for b in bits)
        assert row["n_kept"] == sum(b & whole == 0 for b in bits) and row["n_kept_without"] == sum(b & whole & ~one == 0 for b in bits)
    assert [r["n_kept"] for r in quality_rules.ablation(held.filter("false")).collect()] == [0] * 7
    some = quality_rules.failed_by(held, ["source"]).collect()
    assert sum(r["n_rows"] for r in some) == len(bits) and all(r["any_bits"] | r["all_bits"] == r["any_bits"] for r in some)


def test_line_dedup(spark, rows, empty):
    pages = [(i, "h", f"head\nbody {i}\n\nfoot") for i in range(20)] + [(20, "h", "head\nbody 0\n\nfoot"), (21, "h", None), (22, None, "head\nfoot")]
    pages += [(30 + i, "s", f"head\nbody {i}\nfoot") for i in range(3)] + [(40 + i, "c", "one\ntwo") for i in range(9)]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df, counts=("n", "gone")).collect()}
    assert got[3]["text"] == "body 3\n" and (got[3]["n"], got[3]["gone"]) == (4, 2)
    assert got[21]["text"] is None and got[22]["text"] == "head\nfoot" and got[31]["text"] == "head\nbody 1\nfoot" and got[40]["text"] == "one\ntwo"
    same = line_dedup.drop_boilerplate(rows)
    assert same.columns == rows.columns and sorted(map(repr, same.collect())) == sorted(map(repr, rows.collect()))
    assert line_dedup.drop_boilerplate(empty).count() == 0
    shares = {(r["host"], r["n_pages"]) for r in line_dedup.line_shares(df).collect()}
    assert ("h", 20) in shares and ("c", 1) in shares


def test_planted_ad_line(spark):
    """The pipeline's stage drops an ad line on 3 % of a large host's pages; a line on few of them stays."""
    ad, few = "buy now at the corner", "a line of four pages"
    pages = [(i, "h", f"page {i}\nbody {i}" + f"\n{ad}" * (i % 33 == 0) + f"\n{few}" * (i % 125 == 1)) for i in range(500)]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert [got[i]["text"] for i, _, _ in pages] == [t.replace(f"\n{ad}", "") for _, _, t in pages]
    assert got[33]["n_chars"] == len("page 33\nbody 33") and few in got[1]["text"]


def test_small_hosts(spark):
    """A line on 3 of a host's 10 pages goes, one on 2 of them stays, and a host of 2 pages keeps all."""
    pages = [(i, "h", f"body {i}" + "\nmenu" * (i < 3) + "\nquote" * (3 <= i < 5)) for i in range(10)]
    pages += [(20 + i, "two", f"body {i}\nmenu") for i in range(2)]
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(df, line_dedup.SHARE, line_dedup.PAGES).collect()}
    assert [got[i] for i, _, _ in pages] == [t.replace("\nmenu", "") if h == "h" else t for _, h, t in pages]


def test_near_copies_count_once(spark):
    """A group of near copies with a third of a host keeps its article; the host's footer goes from all pages."""
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    article = [words(20) for _ in range(6)]
    pages = []
    for i in range(150):
        own = [words(20) for _ in range(3)]
        if i % 3 == 0:
            own = list(article)
            own[i % 6] = own[i % 6].rsplit(" ", 1)[0] + f" changed{i}"
        pages.append((i, "h", "\n".join([*own, "imprint and terms"])))
    df = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert [got[i] for i, _, _ in pages] == [t.replace("\nimprint and terms", "") for _, _, t in pages]


def test_secrets(spark, rows, empty, tmp_path):
    texts = [
        "token = 'abcdefghijkl' ABCDEF0123456789abcdef", "PassWord: short", 'Api_Key:"aaaaaaaaaaaa"', "ſecret=aaaaaaaaaaaaaaa", "apıkey=aaaaaaaaaaaaaaa",
        "AKIAABCDEFGHIJKLMN AKIASHORT", "é" * 5 + "deadbeefdeadbeef", None, "", "secret=aaaaaaaaaaaa=token=bbbbbbbbbbbbbbbb", "token=\x0baaaaaaaaaaaaaaa", "K" * 3 + "toKen : 0123456789abcdef0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(50, texts[0])], "doc_id bigint, text string")

    def plain(text):
        found = []
        for rank, rule in enumerate(secret_scan.BASE.rules):
            for m in re.finditer(rule.pattern, text or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((m.start(), rank, rule.kind, m.end()))
        return [(k, s, e) for s, _, k, e in sorted(found)]

    ledger = secret_scan.update(docs)
    got = secret_scan.findings(docs, ledger).collect()
    text_of = dict(enumerate(texts)) | {50: texts[0]}
    assert len(got) == 13 and all([tuple(s) for s in r["spans"]] == plain(text_of[r["doc_id"]]) for r in got)
    assert {r["blob"] for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for t in texts}
    # a second run scans only what is new, another version scans all
    more = docs.unionByName(spark.createDataFrame([(90, "token: zzzzzzzzzzzz"), (91, "")], docs.schema))
    assert [r["blob"] for r in secret_scan.scan(more, ledger=ledger).collect()] == [hashlib.sha256(b"token: zzzzzzzzzzzz").hexdigest()]
    grown = secret_scan.update(more, ledger=ledger, path=str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == grown.count()
    assert grown.count() == ledger.count() + 1 and secret_scan.findings(more, grown).filter("spans is null").count() == 0
    other = secret_scan.RuleSet("v2", secret_scan.BASE.rules[:1])
    assert secret_scan.scan(more, other, grown).count() == grown.count()
    assert secret_scan.findings(rows, secret_scan.update(rows)).count() == rows.count() and secret_scan.update(empty).count() == 0


def test_chat_windows_and_names(spark):
    turns = [(1, i, "ann" if i % 3 else "b|o b", f"t{i}") for i in range(11)] + [(1, 3, "ann", "t3"), (2, None, None, "x"), (2, 1, "system", None), (2, 1, "zoé", "é")]
    turns += [(None, 0, "q", "lost"), (3, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    got = chat.rotate(df, window=4).collect()
    for r in got:
        own = [r["text"][s["start"] : s["end"]] for s in r["spans"]]
        assert len(own) == r["n_own"] > 0 and all(x.endswith(chat.END) for x in own) and r["text"].count("<|assistant|>") == r["n_own"]
        assert r["text"].count(chat.END) == r["n_turns"] <= 4
    assert {(r["conv_id"], r["speaker"]) for r in got} == {(1, "ann"), (1, "b|o b"), (2, "zoé"), (None, "q")}
    whole = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["speaker"] == "ann"), key=lambda r: r["window"]))
    assert re.findall(r"\nt(\d+)<", whole) == ["0", "1", "2", "3", "3", "4", "5", "6", "7", "8", "9", "10"] and "<|user:b_o_b|>" in whole
    assert chat.rotate(df.filter("false")).count() == 0


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://x.net": ("x.net", "", None, None), "ftp://net/": ("net", "/", "net/", "block"),
        "no scheme": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://fr.org/fr/": ("fr.org", "/fr/", "org/fr/", "allow"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "http://x.example.com/de/a": ("x.example.com", "/de/a", "example.com/de/", "block"), "http://É.NET/?": ("É.net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([*((u,) for u in urls), (None,)], "url string")
    for r in url_filter.matched(df).collect():
        assert (r["host"], r["path"], r["rule"], r["action"]) == urls.get(r["url"], ("", "", None, None))


def test_redirect_classes(spark):
    link = lambda u: f"<html><LINK href='{u}' data-x=1 rel=\"canonical\">"
    pages = [
        (1, "http://a.io/1", link("http://b.net/x")), (2, "http://c.io/2", link("/3")), (3, "http://c.io/3", '<meta content="0; url=http://a.io/1" http-equiv="refresh">'),
        (4, "http://d.io/", link("http://e.net/q")), (5, "http://f.org/fr/ok", link("http://d.io/")), (6, "http://lone.io", None), (7, None, link("http://b.net/x")), (8, "http://b.net/x", ""), (8, "http://b.net/x", ""),
        (9, "nothing", "<link rel=canonical href=//b.net/x>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = url_filter.judged(df, url_filter.page_edges(df)).select("page_id", "verdict", "rule").collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [
        (1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (9, "allow")]
    assert url_filter.judged(df.filter("false"), url_filter.page_edges(df.filter("false"))).count() == 0


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1080), r.randrange(1000, 1080)) for _ in range(45)] + [(7, 7), (None, 3), (4, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {tuple(x) for x in got} == {(x, find(x)) for x in parent} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
