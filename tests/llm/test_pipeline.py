"""The pipeline from end to end on planted documents."""

import random

from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline_on_planted_documents(spark, tmp_path):
    """Junk goes, footers go, one of each group of copies stays, benchmark passages go, and the rest is packed whole."""
    import public_tokenizers

    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(n))
    foot, item = "imprint and terms of this site", words(30)
    body = {i: f"{words(60)}.\n{words(60)}." for i in range(40)}
    texts = {i: f"{b}\n{foot}" for i, b in body.items()}
    for i in range(50, 56):  # near copies of 7: one word of 120 is another
        texts[i] = texts[7].replace(body[7].split(" ")[10 * (i - 49)], f"changed{i}", 1)
    texts |= {60: texts[9], 61: "too short", 62: None, 63: f"{words(60)} {item} {words(40)}.\n{foot}"}
    docs = spark.createDataFrame([(i, t, "en", "host", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    parts = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        parts.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = {i: b"".join(x.to_bytes(4, "little") for x in [*encode(b, add_special_tokens=False).ids, 0]) for i, b in body.items()}
    assert {i: b"".join(x for _, x in sorted(ps)) for i, ps in parts.items()} == want


def test_line_dedup_stage_has_no_python(spark, rows):
    plan = corpus_pipeline.without_boilerplate(spark, rows.withColumn("n_chars", rows.n), "")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
