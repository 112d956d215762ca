"""Secret scans with an incremental ledger of blobs.

Texts are content-addressed: a blob is the SHA-256 of a text, so every version of a file and every copy
of it under another path is one blob. Only pairs of blob and rule version that the ledger does not hold
are scanned; the findings are then joined back to all rows that carry the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from panelforge.session import stored

from .registry import query, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group ``group`` is shorter than ``least`` are dropped.

    A text that, in lower case, has none of ``hints`` can't match; no hints: always searched.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]


BASE = RuleSet("base-1", (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 16),
))
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def find(text: str | None, rules: Iterable[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points by start, then order of the rules."""
    if not text:
        return []
    low, found = text.lower(), []
    for at, (rule, pattern) in enumerate(rules):
        if not rule.hints or any(h in low for h in rule.hints):
            found += [(m.start(), at, m.end(), rule.kind) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _compiled(rules: Sequence[Rule]) -> list[tuple[Rule, re.Pattern]]:
    out = []
    for r in rules:
        # a single repeated class matches its whole run, so runs that are too short can be skipped by the engine
        one = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
        out.append((r, re.compile(f"{one[1]}{{{r.least},}}" if one and r.group == 0 and r.least > 1 else r.pattern)))
    return out


def _scanner(rules: Sequence[Rule]):
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = _compiled(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py(), compiled)] for t in texts]
            yield pa.array(found, kind)

    return arrow_udf(scan, SPANS).asNondeterministic()


def blobs(docs: DataFrame, text: str = "text", name: str = "blob") -> DataFrame:
    """``docs`` with the content address of each text; NULL counts as the empty text."""
    return docs.withColumn(name, F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))


def scan(docs: DataFrame, rules: RuleSet = BASE, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """New ledger rows (blob, version, spans) for the blobs of ``docs`` that ``ledger`` lacks for this version.

    Spans are (kind, start, end) in code points, end exclusive; a blob without a finding has an empty list,
    so it is not scanned again. Copies of a text are collapsed within each task before they are shuffled.
    An empty table gives no rows.
    """
    held = blobs(docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        held = held.join(ledger.filter(F.col("version") == rules.version).select("blob"), "blob", "left_anti")
    return held.select("blob", F.lit(rules.version).alias("version"), _scanner(rules.rules)("text").alias("spans"))


def update(docs: DataFrame, rules: RuleSet = BASE, ledger: DataFrame | None = None, text: str = "text", path: str | None = None) -> DataFrame:
    """The ledger with the blobs of ``docs`` added, written to ``path``.

    A ledger that later runs go on from needs a ``path``, not that of ``ledger`` itself; without one it lies in
    the shared folder until the application ends.
    """
    fresh = scan(docs, rules, ledger, text)
    grown = fresh if ledger is None else ledger.select("blob", "version", "spans").unionByName(fresh)
    if path is None:
        return stored(grown)
    grown.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: RuleSet = BASE, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``blob`` and ``spans`` of that version: all paths of all copies.

    A row whose blob was not scanned has NULL spans. Columns of ``docs`` called blob or spans are replaced.
    Only blobs with findings need to meet their rows in full; the rest carry an empty list.
    """
    rows = blobs(docs.drop("spans"), text).drop(text)
    return rows.join(ledger.filter(F.col("version") == rules.version).select("blob", "spans"), "blob", "left")


OP9_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
    SELECT doc_id, text, 1 AS rank, 'assign' AS kind,
        regexp_extract_all(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS got,
        regexp_split_to_array(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps FROM t
    UNION ALL
    SELECT doc_id, text, 2, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM t
    UNION ALL
    SELECT doc_id, text, 3, 'hex', regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') FROM t
), each AS (
    SELECT doc_id, rank, kind, u.i AS i, got[u.i] AS hit, length(gaps[u.i]) AS gap FROM raw, unnest(range(1, len(got) + 1)) AS u(i)
), placed AS (
    SELECT *, sum(gap) OVER w + sum(length(hit)) OVER w - length(hit) AS first FROM each
    WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i ROWS UNBOUNDED PRECEDING)
), spans AS (
    SELECT doc_id, rank, kind, first::BIGINT AS first, (first + length(hit))::BIGINT AS past FROM placed
    WHERE CASE rank WHEN 1 THEN length(regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
               WHEN 2 THEN length(hit) >= 18 ELSE length(hit) >= 16 END
), s AS (
    SELECT doc_id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
           string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, rank) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, sha256(text) AS blob, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""


@query("op9_secret_scan", OP9_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = findings(docs, update(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", "blob", count("assign"), count("access"), count("hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
