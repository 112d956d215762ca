"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger holds the measurements and, in ``fail_bits``, one
bit for each rule that the document fails. Policies are masks over these bits: a new policy version, or
a policy with one rule left out, is a bitwise operation over the stored ledger and reads no text.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .registry import query, table
from .texts import coded_words, free_name, slices

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(codes: np.ndarray, starts: np.ndarray, n_codes: int) -> np.ndarray:
    """Per text, the words inside 3-word windows that the text has twice or more."""
    out = np.zeros(len(starts) - 1, np.int64)
    if len(codes) < 4:
        return out
    # three codes packed in one number: exact while n_codes ** 3 < 2 ** 63, else pairs are coded anew
    first = codes[:-2] * n_codes + codes[1:-1]
    if n_codes >= 1 << 21:
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    window = first * n_codes + codes[2:]
    for i in np.flatnonzero(np.diff(starts) > 3):
        keys = window[starts[i] : starts[i + 1] - 2]
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        if same.any():
            at = np.concatenate([order[1:][same], order[:-1][same]])
            covered = np.zeros(len(keys) + 2, bool)
            for shift in range(3):
                covered[at + shift] = True
            out[i] = covered.sum()
    return out


def _measure(texts: pa.Array) -> pa.Array:
    values = texts.to_pylist()
    codes, starts, words = coded_words(texts)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.concatenate([[0], np.cumsum(sizes[codes])])
    lines = [[x for x in (t or "").split("\n") if x.strip(BLANK)] for t in values]
    columns = {
        "n_words": np.diff(starts),
        "word_chars": chars[starts[1:]] - chars[starts[:-1]],
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in values], np.int64),
        "n_lines": np.array([len(x) for x in lines], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(codes, starts, max(1, len(words))),
    }
    return pa.StructArray.from_arrays([pa.array(columns[m], pa.int64()) for m in MEASURES], list(MEASURES))


@arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(texts: pa.Array) -> pa.Array:
    parts = [_measure(part) for part in slices(texts)]
    return pa.concat_arrays(parts) if parts else _measure(texts)


measures = _measures.asNondeterministic()  # keeps filters above it from computing it twice


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` of the ledger is set where ``fails``, a condition over the measures, holds."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A version with the rules it applies, by name."""

    version: str
    rules: tuple[str, ...]


#: Bits stay with their rule for ever; a changed rule gets a new bit.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 50),
    Rule(1, "repeated_words", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule(2, "symbols", lambda m: m("n_symbols") * 10 > m("n_words") * 3),
    Rule(3, "word_length", lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 20)),
    Rule(4, "duplicate_lines", lambda m: m("n_dup_lines") * 2 > m("n_lines")),
)
BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("strict", tuple(r.name for r in RULES))
POLICIES = (BASE, STRICT)


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return functools.reduce(lambda a, b: a | bits[b], policy.rules, 0)


def passes(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) == 0


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, name: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``name``: the measures and ``fail_bits``.

    All columns and rows stay, repeated rows too. A NULL or empty text has no words and no lines, so all
    its measures are 0. If ``docs`` has a column called ``name`` (or an inner one), rename it first.
    """
    if any(n > 1 for n in Counter(r.bit for r in rules).values()) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    if name in docs.columns:
        raise ValueError(f"there is a column {name!r} already")
    held = free_name(docs, "measured")
    bits = functools.reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(r.fails(lambda m: F.col(f"{held}.{m}")), F.lit(1 << r.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for r in rules],
        F.lit(0).cast("bigint"),
    )
    measured = docs.withColumn(held, measures(F.col(f"`{text}`").cast("string")))
    return measured.withColumn(name, F.struct(f"{held}.*", bits.alias("fail_bits"))).drop(held)


def apply_policy(docs: DataFrame, policy: Policy, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their columns unchanged."""
    name = free_name(docs, "ledger")
    held = ledger(docs, text, rules, name)
    return held.filter(passes(F.col(f"{name}.fail_bits"), policy, rules)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablation(held: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES, name: str = "ledger") -> DataFrame:
    """What each rule does in each policy: version, rule, n_failed, n_only (rejected by this rule alone),
    n_kept and n_kept_without (the rule).

    Rows are first counted by their bits, so at most 2 ** rules counts go on, whatever the table's size. An
    empty ledger gives zeros. Returns one row per policy and rule.
    """
    counted = held.groupBy(F.col(f"{name}.fail_bits").alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    by_name = {r.name: 1 << r.bit for r in rules}
    cases = [(p.version, r, mask(p, rules), by_name[r]) for p in policies for r in p.rules]
    out = []
    for i, (_, _, whole, one) in enumerate(cases):
        seen = F.col("bits").bitwiseAND(F.lit(whole).cast("bigint"))
        rest = F.col("bits").bitwiseAND(F.lit(whole & ~one).cast("bigint"))
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0).cast("bigint"))
        out.append(F.struct(
            total(F.col("bits").bitwiseAND(F.lit(one).cast("bigint")) != 0).alias("n_failed"), total(seen == one).alias("n_only"),
            total(seen == 0).alias("n_kept"), total(rest == 0).alias("n_kept_without"),
        ).alias(f"c{i}"))
    named = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), f"c{i}.*") for i, (v, r, _, _) in enumerate(cases)]
    return counted.agg(*out).select(F.inline(F.array(*named)))


def failed_by(held: DataFrame, keys: Sequence[str], name: str = "ledger") -> DataFrame:
    """Per group, the bits that any (``any_bits``) and that every document (``all_bits``) fails."""
    bits = F.col(f"{name}.fail_bits")
    return held.groupBy(*keys).agg(F.bit_or(bits).alias("any_bits"), F.bit_and(bits).alias("all_bits"), F.count(F.lit(1)).alias("n_rows"))


OP3_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), tri AS (
    SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS k
    FROM t, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i) WHERE len(w) > 2
), hot AS (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri) WHERE n > 1
), rep AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM hot GROUP BY doc_id),
m AS (
    SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM t LEFT JOIN rep USING (doc_id)
), b AS (
    SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN n_repeat_words * 100 > n_words * 50 THEN 2 ELSE 0 END
        + CASE WHEN n_symbols * 10 > n_words * 3 THEN 4 ELSE 0 END
        + CASE WHEN word_chars < n_words * 2 OR word_chars > n_words * 20 THEN 8 ELSE 0 END
        + CASE WHEN n_dup_lines * 2 > n_lines THEN 16 ELSE 0 END AS fail_bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, fail_bits::BIGINT AS fail_bits,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = lambda c: F.col(f"ledger.{c}").alias(c)
    bits = F.col("ledger.fail_bits")
    return ledger(docs).select(
        "doc_id", *[m(c) for c in MEASURES], m("fail_bits"),
        (~passes(bits, BASE)).alias("base_failed"), (passes(bits, BASE) & passes(bits, STRICT)).alias("kept"),
    )
