"""Multi-party perspective rotation: each dialogue once per participant, with that speaker as the assistant.

All others are named users. The loss mask of a perspective covers the speaker's own words and end marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.operators.ordered import positions, splitters

from .registry import query, table

END = "<|end|>"
WINDOW_TURNS = 256


def _header(own: Column, speaker: Column, narrators: Sequence[str]) -> Column:
    """Role line of a turn; characters that could end it are replaced in names."""
    name = F.regexp_replace(F.coalesce(speaker, F.lit("")), r"[\s|<>:]", "_")
    other = F.when(F.length(name) > 0, F.concat(F.lit("<|user:"), name, F.lit("|>\n"))).otherwise(F.lit("<|user|>\n"))
    system = F.lit(False) if not narrators else F.coalesce(speaker.isin(*narrators), F.lit(False))
    return F.when(system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(other)


def rotate(
    turns: DataFrame, window: int = WINDOW_TURNS, narrators: Sequence[str] = ("system",),
    conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
) -> DataFrame:
    """One row per dialogue window and participant: the dialogue, window, speaker, first_turn (place of its first
    turn in the dialogue), n_turns, n_own, text, spans ((start, end) code points of the text that are trained).

    Turns are ordered by ``turn``, then speaker and text; a dialogue of more than ``window`` turns is cut into
    windows of that many, so none is gathered whole and a dialogue gives at most one row per turn. Participants
    of a window are the speakers with a turn in it; ``narrators`` speak in every perspective as system and have
    none of their own, nor has a NULL or empty speaker, who is a user without a name. A NULL text is an empty
    one. Rows with a NULL dialogue are one dialogue. Repeated rows are repeated turns. A window of nobody but
    narrators gives no row, nor does an empty table; other columns are left out.
    """
    c = lambda x: F.col(f"`{x}`")
    rows = turns.select(c(conv).alias("conv"), c(turn).alias("turn"), c(speaker).cast("string").alias("speaker"), F.coalesce(c(text).cast("string"), F.lit("")).alias("body"))
    order = ["turn", "speaker", "body"]
    placed = positions(rows, "conv", order, "place", split=splitters(rows, "conv", order)).withColumn("place", F.col("place") - 1)
    grouped = placed.groupBy("conv", F.floor(F.col("place") / window).alias("window")).agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "body"))).alias("turns"))
    speakers = F.array_distinct(F.transform("turns", lambda t: t["speaker"]))
    named = F.filter(speakers, lambda s: s.isNotNull() & (F.length(s) > 0) & (~s.isin(*narrators) if narrators else F.lit(True)))
    each = grouped.withColumn("me", F.explode(named))

    def part(t):
        own = F.coalesce(t["speaker"] == F.col("me"), F.lit(False))
        return F.struct(_header(own, t["speaker"], narrators).alias("head"), F.concat(t["body"], F.lit(END)).alias("said"), own.alias("own"))

    def place(state, p):
        start = state["end"] + F.length(p["head"])
        end = start + F.length(p["said"])
        span = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct((end + 1).alias("end"), F.when(p["own"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    parts = each.withColumn("parts", F.transform("turns", part))
    return parts.select(
        F.col("conv").alias(conv), "window", F.col("me").alias("speaker"), F.col("turns")[0]["place"].alias("first_turn"),
        F.size("turns").cast("bigint").alias("n_turns"), F.size(F.filter("parts", lambda p: p["own"])).cast("bigint").alias("n_own"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["said"], F.lit("\n"))), "").alias("text"),
        F.aggregate("parts", none, place, lambda s: s["spans"]).alias("spans"),
    )


OP2_SQL = r"""
WITH p AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS place
    FROM conversations
), w AS (SELECT *, place // 256 AS win FROM p),
me AS (SELECT DISTINCT conv_id, win, role AS speaker FROM w WHERE role IS NOT NULL AND role NOT IN ('', 'system')),
r AS (
    SELECT w.conv_id, w.win, speaker, place, coalesce(role = speaker, false) AS own, body || '<|end|>' AS said,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' WHEN coalesce(role, '') = '' THEN '<|user|>'
             ELSE '<|user:' || regexp_replace(role, '[\s|<>:]', '_', 'g') || '|>' END || chr(10) AS head
    FROM w JOIN me ON w.conv_id IS NOT DISTINCT FROM me.conv_id AND w.win = me.win
), o AS (
    SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, win, speaker ORDER BY place) - 1 AS past FROM r
)
SELECT conv_id, win::BIGINT AS "window", speaker, min(place)::BIGINT AS first_turn, count(*)::BIGINT AS n_turns, count(*) FILTER (own)::BIGINT AS n_own,
    string_agg(head || said || chr(10), '' ORDER BY place) AS text,
    string_agg((past - length(said))::BIGINT || ':' || past::BIGINT, ',' ORDER BY place) FILTER (own) AS spans
FROM o GROUP BY conv_id, win, speaker
"""


@query("op2_chat_rotation", OP2_SQL)
def op2(spark, sf_dir):
    rows = rotate(table(spark, sf_dir, "conversations"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))
