"""Boilerplate lines by their frequency within a site, in DataFrame functions only.

The share of a line is the number of the host's pages that contain it, divided by the host's pages.
Lines above a share are dropped from the host's pages. Exact copies of a page on one host count as one page:
else the copies of a single article would make each of its lines look like boilerplate. Near copies do so too
where the caller asks for it: pages are sketched by their smallest shingle hashes, and a page whose sketch is
half shared with others of its host counts as that part of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .registry import query, table
from .texts import free_name

#: Share and pages at which a line of a whole corpus is a template's. Different pages of a host are different
#: texts: a line that 1 % of them hold, and 3 at least, is not written anew on each of them. The floor asks small
#: hosts for a higher share: 30 % of 10 pages, 6 % of 50.
SHARE, PAGES = 0.01, 3

#: Hashes of a page's sketch. Near copies (80 % of all shingles in common) share half of 16 with a chance above 99.9 %.
SKETCH = 16
#: One page, as a whole number that parts of a page divide; sums stay exact in 64 bits up to 2 ** 33 pages a host.
UNIT = 1 << 30


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _known(line: Column) -> Column:
    """A line's 64-bit hash; two lines of one host that differ share it with a chance of 2 ** -64."""
    return F.xxhash64(line)


def page_of(text: Column) -> Column:
    """The hash that tells pages apart: equal texts are one page, NULL is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketch(text: Column) -> Column:
    """The ``SKETCH`` smallest hashes of a text's different 5-word shingles that begin with an anchor; words are in lower case.

    Anchors are the words whose hash is divisible by 4, so that near copies choose the same; in texts of fewer than
    256 words all are, as a few hashes would say little. Copies on both sides of that length are two groups. A text
    without any anchor has an empty sketch.
    """
    words = F.filter(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    hashes = F.array(F.transform(words, _known))  # one element, so that the words are hashed once

    def smallest(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0)))
        anchors = F.filter(places, lambda i: (F.size(w) < 256) | (F.get(w, i).bitwiseAND(3) == 0))
        shingles = F.transform(anchors, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))  # NULL past the end is skipped
        return F.slice(F.sort_array(F.array_distinct(shingles)), 1, SKETCH)

    return F.transform(hashes, smallest)[0]


def _alike(pages: DataFrame) -> DataFrame:
    """(host, page, alike): pages of which half the sketch or more is on other pages of the host, and on how many, itself included.

    ``alike`` is the number of pages that hold the sketch's median hash, hashes put in order of that number. A hash
    that one page alone holds goes after the first count, so only what near copies or templates share is joined.
    """
    each = pages.select("host", "page", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    often = each.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = each.join(often, ["host", "mark"]).groupBy("host", "page").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("c"), asc=False).alias("c"))
    half = F.ceil(F.col("n") / 2).cast("int")
    return met.filter(F.size("c") >= half).select("host", "page", F.element_at("c", half).alias("alike"))


def line_shares(docs: DataFrame, host: str = "source", text: str = "text", near: bool = False) -> DataFrame:
    """(host, line, n_pages, host_pages): different pages of the host with the line, by the line's hash, and all of them.

    A page counts once for a line, however often it repeats it, and rows of equal text are one page of the
    host; NULL counts as the empty text. Lines without a word are not counted, nor are rows without a host.
    With ``near``, a page that is alike to m - 1 others of its host counts as 1 / m of a page, so a group of near
    copies counts as about one; both numbers are then doubles, sums of whole numbers of 2 ** -30 and so the same on
    every run. Pages with more than half of their shingles from one template are alike too.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.array_distinct(F.transform(F.filter(_lines(body), _has_word), _known))
    marks = [sketch(body).alias("marks")] if near else []
    rows = docs.select(F.col(f"`{host}`").alias("host"), page_of(F.col(f"`{text}`")).alias("page"), own.alias("lines"), *marks).filter("host is not null")
    if near:
        each = stored(rows.groupBy("host", "page").agg(F.first("lines").alias("lines"), F.first("marks").alias("marks")))
        part = F.floor(F.lit(UNIT) / F.coalesce("alike", F.lit(1))).cast("bigint")
        each = each.join(_alike(each), ["host", "page"], "left").select("host", "lines", part.alias("part"))
        total = F.sum("part") / F.lit(float(UNIT))
        pages = each.groupBy("host").agg(total.alias("host_pages"))
        counted = each.select("host", "part", F.explode("lines").alias("line")).groupBy("host", "line").agg(total.alias("n_pages"))
        return counted.join(pages, "host")
    each = rows.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    pages = rows.groupBy("host").agg(F.countDistinct("page").alias("host_pages"))
    counted = each.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.join(pages, "host")


def boilerplate(
    docs: DataFrame, ratio: float = 0.08, least: int = 5, host: str = "source", text: str = "text", near: bool = False,
) -> DataFrame:
    """(host, lines): hashes of the lines on more than ``ratio`` of the host's pages and on ``least`` pages or more.

    Per host at most (mean lines of a page) / ``ratio`` lines can pass, so the array stays small for any host.
    """
    shares = line_shares(docs, host, text, near).filter((F.col("n_pages") > F.col("host_pages") * ratio) & (F.col("n_pages") >= least))
    return shares.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    docs: DataFrame, ratio: float = 0.08, least: int = 5, host: str = "source", text: str = "text", counts: tuple[str, str] | None = None,
    near: bool = False,
) -> DataFrame:
    """``docs`` with the boilerplate lines of its host taken out of each text, other columns unchanged.

    ``counts`` names two bigint columns to add: lines of the text before, and lines dropped. All rows stay,
    also those left with an empty text. Rows without a host or with NULL text keep their text; lines without
    a word stay in place. ``ratio`` and ``least`` hold for hosts of any size: a host with fewer than ``least``
    pages keeps all lines. The defaults are those of the query and its twin; corpora take ``SHARE`` and ``PAGES``.
    ``near`` is that of ``line_shares``. The hosts' arrays meet the rows by host: broadcast only below Spark's threshold,
    else in a sort-merge join whose large hosts are split at run time.
    """
    rare = boilerplate(docs, ratio, least, host, text, near)
    key, drop = free_name(docs, "site"), free_name(docs, "dropped")
    met = docs.join(rare.select(F.col("host").alias(key), F.col("lines").alias(drop)), F.col(f"`{host}`") == F.col(key), "left")
    body = F.col(f"`{text}`").cast("string")
    kept = F.filter(_lines(body), lambda x: ~F.coalesce(_has_word(x) & F.array_contains(drop, _known(x)), F.lit(False)))
    cleaned = F.when(F.col(drop).isNull() | body.isNull(), body).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        before = F.coalesce(F.size(_lines(body)), F.lit(0)).cast("bigint")
        after = F.when(F.col(drop).isNull(), before).otherwise(F.coalesce(F.size(kept), F.lit(0)).cast("bigint"))
        out += [before.alias(counts[0]), (before - after).alias(counts[1])]
    return met.select(*out)


OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
pages AS (SELECT source, count(DISTINCT coalesce(text, '')) AS n FROM documents WHERE source IS NOT NULL GROUP BY source),
shares AS (SELECT source, line, count(*) AS k FROM (
    SELECT source, unnest(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM (SELECT DISTINCT source, text, l FROM t) WHERE source IS NOT NULL) GROUP BY source, line),
often AS (SELECT source, list(line) AS drop_lines FROM shares JOIN pages USING (source) WHERE k > n * 0.08 AND k >= 5 GROUP BY source),
kept AS (SELECT doc_id, text, l, list_filter(l, lambda x: NOT coalesce(list_contains(drop_lines, x), false)) AS r FROM t LEFT JOIN often USING (source))
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(r, chr(10)) END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(len(r), 0))::BIGINT AS n_dropped FROM kept
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=("n_lines", "n_dropped")).drop("source")
