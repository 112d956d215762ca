"""URL rules with redirect equivalence.

Redirect and canonical-link edges tie pages that are one page under several addresses. A block decision
holds for all aliases of a blocked page, unless a rule allows the alias itself or another one of its class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.operators.ordered import attach

from .components import components
from .registry import query, table

MAX_RULES = 100_000  # rules are a list on the driver and one value in each task


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://`` or for NULL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and action of the longest rule that fits (NULL: none does).

    Hosts are cut into their suffixes, which meet the rules by equality; paths are compared after that.
    ``rules`` is a list of at most MAX_RULES, held as one map value. Two rules of the same host and path
    must not differ. Columns of ``pages`` called host, path, rule or action are replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if len({r.name for r in rules}) < len(set(rules)):
        raise ValueError("two rules of one host and path differ")
    host, path = host_path(F.col(f"`{url}`").cast("string"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "action")]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    by_host: dict[str, list] = {}
    for r in sorted(set(rules), key=lambda r: (-len(r.name), r.name)):
        by_host.setdefault(r.host, []).append((r.path, r.name, r.action))
    held = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("path", "rule", "action")]))
    schema = T.StructType([T.StructField("_rules", T.MapType(T.StringType(), held))])
    known = split.sparkSession.createDataFrame([(by_host,)], schema)
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.filter(F.element_at("_rules", s), lambda r: F.startswith(F.col("path"), r["path"])), F.array().cast(held))))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    one = attach(split, known).withColumn("_hit", longest)
    return one.select(*split.columns, F.col("_hit.rule").alias("rule"), F.col("_hit.action").alias("action"))


def _absolute(link: Column, url: Column) -> Column:
    """A link's address: absolute as it is, else completed from the page's url."""
    scheme, origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^?#]*/)", 1)
    return (
        F.when(F.length(link) == 0, F.lit(None).cast("string")).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(folder, link))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses from canonical links and meta refreshes of each page, in any order of the attributes.

    Pages without such a link, without html or without a url give no edge.
    """
    here = F.col(f"`{url}`").cast("string")
    text = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    links = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""))
    metas = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    found = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)),
        F.transform(metas, lambda x: F.regexp_extract(x, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1)),
    )
    each = pages.filter(here.isNotNull()).select(here.alias("source"), F.explode(found).alias("link"))
    return each.select("source", _absolute(F.col("link"), F.col("source")).alias("target")).filter("target is not null and source <> target").distinct()


def judged(pages: DataFrame, edges: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and ``class_url``, the least address of its class (NULL: no alias).

    ``edges``: (source, target), redirects and canonical links; addresses that are no page tie their
    neighbours too, and rules judge them as well. A page that a rule fits has that rule's verdict. Any other
    page is blocked if an address of its class is blocked by rule and none is allowed by rule; a page without
    aliases is allowed. NULL urls and urls without ``://`` have no rule and, unless an edge names them, no alias.
    """
    classes = components(edges, "source", "target")
    rule_of = matched(classes.select(F.col("node").alias("url"), "component"), rules)
    says = lambda what: F.max(F.when(F.col("action") == what, 1).otherwise(0)).alias(what)
    verdicts = rule_of.groupBy("component").agg(says("block"), says("allow"))
    aliases = classes.join(verdicts, "component").select(
        F.col("node").alias("_node"), F.col("component").alias("class_url"), ((F.col("block") == 1) & (F.col("allow") == 0)).alias("_blocked"))
    rows = matched(pages.select([F.col(f"`{c}`") for c in pages.columns if c not in ("class_url", "verdict")]), rules, url)
    met = rows.join(aliases, rows[url] == aliases["_node"], "left")
    verdict = F.coalesce("action", F.when(F.col("_blocked"), "block").otherwise("allow"))
    return met.withColumn("verdict", verdict).drop("action", "_node", "_blocked")


OP10_SQL = r"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(action, h, p)),
link AS (
    SELECT DISTINCT url AS source, unnest(
        list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
        || list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS target
    FROM pages WHERE url IS NOT NULL
), edge AS (
    SELECT source, target FROM link WHERE target LIKE '%://%' UNION SELECT target, source FROM link WHERE target LIKE '%://%'
), reach(a, b) AS (SELECT source, source FROM edge UNION SELECT r.a, e.target FROM reach r JOIN edge e ON r.b = e.source),
node AS (SELECT DISTINCT url FROM pages UNION SELECT b FROM reach),
cut AS (
    SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM node)
), ruled AS (
    SELECT url, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
    FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url, host, path
), class AS (SELECT a AS url, min(b) AS class_url, bool_or(action = 'block') AS blocked, bool_or(action = 'allow') AS allowed FROM reach JOIN ruled ON ruled.url = b GROUP BY a)
SELECT page_id, host, path, rule, class_url,
       CASE WHEN action IS NOT NULL THEN action WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM pages JOIN ruled ON ruled.url IS NOT DISTINCT FROM pages.url LEFT JOIN class ON class.url = pages.url
"""


@query("op10_url_filter", OP10_SQL)
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judged(pages.select("page_id", "url"), page_edges(pages)).select("page_id", "host", "path", "rule", "verdict", "class_url")
