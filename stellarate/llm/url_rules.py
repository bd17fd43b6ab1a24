"""URL rules, carried over to aliases: pages that redirect to, or name as canonical, another.

Rules decide the urls that they fit. Redirects and canonical links join urls to
components; a page without a rule is blocked if some url of its component is blocked
by a rule and none is allowed by one: an explicit allow comes before what aliases say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellarate.llm.cluster import Scratch, join_unique
from stellarate.llm.components import components

# The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = (
    r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*="""
    r"""\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one, and for null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")), F.lit(""))


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host, path and node, the url without scheme and fragment, of a url column."""
    rest = after_scheme(F.col("_url"))
    return (
        df.withColumn("_url", F.col(f"`{url}`"))
        .withColumn("_rest", rest)
        .withColumn(
            "host", F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER)
        )
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn(
            "node",
            F.when(
                F.col("_rest") != "",
                F.concat("host", "path", F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)?", 1)),
            ),
        )
        .drop("_url", "_rest")
    )


def longest_rule(rules: tuple) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith(f".{host}"))
            & F.col("path").startswith(path),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fits)


def absolute(link: Column) -> Column:
    """A link found on a page of host ``host`` and path ``path`` as a url."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), F.col("host"), link))
        .otherwise(
            F.concat(
                F.lit("http://"), "host", F.when(folder == "", "/").otherwise(folder), link
            )
        )
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(node, other): redirects and canonical links in the pages' html."""
    found = with_parts(pages.select("url", "html"), "url").where("node IS NOT NULL")
    targets = F.array(
        *[F.regexp_extract(F.coalesce("html", F.lit("")), p, 1) for p in (CANONICAL, REFRESH)]
    )
    links = found.select("host", "path", "node", F.explode(targets).alias("link"))
    links = links.where("link != ''").select("node", absolute(F.col("link")).alias("target"))
    other = with_parts(links.select(F.col("node").alias("page_node"), "target"), "target")
    return other.where("node IS NOT NULL").select(
        F.col("page_node").alias("node"), F.col("node").alias("other")
    )


def judge(
    pages: DataFrame, scratch: Scratch, rules: tuple = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    ``redirects`` (url, target) adds redirects known from elsewhere. A null url, or
    one without ``://``, has an empty host and path, no rule and no aliases; a null
    html links to nothing. Repeated rows and pages with one url are judged each, ties
    between equally long rules go to allow. Other columns are not looked at.
    """
    links = page_links(pages)
    if redirects is not None:
        ends = [
            with_parts(redirects.select("url", "target"), end).select("url", "target", "node")
            for end in ("url", "target")
        ]
        more = (
            ends[0]
            .join(ends[1].withColumnRenamed("node", "other"), ["url", "target"])
            .select("node", "other")
        )
        links = links.unionByName(more.dropna())
    roots = components(scratch.table(links, "page-links"), scratch)
    # a node is a url without its scheme
    named = with_parts(roots.withColumn("_full", F.concat(F.lit("x://"), "node")).drop("node"), "_full")
    rule = longest_rule(rules)["verdict"]
    blocked = named.groupBy("root").agg(
        F.coalesce(F.max(rule == "block"), F.lit(False)).alias("blocks"),
        F.coalesce(F.max(rule == "allow"), F.lit(False)).alias("allows"),
    )
    blocked = scratch.table(blocked.where("blocks AND NOT allows").select("root"), "blocked-roots")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    hidden = join_unique(roots, blocked, "root", sizes, roots.count()).select(
        "node", F.lit("block").alias("inherited")
    )
    hidden = scratch.table(hidden, "blocked-nodes", keep=True)
    plain = with_parts(pages.select("page_id", "url"), "url").withColumn("found", longest_rule(rules))
    counts = plain.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(hidden.select("node"), "node", "left_semi")
    counts = scratch.table(counts, "page-counts", keep=True)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = join_unique(plain, hidden, "node", counts, total, "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "inherited", F.lit("allow")).alias("verdict"),
    )
