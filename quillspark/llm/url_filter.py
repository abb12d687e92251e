"""URL filters: host and path rules, carried to aliases over redirect and canonical links.

DataFrame functions only. A url's host is what stands after its first ``://`` up to ``/``,
``?``, ``#`` or the end, with A-Z lower-cased; its path goes on from there up to ``?``, ``#``
or the end; both are empty for a null url and one without ``://``. A rule names a host, which
it fits with all subdomains, and a prefix of the path; the longest fitting rule wins, and of
equally long ones an allow.

Pages without a rule of their own take the decision of their aliases: urls without scheme and
fragment are nodes (an empty path is ``/``), redirects (``<meta http-equiv="refresh">``) and
canonical links are edges, and every connected component that holds an explicitly allowed url is
allowed; otherwise one that holds a blocked url is blocked; all others are allowed. An explicit rule is
never overridden. Two urls that differ in their query are two nodes.

Links are resolved against their page's url as browsers do: whole urls, ``//host/x``, ``/x``, ``x``,
``../x`` and ``?x``, with ``.`` and ``..`` taken out and ``&amp;`` read as ``&``. Links to the page itself
(``#x``, empty) and of schemes without a host (``mailto:``) lead nowhere. Null html has no links. Rows that repeat are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, durable


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_TAG = r"""(?is)<(?:link|meta)\b[^>]*(?:rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh)[^>]*>"""
LINK_TARGET = r"""(?is)(?:href\s*=\s*["']?|content\s*=\s*["']?[^"'>]*url\s*=\s*'?)([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits, or nulls. ``rules`` is a literal list."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r))
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in ordered]
    pick = lambda values: F.coalesce(*(F.when(ok, F.lit(v)) for ok, v in zip(fits, values)), F.lit(None).cast("string"))
    return pick([r.host + r.path for r in ordered]), pick([r.verdict for r in ordered])


def _query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    up = lambda done: F.regexp_replace(done, "/[^/]*$", "")
    whole = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.lit("/"), x)))
    return F.when(path.rlike(r"(?s)/\.\.?$"), F.concat(whole, F.lit("/"))).otherwise(whole)


def _node(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, F.lit("\n"), F.when(path == "", "/").otherwise(path), query)


def node_of(url: Column) -> Column:
    """What a url is known by among aliases; null without ``://``."""
    return F.when(url.contains("://"), _node(host_of(url), path_of(url), _query_of(url)))


def resolved(url: Column, to: Column) -> Column:
    """The whole url that the link ``to`` on the page ``url`` leads to, or null."""
    to = F.replace(to, F.lit("&amp;"), F.lit("&"))
    site, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    own, query = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = lambda u: F.concat(F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1), _without_dots(F.when(path_of(u) == "", "/").otherwise(path_of(u))), _query_of(u))
    return (
        F.when(~url.contains("://") | (to == "") | to.startswith("#"), None)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), whole(to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("//"), whole(F.concat(F.lit("http:"), to)))
        .when(to.startswith("/"), F.concat(site, _without_dots(own), query))
        .when(to.startswith("?"), F.concat(site, path, query))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, own)), query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, to) for every redirect and canonical link in the html that leads to another url."""
    tags = pages.where(F.col("html").rlike(LINK_TAG)).select("url", F.explode(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0))).alias("tag"))
    href = tags.select("url", F.regexp_extract("tag", LINK_TARGET, 1).alias("to"))
    return href.select("url", resolved(F.col("url"), F.col("to")).alias("to")).where("to is not null").distinct()


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url, html).

    ``edges`` may bring further redirects between whole urls, as :func:`alias_edges` does.
    """
    pages = pages.select("page_id", "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node")).withColumn("rule", rule).withColumn("own", verdict)
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("url", "to"))
    links = durable(links.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b")).where("a is not null and b is not null").distinct(), "alias-edges")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    labels = connected_components(links)
    _, decided = fitting(F.substring_index("node", "\n", 1), F.regexp_extract("node", r"(?s)^[^\n]*\n([^?]*)", 1), rules)
    groups = labels.withColumn("own", decided).groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    passed = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    aliases = labels.join(groups, "component").select("node", passed.alias("passed"))
    return judged.join(aliases, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit("allow")).alias("verdict"))
