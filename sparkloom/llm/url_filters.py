"""URL filters with redirect equivalence: rules decide urls, and a block reaches every alias.

Aliases are the connected components of redirect and canonical-link edges, found as a distributed graph;
the pages' own meta refreshes and canonical links are edges, and a table of HTTP redirects may add more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no
    ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(verdict, rule) of the longest rule that fits (of equals the first in code-point order),
    or null. A rule fits its host and all subdomains where the path starts with the rule's."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def url_key(url: Column) -> Column:
    """A url as a graph node: scheme and host lower-cased, no fragment, an empty path as ``/``; null where
    there is no ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), path, query))


def resolve(base: Column, link: Column) -> Column:
    """An absolute url for ``link`` on the page ``base``; null for an empty link."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    root = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(root, folder, link))
    )


def _links(html: Column) -> Column:
    """array<string>: the targets of canonical links and meta refreshes of a page."""
    attribute = r"""(?is)\b{}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>)"""), 1)
    moves = F.regexp_extract_all(html, F.lit(r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>)"""), 1)
    bare = lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")
    canonical = F.transform(tags, lambda t: bare(F.regexp_extract(t, attribute.format("href"), 1)))
    refresh = F.transform(moves, lambda t: bare(F.regexp_extract(bare(F.regexp_extract(t, attribute.format("content"), 1)), r"(?is)\burl\s*=\s*(.*)$", 1)))
    return F.concat(canonical, refresh)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v) url keys: each page with the targets of its canonical links and meta refreshes."""
    maybe = pages.filter(F.col(html).rlike("(?i)canonical|refresh") & F.col(url).isNotNull())
    found = maybe.select(F.col(url).alias("u"), F.explode(_links(F.col(html))).alias("link"))
    return found.select(url_key(F.col("u")).alias("u"), url_key(resolve(F.col("u"), F.col("link"))).alias("v")).dropna().filter("u != v")


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_root) per row of ``pages``.

    A url that a rule fits gets the longest rule's verdict. Any other takes its aliases' part: allow if a
    rule allows one of them, else block if a rule blocks one, else ``default``. Aliases are reached
    over any number of edges; a page and a target that is no page itself both count. ``redirects`` may add
    (source, target) urls. Null or unparsable urls have empty host and path, no alias and the default; a null
    html has no edge; repeated rows are judged alike. Other columns of ``pages`` are not read.
    """
    edges = materialize(page_edges(pages, url, html), "url-edges")
    if redirects is not None:
        more = redirects.select(url_key(F.col("source")).alias("u"), url_key(F.col("target")).alias("v")).dropna()
        edges = edges.unionByName(more)
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    judged = judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("node"))
    judged = materialize(judged.withColumn("own", match_rule(F.col("host"), F.col("path"), rules)), "url-judged")
    roots = connected_components(edges)
    # rules judge each node of the graph, be it a page or not; what a component's nodes say is as small as the graph
    nodes = materialize(roots.select("node", "root", match_rule(host_of(F.col("node")), path_of(F.col("node")), rules).alias("own")), "url-roots")
    said = nodes.filter("own is not null").groupBy("root").agg(F.max(F.col("own.verdict") == "allow").alias("allow"), F.max(F.col("own.verdict") == "block").alias("block"))
    known = materialize(nodes.select("node", "root").join(said, "root", "left"), "url-said")
    method = F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block"))
    alone = match_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]  # a url outside the graph speaks for itself
    # urls that are no url have no node: they would share one key of the join
    out = judged.filter("node is not null").join(known, "node", "left").withColumn("method", F.coalesce(F.when(F.col("root").isNull(), alone).otherwise(method), F.lit(default)))
    out = out.withColumn("root", F.coalesce("root", "node")).select("page_id", "host", "path", "own", "method", "root")
    out = out.unionByName(judged.filter("node is null").select("page_id", "host", "path", "own", F.lit(default).alias("method"), F.lit(None).cast("string").alias("root")))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "method").alias("verdict"), F.col("root").alias("alias_root"))
