"""URL filters with redirect equivalence, in DataFrame functions alone.

A URL is judged by the longest rule that fits its host (or a parent domain) and path. URLs that are one
page under several names (a redirect by meta refresh, or a canonical link) form components of a graph,
found in a distributed way; a URL without a rule of its own takes its component's decision: allow
if any member has an allow rule (explicit allow goes first), else block if any member has a block rule,
else allow.

A link's target is resolved against its page's URL by the rules of RFC 3986 (schemes are told at the start of the target only,
relative paths are merged, dot segments go); a target of another scheme than http or https is no page.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule; links that
point nowhere are left out; equal URLs are one node, so repeated rows and copies share a decision; null
html has no links; empty tables give empty results; other columns are not read. Of two rules of one
length that both fit, allow goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .components import components

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def node_of(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null for no URL."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3)
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of length, allow, rule, verdict (null if none)."""
    every = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(v == "allow").alias("first"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    return F.array_max(F.filter(every, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"])))


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of refreshing meta tags, as they stand in the page."""
    html = F.coalesce(html, F.lit(""))
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, _HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, _REFRESH, 1)))
    return F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." segments."""
    none = F.array().cast("array<string>")
    steps = F.slice(F.split(path, "/"), 2, 1 << 30)
    kept = F.aggregate(steps, none, lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(F.size(steps) == 0, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolved(url: Column, target: Column) -> Column:
    """A link's target as a whole URL, seen from the page's own URL; null if it is of another scheme than the web's."""
    host, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    own, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_replace(target, r"^[^?#]*", "")
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    scheme = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    whole = F.when(scheme, F.when(target.rlike(r"(?i)^https?://"), target)).when(target.startswith("//"), F.concat(F.lit("http:"), target))
    whole = whole.when(target.startswith("#"), url).when(target.startswith("?"), F.concat(host, path, target))
    whole = whole.when(target.startswith("/"), F.concat(host, target)).otherwise(F.concat(host, folder, own, rest))
    query = F.regexp_extract(whole, _PARTS, 3)
    return F.concat(F.lit("http://"), host_of(whole), without_dots(path_of(whole)), query)


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of redirects and canonical links, each pair once."""
    html = text_of(html_col)
    found = pages.where(F.col(url_col).isNotNull() & html.rlike(r"(?i)canonical|refresh")).select(F.col(url_col).alias("url"), F.explode(link_targets(html)).alias("target"))
    return found.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("url"), F.col("target"))).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def judge(pages: DataFrame, links: DataFrame | None = None, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the ``component`` that an alias's decision came from.

    ``links`` (src and dst URLs) are further redirects, such as a crawler logs.
    """
    rules = rules or RULES
    found = edges(pages, url_col, html_col)
    if links is not None:
        found = found.unionByName(links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    aliases = components(found)  # nodes are strings; the component is its smallest
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("node", node_of(F.col("url")))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    # every alias counts with its own rule, whether or not the page itself is in the table
    named = F.concat(F.lit("http://"), F.col("id"))
    decided = aliases.withColumn("own", rule_for(host_of(named), path_of(named), rules)).groupBy("component").agg(F.bool_or(F.col("own.verdict") == "allow").alias("allowed"), F.bool_or(F.col("own.verdict") == "block").alias("blocked"))
    shared = aliases.join(decided, "component").select(F.col("id").alias("node"), "component", F.when(F.coalesce("allowed", F.lit(False)), F.lit("allow")).when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")).alias("taken"))
    joined = rows.join(shared, "node", "left")
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "taken", F.lit("allow")).alias("verdict"), "component")


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``pages``."""
    return judge(pages).drop("component")
