"""URL filters with redirect equivalence, in DataFrame expressions only.

A rule names a host suffix and the start of a path; the longest rule that fits a url decides.
Urls that no rule fits take the decision of their aliases: redirects (meta refresh) and
canonical links found in the html, and edges of a given table, tie urls together, and a
connected component with a blocked url is blocked. An allow rule that fits a url itself
always holds for that url, whatever its aliases are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm.common import read, stored
from quarrylink.llm.components import connected_components

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits (longest host and path, then the first named), or null."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def node(url: Column) -> Column:
    """What stands for a url in the graph: scheme and host in lower case, no fragment, at least / as path."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host(url), rest))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a url of its own: absolute, //host, /path and relative forms."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: nodes of pages and of the canonical links and redirects in their html."""
    body = F.col(html)
    p = pages.select(F.col(url).alias("u"), body.alias("h")).filter(F.col("u").contains("://") & body.rlike("(?i)canonical|refresh"))
    p = p.select("u", F.explode(F.concat(F.regexp_extract_all("h", F.lit(_LINK), F.lit(1)), F.regexp_extract_all("h", F.lit(_REFRESH), F.lit(1)))).alias("to"))
    return p.select(node(F.col("u")).alias("a"), node(absolute(F.col("to"), F.col("u"))).alias("b"))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component``: one row per page.

    ``redirects`` may add edges (``source, target`` urls). A component is blocked if a rule
    blocks the url of one of its nodes, be it a page or only a link's target. Pages that no
    rule fits are blocked if their component is, and else allowed; so are null and malformed
    urls, which have an empty host and path. Null html has no links. Repeated rows get
    equal results; extra columns are ignored; an empty table gives no rows.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    edges = link_edges(p)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node(F.col("source")), node(F.col("target"))))
    tied = connected_components(stored(edges.filter("a is not null and b is not null").distinct(), "links"))
    tied = tied.select("node", "component", (rule(host(F.col("node")), path(F.col("node")), rules)["verdict"] == "block").alias("bad"))
    blocked = tied.filter("bad").select("component").distinct()
    members = tied.join(blocked.withColumn("blocked", F.lit(True)), "component", "left").select("node", "component", F.coalesce("blocked", F.lit(False)).alias("blocked"))
    members = stored(members, "link-components")
    judged = p.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("of"))
    judged = judged.withColumn("r", rule(F.col("host"), F.col("path"), rules)).join(members, F.col("of") == F.col("node"), "left")
    verdict = F.coalesce("r.verdict", F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return judged.select(F.col("page_id").alias(page_id), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the fixed rules, with the links that their html holds."""
    return judge(read(spark, sf_dir, "pages")).drop("component")
