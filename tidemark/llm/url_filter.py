"""Allow and block rules on URLs, carried over redirects and canonical links.

A rule names a host with its subdomains and the start of a path; the longest fitting rule decides.  URLs that no
rule fits take the decision of their aliases: URLs with the same canonical form, and those joined by canonical links
or refresh redirects in the pages, by distributed connected components.  Rules judge the targets of links too, whether
they are pages of the table or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, connected_components, cut, let

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: A tag whose attribute says that its target is an alias.
ALIAS = r"""(?i)(?<![\w-])(?:rel\s*+=\s*+(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)|http-equiv\s*+=\s*+["']?\s*+refresh\b)"""
#: Query parameters that don't change what is shown.
TRACKING = r"[?&](utm_[^=&#]*|ref|fbclid|gclid)(=[^&#]*)?(?=[&#]|$)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both '' for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (verdict, rule), or null."""
    picked = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        picked = F.when(fits, value) if picked is None else picked.when(fits, value)
    return picked


def canonical(url: Column) -> Column:
    """The form that aliases share: no scheme, fragment, tracking parameters or closing slash; host in lower case."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    host, path = url_parts(url)
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?]*(\?.*)?$", 1), TRACKING, "")
    query = F.regexp_replace(query, r"^[&?]+", "?")
    return F.when(host == "", F.lit(None).cast("string")).otherwise(F.concat(host, F.regexp_replace(path, r"/$", ""), query))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` parts."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == ".", s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))).otherwise(F.concat(s, F.array(p))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """``target`` as an absolute URL, a relative one seen from ``base``; null if blank or of a scheme without ``//``."""
    root, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), url_parts(base)[1]
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    full = F.when(target.startswith("/"), target).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), target))
    joined = F.concat(root, without_dots(F.regexp_extract(full, r"^([^?#]*)", 1)), F.regexp_extract(full, r"(?s)^[^?#]*(.*)$", 1))
    return (
        F.when(target.rlike(SCHEME + "//"), target).when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when((target == "") | target.rlike(SCHEME), F.lit(None).cast("string")).when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), base).otherwise(joined)
    )


def page_links(html: Column, url: Column) -> Column:
    """Targets of canonical links and refresh redirects as absolute URLs, whatever the order of a tag's attributes.

    Relative targets are seen from the page's ``base``, else from its URL; ``&amp;`` in them is ``&``.  They count only where the attribute says
    canonical or refresh, so that a style sheet ``/canonical.css`` does not join all pages of a site.  A tag ends at the
    next ``>``; one that meets another ``<`` before is none, so that each pattern passes over the html once.
    """
    html = F.coalesce(html, F.lit(""))

    def tags(names: str, holding: str) -> Column:
        return F.filter(F.regexp_extract_all(html, F.lit(rf"(?i)<(?:{names})\b[^<>]*+>"), F.lit(0)), lambda tag: tag.rlike(rf"(?i)\b(?:{holding})"))

    named = F.regexp_extract(F.get(tags("base", r"href\s*="), F.lit(0)), r"(?i)\bhref\s*+=\s*+[\"']?([^\"'>\s]+)", 1)

    def absolute(base: Column, tag: Column) -> Column:
        target = F.regexp_extract(F.regexp_replace(tag, "(?i)&amp;|&#38;|&#x26;", "&"), r"(?i)(?:href\s*+=\s*+[\"']?|url\s*+=\s*+['\"]?)([^\"'>\s]+)", 1)
        return let(target, lambda t: F.when(t.rlike(SCHEME + "//"), t).when(tag.rlike(ALIAS), resolved(t, base)))

    def found(seen: Column) -> Column:
        return F.filter(F.transform(seen["tags"], lambda tag: absolute(seen["base"], tag)), lambda t: t.isNotNull())

    base = let(F.coalesce(named, F.lit("")), lambda b: F.coalesce(resolved(b, url), url))
    return let(F.struct(tags("link|meta", r"canonical\b|refresh\b").alias("tags"), base.alias("base")), found)


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``.

    Without a fitting rule the verdict is the aliases', pages or mere targets of links: allow if any alias is allowed
    by a rule, else block if any is blocked, else allow.  Null URLs and such without ``://`` have empty host and path, no aliases and are allowed.
    Repeated rows are kept; other columns are ignored; null html has no links; html of any length takes time in
    proportion, unclosed tags too; an empty table gives no rows.
    """
    host, path = url_parts(F.col(url_col))
    links = page_links(F.col(html_col), F.col(url_col)) if html_col in pages.columns else F.array().cast("array<string>")
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), canonical(F.col(url_col)).alias("form"), links.alias("links"))
    base = base.withColumn("hit", best_rule(F.col("host"), F.col("path"), rules))
    targets = base.where("form is not null and size(links) > 0").select(F.col("form").alias("src"), F.explode("links").alias("to"))
    edges = targets.select("src", canonical(F.col("to")).alias("dst"), best_rule(*url_parts(F.col("to")), rules)["verdict"].alias("verdict"))
    edges = cut(edges.where("dst is not null and (src <> dst or verdict is not null)").distinct())
    groups = connected_components(edges.where("src <> dst").select("src", "dst"))
    told = base.where("form is not null and hit is not null").select("form", F.col("hit.verdict").alias("verdict"))
    told = told.unionByName(edges.where("verdict is not null").select(F.col("dst").alias("form"), "verdict"))
    told = told.groupBy("form").agg(F.max(F.col("verdict") == "allow").alias("allow"))
    told = told.join(groups.select(F.col("node").alias("form"), "component"), "form", "left").select(F.coalesce("component", "form").alias("alias"), "allow")
    told = told.groupBy("alias").agg(F.max("allow").alias("allow"))
    # rows that a rule decides, or that have no form to look up, need no join and stay out of it
    joined = F.col("form").isNotNull() & F.col("hit").isNull()
    rows = base.drop("links").where(joined).join(groups.select(F.col("node").alias("form"), "component"), "form", "left").withColumn("alias", F.coalesce("component", "form"))
    rows = rows.join(told, "alias", "left").select("page_id", "host", "path", "hit", "allow")
    rows = rows.unionByName(base.where(~joined).select("page_id", "host", "path", "hit", F.lit(None).cast("boolean").alias("allow")))
    other = F.when(~F.coalesce("allow", F.lit(True)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", other).alias("verdict"))
