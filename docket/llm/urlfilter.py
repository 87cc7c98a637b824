"""URL filters with redirect equivalence.

Rules judge urls by host and path. Pages whose urls are redirects or canonical
links of one another are aliases: connected components over those edges carry a
block to every alias without a rule of its own. An explicit allow rule keeps its
page allowed whatever its aliases are.

A page's own canonical form joins it to pages that differ in scheme, fragment,
final slash or tracking arguments only; ``<link rel=canonical>``, a ``<meta
http-equiv=refresh>`` redirect, and rows of a redirects table are the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.columns import numbered
from docket.llm.components import connected_components
from docket.session import cut

MAX_RULES = 1000
TRACKING = r"(^|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*"
CANONICAL = r"(?is)<link\s[^>]*rel\s*=\s*[\"']?canonical[\"']?[^>]*>"
REFRESH = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"']?[^>]*>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host: after the first :// up to /, ?, # or the end; else empty."""
    raw = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """The form that aliases by spelling share; null without a host."""
    query = F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", key)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; an allow wins a tie."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of the canonical links and redirects that pages declare."""
    tags = F.concat(F.regexp_extract_all(F.col(html_col), F.lit(CANONICAL), F.lit(0)), F.regexp_extract_all(F.col(html_col), F.lit(REFRESH), F.lit(0)))
    told = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(tags).alias("tag"))
    href = F.coalesce(F.nullif(F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")), F.nullif(F.regexp_extract("tag", r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")))
    told = told.withColumn("href", href).where(F.col("href").isNotNull() & F.col("url").isNotNull())
    site = F.regexp_extract("url", r"^(?s)(.*?://[^/?#]*)", 1)
    here = F.regexp_extract("url", r"^(?s)(.*?://[^?#]*/)", 1)
    target = (
        F.when(F.col("href").contains("://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href")))
        .when(F.col("href").startswith("/"), F.concat(site, F.col("href")))
        .otherwise(F.concat(F.coalesce(F.nullif(here, F.lit("")), F.concat(site, F.lit("/"))), F.col("href")))
    )
    return told.select("url", target.alias("target"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict and alias (the smallest spelling of its component).

    A null url, or one without ://, has empty host and path, no rule, no alias,
    and is allowed. Null html declares no link. Repeated urls are judged alike.
    An empty table gives an empty one. Input columns with the new names are
    replaced; others pass, whatever their names are.
    """
    data, place = numbered(pages)
    kept = {c: d for c, d in place.items() if c not in ("host", "path", "rule", "verdict", "alias")}
    url, html = place[url_col], place[html_col]
    told = links(data, url, html)
    if redirects is not None:
        told = told.union(redirects.select("url", "target"))
    told = cut(told.select(F.col("url"), F.col("target"), alias_key(F.col("url")).alias("u"), alias_key(F.col("target")).alias("v")).where("u is not null and v is not null"))
    roots = connected_components(told.select("u", "v"))
    urls = data.select(F.col(url).alias("url")).union(told.select("target"))
    own = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    blocked = urls.where(own["verdict"] == "block").select(alias_key(F.col("url")).alias("node")).where("node is not null").distinct()
    blocked = blocked.join(roots, "node", "left").select(F.coalesce("component", "node").alias("alias")).distinct().withColumn("blocked", F.lit(True))
    out = data.select(*kept.values(), F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), alias_key(F.col(url)).alias("key")).alias("u"))
    out = out.withColumn("r", rule_of(F.col("u.host"), F.col("u.path"), rules))
    out = out.join(roots, out["u.key"] == roots["node"], "left").withColumn("alias", F.coalesce("component", "u.key"))
    out = out.join(blocked, "alias", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(d).alias(c) for c, d in kept.items()], F.col("u.host").alias("host"), F.col("u.path").alias("path"), F.col("r.rule").alias("rule"), verdict.alias("verdict"), "alias")
