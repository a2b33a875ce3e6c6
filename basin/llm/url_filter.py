"""URL filters with redirect equivalence.

A rule (verdict, host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with
the rule's; of several the longest host and path win (then the longest host, then the first in order).

Pages that redirect to each other (``<meta http-equiv="refresh">``) or name a canonical address
(``<link rel="canonical">``) are one resource. Their addresses, without scheme, fragment and A-Z case of the
host, with dot segments resolved and ``/`` for an empty path, are nodes of a graph; its connected components are found with distributed joins. A url without a rule is blocked if any
address of its component is blocked by a rule. Explicit rules come first: a url under an allow rule stays
allowed, whatever its aliases are, and an allow rule is not passed on.

Few rules (``INLINE_RULES`` at most) are tested inside the scan, without a shuffle; more are joined by host
suffix.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule, is no node and is
allowed; null html has no links, nor have comments; relative link targets are resolved against the page's url (RFC 3986; a ``<base>``
is not read), those with a scheme but no host (``mailto:``) are no links; a target without a
page still connects its pages and may be blocked by a rule itself; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.llm.components import components

INLINE_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _without_dots(p: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved (RFC 3986, 5.2.4); an empty one is ``/``."""
    parts = F.split(p, "/")
    parts = F.concat(parts, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array()))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    return F.when(p == "", "/").otherwise(F.array_join(kept, "/"))


def _address(h: Column, p: Column, query: Column) -> Column:
    return F.when(h != "", F.concat(h, _without_dots(p), query))


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def _node(url: Column) -> Column:
    """Address of a url in the redirect graph; null without a host."""
    return _address(host(url), path(url), _query(url))


def _target(to: Column, base: Column) -> Column:
    """Address of a link found in the page at ``base``, resolved as in RFC 3986, 5.2.2; null if it has no host."""
    p, query = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own = F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), r"(?s)[^/]*$", ""))
    return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), _node(to))
            .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .when(to.startswith("//"), _node(F.concat(F.lit("x:"), to)))
            .when(p.startswith("/"), _address(host(base), p, query))
            .when(p != "", _address(host(base), F.concat(own, p), query))
            .otherwise(_address(host(base), path(base), F.when(query != "", query).otherwise(_query(base)))))


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, without quotes and outer blanks, ``&`` written out; empty if missing."""
    found = F.concat(*[F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*{value}""", 1)
                       for value in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")])
    return F.regexp_replace(F.regexp_replace(found, r"^\s+|\s+$", ""), "(?i)&(?:amp|#38|#x26);", "&")


def _fits(h: Column, p: Column, rule_host: str, rule_path: str) -> Column:
    return ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)


def matched(urls: DataFrame, rules: list[tuple[str, str, str]], keys: list[str], inline_rules: int = INLINE_RULES) -> DataFrame:
    """``keys`` of ``urls`` (unique, with host and path) with the winning rule and its verdict, null if none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0]))
    if len(order) <= inline_rules:
        rule = verdict = F.lit(None).cast("string")
        for v, h, p in reversed(order):
            fits = _fits(F.col("host"), F.col("path"), h, p)
            rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
        return urls.select(*keys, rule.alias("rule"), verdict.alias("rule_verdict"))
    table = urls.sparkSession.createDataFrame(
        [(i, v, h, p) for i, (v, h, p) in enumerate(order)], "at int, verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(
        ".", F.slice(labels, i, F.size(labels))))
    hits = urls.select(*keys, "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").filter(
        F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy(*keys).agg(F.min(F.struct("at", F.concat("rule_host", "rule_path").alias("rule"),
                                                  "verdict")).alias("best"))
    return urls.select(*keys).join(best, keys, "left").select(
        *keys, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses joined by a canonical link or a redirect of the page at ``a``."""
    page = F.regexp_replace(F.col(html), r"(?s)<!--.*?(?:-->|$)", " ")
    tags = F.regexp_extract_all(page, F.lit(r"""(?is)<(?:link|meta)\b(?:[^>"']++|"[^"]*"|'[^']*')*+>"""), F.lit(0))
    tag = F.col("tag")
    refresh = F.regexp_extract(_attribute(tag, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"']*)""", 1)
    to = F.when(tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), _attribute(tag, "href")
                ).when(tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), F.rtrim(refresh))
    found = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv")).select(
        F.col(url).alias("from"), F.explode(tags).alias("tag")).select("from", to.alias("to")).filter("to <> ''")
    return found.select(_node(F.col("from")).alias("a"), _target(F.col("to"), F.col("from")).alias("b")).filter(
        "a IS NOT NULL AND b IS NOT NULL")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url",
          html: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) of every page."""
    reach = components(alias_links(pages, url, html))
    split = F.concat(F.lit("x://"), F.col("node"))
    nodes = reach.withColumn("host", host(split)).withColumn("path", path(split))
    ruled = matched(nodes, rules, ["node", "component"])
    blocked = ruled.filter("rule_verdict = 'block'").select("component").distinct()
    tainted = ruled.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    rows = pages.select(F.col(id_col).alias("_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"),
                        _node(F.col(url)).alias("node"))
    if len(rules) <= INLINE_RULES:
        judged = matched(rows, rules, ["_id", "host", "path", "node"])
    else:
        judged = rows.join(matched(rows.select("host", "path").distinct(), rules, ["host", "path"]), ["host", "path"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return judged.join(tainted, "node", "left").select(F.col("_id").alias(id_col), "host", "path", "rule",
                                                        verdict.alias("verdict"))
