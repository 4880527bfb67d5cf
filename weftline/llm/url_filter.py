"""Block and allow rules for URLs, carried over redirects and canonical links. DataFrame functions only.

A rule is a host with a path, such as ``example.com/en/``. It fits its host and all
subdomains where the URL's path starts with the rule's path; of several the longest
wins, of equally long ones an allowing one. A page that a rule fits has that rule's
verdict, whatever its aliases say.

Other pages take the verdict of their equivalence class: connected components over
redirects (``<meta http-equiv=refresh>`` and a table of redirects) and canonical
links, all of a page's. Targets are resolved against the page's address or its
``<base href>``, dot segments too. One allowed page in the class allows the rest; else one blocked page blocks
them; else they are allowed. URLs that differ only in scheme, fragment, tracking
parameters or a closing slash are one node from the start.

Defined results: a null URL, or one without ``://``, has an empty host and path, no
aliases and the verdict allow unless a rule fits; an empty html has no links; every
row is judged, also repeated ones; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bound, written
from weftline.llm.components import components

#: Up to so many rules become an expression of every row; more are joined by host.
EXPRESSION_RULES = 200
#: Up to so many rules are broadcast where they are joined.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b[^\">]*\"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
BASE = r"(?is)<base\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The name that a URL shares with its trivial aliases; null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    host = host_of(url)
    plain = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host != "", F.when(query == "", plain).otherwise(F.concat(plain, F.lit("?"), query)))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are carried out."""
    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def carried_out(path: Column) -> Column:
        parts = F.split(F.regexp_replace(path, "^/", ""), "/")
        ends = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
        joined = F.concat(F.lit("/"), F.array_join(F.aggregate(ends, F.array().cast("array<string>"), step), "/"))
        return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)

    return bound(path, carried_out)


def _resolved(place: Column, target: Column) -> Column:
    """A link's target as a whole URL, as seen from a place (host, path); null for what isn't one."""
    def whole(x: Column) -> Column:
        host, path, target = x["host"], x["path"], x["target"]
        root = F.concat(F.lit("http://"), host)
        own = F.regexp_extract(target, "^([^?#]*)", 1)
        rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
        folder = F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)?", 0)).otherwise("/")
        inside = F.when(target.startswith("/"), own).otherwise(F.concat(folder, own))
        return (
            F.when(target == "", None)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("?"), F.concat(root, path, target))
            .when(~target.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.concat(root, _without_dots(inside), rest))
        )

    plain = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return bound(F.named_struct(F.lit("host"), place["host"], F.lit("path"), place["path"], F.lit("target"), plain), whole)


def _place(url: Column) -> Column:
    return F.named_struct(F.lit("host"), host_of(url), F.lit("path"), path_of(url))


def links(pages: DataFrame) -> DataFrame:
    """Rows (source, target) of whole URLs: each page's canonical links and its immediate redirects."""
    def within(tag: str, value: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, value, 1))

    def from_base(place: Column) -> Column:
        base = _resolved(place, F.regexp_extract(F.regexp_extract("html", BASE, 0), HREF, 1))
        return bound(base, lambda b: F.when(b.isNotNull(), _place(b)).otherwise(place))

    found = pages.select("url", "html").where(F.col("html").rlike("(?i)canonical|http-equiv") & (host_of(F.col("url")) != ""))
    targets = F.concat(within(CANONICAL, HREF), within(REFRESH, REFRESH_URL))
    found = found.select("url", bound(_place(F.col("url")), from_base).alias("place"), F.explode(targets).alias("target")).where("target <> ''")
    return found.select(F.col("url").alias("source"), _resolved(F.col("place"), F.col("target")).alias("target")).where("target IS NOT NULL")


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that fits, a struct (rule, action), or null; rules are (action, host, path)."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,action:string>")
    out = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``rows`` (host, path and others) with ``best``, the rule that fits, as ``best_rule`` gives it.

    A long list is joined: each different host and path meets the rules of its host and of
    the domains above it, and keeps the longest whose path fits.
    """
    if len(rules) <= EXPRESSION_RULES:
        return rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "rule_host string, rule_path string, rule string, action string")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    places = rows.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(above).alias("rule_host"))
    fits = places.join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allows"), "rule", "action")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("top")).select("host", "path", F.struct("top.rule", "top.action").alias("best"))
    return rows.join(best, ["host", "path"], "left")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, component), one for each row of ``pages``.

    ``redirects`` may add edges: two URL columns, from and to. Nothing but page_id,
    URL parts and nodes is shuffled; decisions are combined within each task before
    they meet by component.
    """
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = written(with_rules(judged, rules), "url-judged")

    hops = links(pages)
    if redirects is not None:
        a, b = redirects.columns[:2]
        hops = hops.union(redirects.select(F.col(a).cast("string"), F.col(b).cast("string")))
    hops = hops.select(F.array("source", "target").alias("ends"), node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v"))
    hops = written(hops.where("u IS NOT NULL AND v IS NOT NULL").distinct(), "url-hops")
    linked = hops.head(1)
    edges = hops.select("u", "v")
    classes = components(edges) if linked else edges.selectExpr("u AS node", "v AS component")

    # rules also fit the ends of links that aren't pages themselves
    ends = hops.select(F.explode("ends").alias("url")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ends = with_rules(ends, rules).select("node", "best")
    by_node = judged.select("node", "best").union(ends).where("best IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.bool_or(F.col("best.action") == "allow").alias("allows"))
    by_class = by_node.join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.bool_or("allows").alias("allows"))
    blocked = by_class.where("NOT allows").select(F.col("component").alias("_blocked"))

    # both tables grow with the input, so they are merged and never broadcast; only
    # pages with a node and without a rule of their own depend on the blocked classes
    named = judged.where("node IS NOT NULL").join(classes.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nameless = judged.where("node IS NULL").withColumn("component", F.lit(None).cast("string"))
    ruled = named.where("best IS NOT NULL").unionByName(nameless).withColumn("_blocked", F.lit(None).cast("string"))
    open_ = named.where("best IS NULL").join(blocked.hint("merge"), F.col("component") == F.col("_blocked"), "left")
    out = ruled.unionByName(open_)
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "component")


#: The rules of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _sql() -> str:
    def part(expression: str, pattern: str, group: int) -> str:
        return f"regexp_extract({expression}, '{pattern}', {group})"

    def parts(url: str, name: str) -> str:
        rest = f"CASE WHEN {url} LIKE '%://%' THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
        host = f"translate({part(rest, '^[^/?#]*', 0)}, '{UPPER}', '{LOWER}')"
        path = part(rest, "^[^/?#]*([^?#]*)", 1)
        query = f"regexp_replace(regexp_replace({part(rest, r'^[^?#]*\?([^#]*)', 1)}, '{TRACKING}', '', 'g'), '^&', '')"
        return f"{host} AS {name}host, {path} AS {name}path, {query} AS {name}query"

    def node(name: str) -> str:
        return f"CASE WHEN {name}host <> '' THEN {name}host || regexp_replace({name}path, '/+$', '') || CASE WHEN {name}query = '' THEN '' ELSE '?' || {name}query END END"

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    def without_dots(path: str) -> str:
        segments = f"string_split(regexp_replace({path}, '^/', ''), '/') || CASE WHEN regexp_matches({path}, '(^|/)[.][.]?$') THEN [''] ELSE [] END"
        kept = f"list_reduce({segments}, lambda k, s: CASE WHEN s = '..' THEN regexp_replace(k, '/[^/]*$', '') WHEN s = '.' THEN k ELSE k || '/' || s END, '')"
        return f"CASE WHEN regexp_matches({path}, '(^|/)[.][.]?(/|$)') THEN CASE WHEN {kept} = '' THEN '/' ELSE {kept} END ELSE {path} END"

    own, rest = "regexp_extract(t2, '^([^?#]*)', 1)", "regexp_extract(t2, '^[^?#]*(.*)$', 1)"
    folder = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)?', 0) ELSE '/' END"
    resolved = (
        "CASE WHEN t2 = '' THEN NULL WHEN regexp_matches(t2, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t2 WHEN starts_with(t2, '//') THEN 'http:' || t2 "
        f"WHEN starts_with(t2, '?') THEN 'http://' || host || path || t2 WHEN starts_with(t2, '/') THEN 'http://' || host || {without_dots(own)} || {rest} "
        f"WHEN NOT regexp_matches(t2, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN 'http://' || host || {without_dots(f'(({folder}) || {own})')} || {rest} END"
    )
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {rules}),
parts AS (SELECT row_number() OVER () AS n, page_id, url, html, {parts('url', '')} FROM pages),
judged AS (SELECT *, {node('')} AS node FROM parts),
fits AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM judged JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
linked AS (SELECT *, regexp_extract(regexp_extract(html, '{quoted(BASE)}', 0), '{quoted(HREF)}', 1) AS t FROM judged WHERE host <> ''),
based AS (SELECT *, {resolved} AS base FROM (SELECT *, replace(t, '&amp;', '&') AS t2 FROM linked)),
seen AS (SELECT n, node, html, {parts("coalesce(base, url)", 'b')} FROM based),
links AS (SELECT node, bhost AS host, bpath AS path, unnest(list_transform(regexp_extract_all(html, '{quoted(CANONICAL)}', 0), lambda x: regexp_extract(x, '{quoted(HREF)}', 1))) AS t FROM seen
  UNION ALL SELECT node, bhost, bpath, unnest(list_transform(regexp_extract_all(html, '{quoted(REFRESH)}', 0), lambda x: regexp_extract(x, '{quoted(REFRESH_URL)}', 1))) FROM seen),
whole AS (SELECT node, {resolved} AS target FROM (SELECT *, replace(t, '&amp;', '&') AS t2 FROM links WHERE t <> '')),
targets AS (SELECT node AS u, {parts('target', 't')} FROM whole WHERE target IS NOT NULL AND node IS NOT NULL),
ended AS (SELECT *, {node('t')} AS v FROM targets),
edges AS (SELECT u, v FROM ended WHERE v IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (SELECT DISTINCT node, node FROM judged WHERE node IS NOT NULL UNION SELECT v, v FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
classes AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
actions AS (SELECT node, action FROM judged JOIN fits USING (n) UNION ALL
  SELECT v, arg_max(action, length(rule_host || rule_path)) FROM ended JOIN rules ON (thost = rule_host OR ends_with(thost, '.' || rule_host)) AND starts_with(tpath, rule_path) GROUP BY v, thost, tpath),
decided AS (SELECT component, bool_or(action = 'allow') AS allows FROM actions JOIN classes USING (node) GROUP BY component)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN allows THEN 'allow' WHEN NOT allows THEN 'block' ELSE 'allow' END) AS verdict, component
FROM judged LEFT JOIN fits USING (n) LEFT JOIN classes USING (node) LEFT JOIN decided USING (component)"""


SQL = _sql()
