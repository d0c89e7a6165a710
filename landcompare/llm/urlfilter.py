"""URL filter with redirect equivalence, in DataFrame operations only.

Rules name a host with its subdomains and the start of a path; the longest that fits
decides a url. Redirects and canonical links (``link rel=canonical`` and ``meta refresh``
of the pages, and redirects observed elsewhere, if given) join urls to classes by
distributed connected components. A url without a rule of its own takes the decision of
its class: allow if any of its aliases is allowed, else block if any is blocked, else
allow. A url's own rule always stands.

Two urls are the same node if they differ in scheme, case of the host, fragment or an
empty path at most.

Rows: a null url or one without ``://`` has empty host and path, fits no rule and is
allowed; null ids stay, repeated rows each get their verdict, an empty table gives an
empty result, other columns are ignored. Null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import lower_ascii, stored, table
from landcompare.operators.components import connected_components

# The rules of the registered query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

LINK_TAG = r"(?i)<link\s[^>]*>"
CANONICAL = r"(?i)\srel\s*=\s*(?:\"(?:[^\"]*\s)?canonical[\"\s]|'(?:[^']*\s)?canonical['\s]|canonical[\s/>])"  # any token of rel
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?i)<meta\s[^>]*>"
REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
TARGET = r"(?i)[;,\s\"']url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: what is the same behind scheme and fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def resolved(base: Column, href: Column) -> Column:
    """The absolute url of a link; null if it is none (mail, script and the like)."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?://)", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    href = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(scheme, "//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (href == "") | href.startswith("#"), F.lit(None))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def straight(url: Column) -> Column:
    """The url without the segments ``.`` and ``..`` of its path."""
    root, path, rest = (F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 2, 3))
    segments = F.split(F.substr(path, F.lit(2)), "/")

    def step(done: Column, segment: Column) -> Column:
        back = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == ".", done).when(segment == "..", back).otherwise(F.concat(done, F.array(segment)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(root, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and refresh of the pages."""
    tags = pages.select(
        F.col("url"),
        F.filter(F.regexp_extract_all("html", F.lit(LINK_TAG), 0), lambda t: t.rlike(CANONICAL)).alias("canonical"),
        F.filter(F.regexp_extract_all("html", F.lit(META_TAG), 0), lambda t: t.rlike(REFRESH)).alias("refresh"),
    )
    hrefs = F.concat(
        F.transform("canonical", lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform("refresh", lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    found = tags.where("size(canonical) > 0 OR size(refresh) > 0").select("url", F.explode(hrefs).alias("href"))
    return found.where("url LIKE '%://%'").select("url", straight(resolved(F.col("url"), F.col("href"))).alias("target")).where("target LIKE '%://%'")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_host, rule_path, rule, action) from (action, host/path)."""
    rows = [(rule[: rule.index("/")], rule[rule.index("/") :], rule, action) for action, rule in rules]
    return spark.createDataFrame(rows, "rule_host STRING, rule_path STRING, rule STRING, action STRING")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and the rule that decides each: columns rule, action; null if none fits.

    Rules meet the distinct hosts, over their suffixes, so a host that many urls share is joined once.
    Of rules of one length allow comes before block.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    ranked = F.struct(F.length("rule").alias("size"), (F.col("action") == "allow").alias("allows"), "rule", "rule_path", "action")
    fitting = hosts.join(rules, "rule_host").groupBy("host").agg(F.collect_set(ranked).alias("fitting"))
    best = F.array_max(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return urls.join(fitting, "host", "left").withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def class_actions(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, class_action, class_id) of every url in a redirect or canonical link (url, target)."""
    edges = stored(edges.select("url", "target", node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")), "url-links")
    classes = stored(connected_components(edges.select("a", "b")), "url-classes")
    ends = edges.select("url", F.col("a").alias("node")).unionByName(edges.select(F.col("target").alias("url"), F.col("b").alias("node")))
    ends = ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    decided = with_rules(ends, rules).where("action IS NOT NULL").join(classes, "node")
    # 'allow' sorts before 'block'.
    actions = decided.groupBy("component").agg(F.min("action").alias("class_action"))
    return classes.join(actions, "component", "left").select("node", "class_action", F.col("component").alias("class_id"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, class_id) of every page; ``redirects`` are more (url, target)."""
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links(urls)
    if redirects is not None:
        edges = edges.unionByName(redirects.where("url LIKE '%://%' AND target LIKE '%://%'").select("url", "target"))
    parts = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = with_rules(parts, rules).join(class_actions(edges, rules), "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", "class_action", F.lit("allow")).alias("verdict"), "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES)).drop("class_id")


# The same in DuckDB's SQL. Aliases are followed by a recursive query.
_HOST = "translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_REST = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_NODE = f"{_HOST} || CASE WHEN starts_with({_REST}, '/') THEN '' ELSE '/' END || {_REST}"
_FITS = "(host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)"


def _in_sql() -> str:
    rows = ", ".join(f"('{rule[: rule.index('/')]}', '{rule[rule.index('/') :]}', '{rule}', '{action}')" for action, rule in RULES)
    quoted = {name: pattern.replace("'", "''") for name, pattern in (("tag", LINK_TAG), ("rel", CANONICAL), ("href", HREF), ("meta", META_TAG), ("refresh", REFRESH), ("to", TARGET))}
    best = "(SELECT arg_max({c}, length(rule) * 2 + CAST(action = 'allow' AS INT)) FROM rules WHERE " + _FITS + ")"
    return f"""
WITH RECURSIVE rules(rule_host, rule_path, rule, action) AS (VALUES {rows}),
parts AS (SELECT page_id, url, html, coalesce({_HOST.format(u="url")}, '') AS host, coalesce({_PATH.format(u="url")}, '') AS path,
  {_NODE.format(u="url")} AS node FROM pages),
hrefs AS (
  SELECT url, regexp_extract(tag, '{quoted["href"]}', 1) AS href
  FROM (SELECT url, unnest(regexp_extract_all(html, '{quoted["tag"]}')) AS tag FROM pages) WHERE regexp_matches(tag, '{quoted["rel"]}')
  UNION ALL SELECT url, regexp_extract(tag, '{quoted["to"]}', 1)
  FROM (SELECT url, unnest(regexp_extract_all(html, '{quoted["meta"]}')) AS tag FROM pages) WHERE regexp_matches(tag, '{quoted["refresh"]}')),
targets AS (
  SELECT url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN split_part(url, '//', 1) || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || href
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR href = '' OR starts_with(href, '#') THEN NULL
    WHEN starts_with(href, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || href
    ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' || href END AS target
  FROM (SELECT url, replace(trim(href), '&amp;', '&') AS href FROM hrefs) WHERE url LIKE '%://%'),
steps AS (
  SELECT url, target, regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1) AS root, {_PATH.format(u="target")} AS path,
    regexp_extract(target, '(?s)^.*?://[^?#]*(.*)$', 1) AS rest FROM targets),
straight AS (
  SELECT url, CASE WHEN regexp_matches(path, '/\\.\\.?(/|$)') THEN root || '/' || array_to_string(list_concat(
      list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(path[2:], '/'), lambda p: [p])),
        lambda done, p: CASE p[1] WHEN '.' THEN done WHEN '..' THEN done[1 : len(done) - 1] ELSE list_concat(done, p) END),
      CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN [''] ELSE [] END), '/') || rest ELSE target END AS target FROM steps),
ends AS (SELECT url, target, {_NODE.format(u="url")} AS a, {_NODE.format(u="target")} AS b FROM straight WHERE target LIKE '%://%'),
pairs AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(node, other) AS (SELECT a, a FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
nodes AS (SELECT DISTINCT node, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path
  FROM (SELECT url, a AS node FROM ends UNION ALL SELECT target, b FROM ends)),
acts AS (SELECT node, {best.format(c="action")} AS action FROM nodes),
classes AS (SELECT reach.node, min(action) AS class_action FROM reach JOIN acts ON reach.other = acts.node GROUP BY reach.node),
judged AS (SELECT *, {best.format(c="rule")} AS rule, {best.format(c="action")} AS action FROM parts)
SELECT page_id, host, path, rule, coalesce(action, class_action, 'allow') AS verdict FROM judged LEFT JOIN classes USING (node)"""


SQL = _in_sql()
