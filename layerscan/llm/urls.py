"""URL filters with redirect equivalence, in DataFrame operations alone.

Rules name a host with its subdomains and a prefix of the path; the longest one
that fits a URL decides. URLs joined by canonical links and page redirects are
aliases: connected components over these edges carry a block to every alias
that no rule decides. An explicit allow of a URL itself always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerscan.llm.components import components
from layerscan.session import materialize

#: Fixed by the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules are literals of the plan; longer lists do not fit one.
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_of(url: Column) -> Column:
    """Host, path and query: what names a page, whatever the scheme and fragment; null if there is no host."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    name = F.concat(host_of(url), rest)
    return F.when(~name.rlike("^([/?]|$)"), name)


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none. Allow wins a tie."""
    rules = sorted(set(rules), key=lambda r: (-len(r[1]), r[0], r[1]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    found = None
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` from pages to the targets of their canonical links and redirects."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    told = materialize(
        pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", F.explode(tags).alias("tag")), "tags"
    )
    canonical = F.col("tag").rlike(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = F.col("tag").rlike(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b")
    link = F.when(canonical, F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)).when(
        refresh, F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    )
    links = told.select("url", F.replace(link, F.lit("&amp;"), F.lit("&")).alias("link")).where("link != '' and link not like '#%'")
    # A link without a host is resolved against the page's URL.
    whole = (
        F.when(F.instr("link", "://") > 0, F.col("link"))
        .when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link"))
        .when(F.col("link").startswith("/"), F.concat(F.regexp_extract("url", "^([^:/?#]*://[^/?#]*)", 1), "link"))
        .otherwise(F.concat(F.regexp_extract("url", "^([^:/?#]*://[^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", "^[^:/?#]*://[^/?#]*/([^?#]*/)?", 1), "link"))
    )
    # Written before it is filtered: else the filters would repeat these expressions.
    pairs = links.select("url", whole.alias("target")).select(page_of(F.col("url")).alias("a"), page_of(F.col("target")).alias("b"))
    return materialize(pairs, "aliases").where("a != b")


def judge_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row of ``pages``.

    The verdict is the rule's; without one, block if a blocked URL is an alias,
    else allow. ``edges`` are more alias edges between pages (``page_of``). A
    null URL, or one without ``://``, has an empty host and path, no rule and no
    alias, and is allowed. A null html tells of no alias.
    """
    links = alias_edges(pages)
    links = links if edges is None else links.unionByName(edges.select("a", "b"))
    named = components(links)
    parts = named.select(
        "component",
        F.regexp_extract("node", "^([^/?]*)", 1).alias("host"),
        F.regexp_extract("node", "^[^/?]*([^?]*)", 1).alias("path"),
    )
    blocked = (
        parts.select("component", rule_for(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
        .where("verdict = 'block'").select("component").distinct()
    )
    aliases = named.join(blocked, "component", "left_semi").select("node", F.lit(True).alias("blocked"))
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), page_of(url).alias("node"))
    seen = seen.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow"))
    return seen.join(aliases, "node", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


#: Rule verdicts in DuckDB SQL, with aliases by canonical links and redirects of absolute URLs.
ORACLE = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), seen AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
  FROM parts
), tags AS (
  SELECT host || path || query AS a,
    unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>')) AS tag
  FROM seen WHERE host <> ''
), targets AS (
  SELECT a, replace(regexp_extract(tag, '(?i)\b(?:href|url)\s*=\s*["'']?[a-z]+://([^"''\s>]+)', 1), '&amp;', '&') AS rest FROM tags
), edges AS (
  SELECT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b
  FROM targets WHERE rest <> ''
), ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (
  SELECT DISTINCT a AS node, regexp_extract(a, '^([^/?#]*)', 1) AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM ways
), rules(verdict, rule, name, prefix) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), reach(node) AS (
  SELECT node FROM (
    SELECT node, arg_max(verdict, length(rule)) AS verdict FROM nodes JOIN rules
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY node
  ) WHERE verdict = 'block'
  UNION SELECT b FROM reach JOIN ways ON a = node
), found AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM seen) JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
  GROUP BY host, path
)
SELECT s.page_id, s.host, s.path, f.rule,
  coalesce(f.verdict, CASE WHEN s.host <> '' AND s.host || s.path || s.query IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END) AS verdict
FROM seen s LEFT JOIN found f ON f.host = s.host AND f.path = s.path
"""
