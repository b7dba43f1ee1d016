"""URL filters with redirect equivalence.

Rules name a host with all its subdomains and a beginning of the path; the longest that fits decides. Urls that no rule
decides take their verdict from their aliases: urls are linked by canonical links, by refresh redirects, and by having the
same normal form, and the connected components of these links are found over the whole table. A component with an
explicitly allowed url is allowed, else one with a blocked url is blocked, else the default holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldquery.llm.common import ascii_lower, components, forget, table, written

ALLOW, BLOCK = "allow", "block"
RULES: list[tuple[str, str]] = [(ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/")]
# Query parameters that only track a visitor.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sid|session|sessionid)(=|$)"
_CANONICAL = r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*>"""
_HREF = r"""(?i)\bhref=["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv=["']?refresh["']?[^>]*>"""
_URL = r"""(?i)\burl\s*=\s*['"]?([^"'\s>]+)"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """What aliases of one address share: no scheme, www., fragment, tracking parameters, trailing slash or .html."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda q: ~q.rlike(TRACKING)), "&")
    place = F.regexp_replace(F.regexp_replace(path(url), r"(/index)?\.html?$", ""), "/+$", "")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def rule_of(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The index of the longest rule that fits, or null. Of rules of equal length the first holds."""
    fits = lambda h, p: ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
    cases = [F.when(fits(r.partition("/")[0], "/" + r.partition("/")[2]), F.lit(i)) for i, (_, r) in sorted(enumerate(rules), key=lambda x: -len(x[1][1]))]
    return F.coalesce(*cases, F.lit(None).cast("int"))


def rules_for(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own): the longest rule that fits each place, by a join on the host's suffixes.

    rules (rule, verdict), of any number: one row for each suffix of a host meets the rules of that very host. Of equal
    rules the one that allows holds. Places without a rule are left out.
    """
    named = rules.select("rule", F.col("verdict").alias("own"), F.substring_index("rule", "/", 1).alias("suffix"), F.regexp_replace("rule", "^[^/]*/?", "/").alias("start"))
    labels = F.split("host", "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(named, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("own") == ALLOW).alias("allows"), "rule", "own")).alias("b")
    return met.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.own")


def resolved(url: Column, to: Column) -> Column:
    """The address that a page names, in full: null for one that is no page's, or is the page itself."""
    scheme = F.regexp_extract(url, "^([^:]*)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), "[^/]*$", "")
    steps = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_extract(to, "^([^?#]*)", 1)), "/", -1)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    relative = F.concat(site, F.array_join(walked, "/"), F.regexp_extract(to, "^[^?#]*(.*)$", 1))
    return (
        F.when(to.contains("://"), to).when(to.rlike(_SCHEME), F.lit(None)).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path(url), to)).when(to.startswith("#"), F.lit(None)).otherwise(relative)
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) between normal forms: from each page to the targets that its html names, as far as these are addresses."""
    canonical = F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _URL, 1)
    out = pages.where("url is not null and html is not null").select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> '' and url like '%://%'")
    full = resolved(F.col("url"), F.replace("to", F.lit("&amp;"), F.lit("&")))
    return out.select(normal(F.col("url")).alias("src"), full.alias("full")).where("full is not null").select("src", normal(F.col("full")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, default: str = ALLOW) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict, alias (the component's smallest normal form).

    rules: a short list becomes one expression; a table (rule, verdict) of any length is joined. A null url or one without
    :// has an empty host and path, no rule and no alias, and the default verdict; a null html names no targets. Repeated
    rows are each judged; other columns are ignored; an empty table gives no rows.
    """
    url = F.col("url")
    told = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.when(url.contains("://"), normal(url)).alias("node"))
    if isinstance(rules, DataFrame):
        told = told.join(rules_for(told, rules), ["host", "path"], "left")
    else:
        n = F.col("_i")
        pick = lambda k: reduce(lambda a, i: F.when(n == i, F.lit(rules[i][k])).otherwise(a), range(len(rules)), F.lit(None).cast("string"))
        told = told.withColumn("_i", rule_of(F.col("host"), F.col("path"), rules)).withColumn("rule", pick(1)).withColumn("own", pick(0)).drop("_i")
    found = written(links(pages), "links")
    root = components(found)
    forget(found)
    placed = told.join(root.withColumnRenamed("id", "node"), "node", "left").withColumn("alias", F.coalesce("root", "node")).drop("root")
    held = placed.where("own is not null and alias is not null").groupBy("alias").agg(F.max(F.col("own") == ALLOW).alias("allowed"))
    out = placed.join(held, "alias", "left")
    heard = F.when(F.col("allowed"), ALLOW).when(~F.col("allowed"), BLOCK).otherwise(default)
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", heard).alias("verdict"), "alias")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page judged by the five rules and its aliases."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    h = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    q = lambda u: f"array_to_string(list_filter(string_split(regexp_extract(coalesce({u}, ''), '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: NOT regexp_matches(x, '{TRACKING}')), '&')"
    norm = lambda u: f"regexp_replace({h(u)}, '^www\\.', '') || regexp_replace(regexp_replace({p(u)}, '(/index)?\\.html?$', ''), '/+$', '') || CASE WHEN {q(u)} <> '' THEN '?' || {q(u)} ELSE '' END"
    quoted = lambda s: s.replace("'", "''")
    fits = [(r, v, f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')") for v, r in sorted(RULES, key=lambda x: -len(x[1]))]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for r, _, f in fits)
    own = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v, _ in fits)
    return f"""
WITH RECURSIVE raw AS (
  SELECT url, replace(regexp_extract(regexp_extract(html, '{quoted(_CANONICAL)}', 0), '{quoted(_HREF)}', 1), '&amp;', '&') AS t FROM pages WHERE contains(url, '://') AND html IS NOT NULL
  UNION ALL SELECT url, replace(regexp_extract(regexp_extract(html, '{quoted(_REFRESH)}', 0), '{quoted(_URL)}', 1), '&amp;', '&') FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
placed_ AS (SELECT url, t, regexp_extract(url, '^([^:]*)://', 1) AS scheme, regexp_extract(url, '^([^:]*)://', 1) || '://' || {h("url")} AS site, regexp_replace({p("url")}, '[^/]*$', '') AS folder FROM raw WHERE t <> ''),
full_ AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN regexp_matches(t, '{_SCHEME}') THEN NULL WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || {p("url")} || t WHEN starts_with(t, '#') THEN NULL
    ELSE site || array_to_string(list_reduce(list_transform(string_split(CASE folder WHEN '' THEN '/' ELSE folder END || regexp_extract(t, '^([^?#]*)', 1), '/'), lambda x: [x]),
      lambda a, x: CASE x[1] WHEN '.' THEN a WHEN '..' THEN list_slice(a, 1, greatest(len(a) - 1, 1)) ELSE a || x END), '/') || regexp_extract(t, '^[^?#]*(.*)$', 1) END AS t FROM placed_),
e AS (SELECT DISTINCT {norm("url")} AS a, {norm("t")} AS b FROM full_ WHERE t IS NOT NULL),
linked AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM e WHERE a <> '' AND b <> '' AND a <> b),
walk AS (SELECT a AS id, a AS root FROM linked UNION SELECT linked.b, walk.root FROM walk JOIN linked ON linked.a = walk.id),
comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
told AS (SELECT page_id, {h("url")} AS host, {p("url")} AS path, CASE WHEN contains(url, '://') THEN {norm("url")} END AS node FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule FROM told),
placed AS (SELECT r.*, CASE rule {own} END AS own, coalesce(c.root, r.node) AS alias FROM ruled r LEFT JOIN comp c ON c.id = r.node),
held AS (SELECT alias, max(CASE WHEN own = 'allow' THEN 1 ELSE 0 END) AS allowed FROM placed WHERE own IS NOT NULL AND alias IS NOT NULL GROUP BY alias)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.own, CASE allowed WHEN 1 THEN 'allow' WHEN 0 THEN 'block' ELSE 'allow' END) AS verdict, p.alias
FROM placed p LEFT JOIN held h ON h.alias = p.alias"""


SQL = _sql()
