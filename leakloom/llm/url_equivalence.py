"""URL filters over redirect equivalence (operator 10).

Rules of host and path judge URLs one by one. Pages are also joined to the URLs they redirect to or
name as canonical; connected components of these links are aliases of one resource. A block that a
rule lays on any member holds for all that no rule allows; an own rule, above all an own allow,
always comes first. All of it is joins and minima; the rules are compiled into the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import _shared as S
from leakloom.llm.components import components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its host, its subdomains, and paths that start with its own."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def resource(url: Column) -> Column:
    """What identifies a URL: host, path and query, without scheme, fragment, tracking parameters and a slash at the end; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)")), "&")
    host = F.regexp_replace(host_of(url), ":(?:80|443)$", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def targets(html: Column, url: Column) -> Column:
    """Array of the URLs that a page names as its canonical one or sends its readers to, made absolute."""
    link = F.regexp_extract(html, r"(?is)<link\b[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>", 0)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>", 0)
    href = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?\s*([^\s\"'<>]+)", 1)
    sent = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?\s*([^\s\"'<>]+)", 1)
    base = F.concat(F.lit("http://"), host_of(url))

    def absolute(t: Column) -> Column:
        t = F.replace(t, F.lit("&amp;"), F.lit("&"))
        return (
            F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(base, t))
            .when(t.startswith("?"), F.concat(base, path_of(url), t)).when(t != "", F.concat(base, F.regexp_extract(path_of(url), r"(?s)^(.*/)?", 0), t))
        )

    return F.filter(F.array(absolute(href), absolute(sent)), lambda t: t.isNotNull())


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) URLs of all redirect and canonical links in the pages."""
    return pages.select(F.col(url).alias("source"), F.explode(targets(F.col(html), F.col(url))).alias("target"))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Add host, path, rule and verdict to rows with a url, in place of columns of these names.

    ``edges``: (source, target) URLs, by default those the pages' html names. A null url, or one
    without "://", has an empty host and path, no aliases, and is allowed unless a rule fits.
    Repeated rows are judged alike; an empty table stays empty.
    """
    edges = edges_of(pages) if edges is None else edges
    url = F.col("url")
    ruled = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    own, key, node, part, stop = (S.fresh(x) for x in ("own", "key", "node", "part", "stop"))
    ruled = ruled.withColumn(own, rule_of(F.col("host"), F.col("path"), rules)).withColumn(key, resource(url))
    links = S.checkpointed(edges.select("source", "target").distinct().select(resource(F.col("source")).alias("a"), resource(F.col("target")).alias("b"), "source", "target").filter("a is not null and b is not null"))
    known = ruled.select(F.col(key).alias("key"), F.col(own)["verdict"].alias("v"))
    met = links.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("source").alias("u")), F.struct(F.col("b").alias("key"), F.col("target").alias("u")))).alias("x"))
    told = met.select("x.key", rule_of(host_of(F.col("x.u")), path_of(F.col("x.u")), rules)["verdict"].alias("v"))
    blocked = known.unionByName(told).filter("v = 'block' and key is not null").select("key").distinct()
    found = components(links.select("a", "b")) if links.limit(1).count() else None
    if found is not None:
        found = S.checkpointed(found.select(F.col("node").alias(node), F.col("component").alias(part)))
        blocked = blocked.join(found, F.col("key") == F.col(node), "left").select(F.coalesce(part, "key").alias("key")).distinct()
        ruled = ruled.join(found, F.col(key) == F.col(node), "left").withColumn(key, F.coalesce(part, key)).drop(node, part)
    judged = ruled.join(blocked.select(F.col("key").alias(stop)), F.col(key) == F.col(stop), "left")
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col(stop).isNotNull(), "block").otherwise("allow"))
    return judged.withColumn("rule", F.col(own)["rule"]).withColumn("verdict", verdict).drop(own, key, stop)


def op10_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' urls; null urls have an empty host and path, repeated rows give repeated results, an empty table gives no rows."""
    pages = S.table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), edges_of(pages)).select("page_id", "host", "path", "rule", "verdict")


def _sql(rules=RULES) -> str:
    """The query in DuckDB's SQL; aliases are a recursive closure over the links, of which there are few here."""
    lower = f"translate(coalesce(regexp_extract({{0}}, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = f"coalesce(regexp_extract({{0}}, '{_URL}', 2), '')"

    def ruled(host: str, where: str, what: int) -> str:
        cases = [f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({where}, '{p}') then '{(h + p, v)[what]}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
        return f"case {' '.join(cases)} end"

    def key(url: str) -> str:
        query = f"array_to_string(list_filter(string_split(regexp_extract({url}, '(?s)^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(?:utm_[a-z]+|gclid|fbclid)(?:=|$)')), '&')"
        host = f"regexp_replace({lower.format(url)}, ':(?:80|443)$', '')"
        return f"case when {host} <> '' then concat({host}, regexp_replace({path.format(url)}, '/+$', ''), case when {query} <> '' then '?' || {query} else '' end) end"

    quote = "[\"'']?"
    link = f"regexp_extract(html, '(?is)<link\\b[^<>]*\\brel\\s*=\\s*{quote}canonical\\b[^<>]*>', 0)"
    meta = f"regexp_extract(html, '(?is)<meta\\b[^<>]*\\bhttp-equiv\\s*=\\s*{quote}refresh\\b[^<>]*>', 0)"
    href = f"regexp_extract({link}, '(?is)\\bhref\\s*=\\s*{quote}\\s*([^\\s\"''<>]+)', 1)"
    sent = f"regexp_extract({meta}, '(?is)\\burl\\s*=\\s*{quote}\\s*([^\\s\"''<>]+)', 1)"
    absolute = "case when contains(t, '://') then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then 'http://' || host || t when starts_with(t, '?') then 'http://' || host || path || t when t <> '' then 'http://' || host || regexp_extract(path, '(?s)^(.*/)?', 0) || t end"
    return f"""with recursive p as (select page_id, url, {lower.format('url')} as host, {path.format('url')} as path, {key('url')} as k, [{href}, {sent}] as found from pages),
      e as (select distinct k as a, url as ua, {absolute} as ub from (select k, url, host, path, replace(unnest(found), '&amp;', '&') as t from p)),
      l as (select a, b, ua, ub from (select a, {key('ub')} as b, ua, ub from e where ub is not null) where a is not null and b is not null),
      pairs as (select a, b from l union select b, a from l),
      closed as (select a, b from pairs union select closed.a, pairs.b from closed join pairs on closed.b = pairs.a),
      told as (select k, {ruled('host', 'path', 1)} as v from p union all select a, {ruled(lower.format('ua'), path.format('ua'), 1)} from l union all select b, {ruled(lower.format('ub'), path.format('ub'), 1)} from l),
      stop as (select k from told where v = 'block' and k is not null union select closed.a from closed join told on told.k = closed.b where v = 'block')
      select page_id, host, path, {ruled('host', 'path', 0)} as rule, coalesce({ruled('host', 'path', 1)}, case when k in (select k from stop) then 'block' else 'allow' end) as verdict from p"""


SQL = _sql()
