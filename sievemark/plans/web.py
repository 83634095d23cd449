"""Queries on web pages: URLs, robots, classes, blocks and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import scopes as O
from ..operators import templates as M
from ..sources import pages as P
from .registry import query, table

HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
PATH = "regexp_extract(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]+([^?]*)', 1)"
ROBOTS = "User-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*?page=\n\nUser-agent: other\nDisallow: /\n"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query(f"select page_id, {HOST} as host, {PATH} as path, lower(regexp_extract({PATH}, '\\.([A-Za-z0-9]+)$', 1)) as ext from pages")
def url_parts(spark, sf_dir):
    """STR-14, FLT-03, FLT-04."""
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.host(u).alias("host"), U.part(F.regexp_replace(u, "#.*$", ""), "PATH").alias("path"), U.extension(u).alias("ext"))


QUERY = "regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1)"


@query(f"""with u as (select page_id, {HOST} as host, lower({PATH}) as path, lower(regexp_extract({PATH}, '^/([^/]+)', 1)) as top, string_split(lower({QUERY}), '&') as q from pages),
s as (select distinct host, top from u where top <> '')
select page_id, u.host || '/' || top as scope from u join s using (host, top) where case top
when 'en' then not regexp_matches(path, '^/en/[1-4][0-9]{{2}}(/|$)') when 'fr' then list_contains(q, 'page=2')
else len(list_filter(q, lambda x: x like 'utm_source=%' or x = 'ref=x')) = 0 end""")
def crawl_scope(spark, sf_dir):
    """FLT-03: scopes by host and first part of the path; some exclude paths, some require or ban parts of the query."""
    p = pages(spark, sf_dir)
    top = F.regexp_extract(U.part(F.regexp_replace("url", "#.*$", ""), "PATH"), "^/([^/]+)", 1)
    roots = p.select(U.host(F.col("url")).alias("host"), F.lower(top).alias("top")).filter("top != ''").distinct()
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    listed = [F.lit(f"/en/{n}/") for n in range(100, 500)]
    scopes = roots.select(
        F.concat_ws("/", "host", "top").alias("scope"), "host", F.lit(None).cast("int").alias("port"), F.concat(F.lit("/"), "top", F.lit("/")).alias("base"),
        F.when(F.col("top") == "en", F.array(*listed)).alias("excluded"),
        F.when(F.col("top") == "fr", F.array(pair("page", "2"))).alias("required"),
        F.when(~F.col("top").isin("en", "fr"), F.array(pair("utm_source", O.ANY), pair("ref", "x"))).alias("banned"),
    )
    return O.in_scope(p, "page_id", "url", scopes)


STRIP = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(ref|utm_source)=[^&]*', '\\1', 'g'), '[?&]+$', ''), '\\?&+', '?')"""


@query(f"""select page_id, {STRIP} as plain, regexp_replace(regexp_replace({STRIP}, '^https?://(www\\.)?', 'https://'), '/+(\\?|$)', '\\1') as normal from pages""")
def url_normalize(spark, sf_dir):
    """STR-13."""
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", U.without_tracking(u).alias("plain"), U.normalized(u).alias("normal"))


@query("""with h as (select page_id, sha256(url) as d from pages),
u as (select page_id, ('0x' || substr(d,15,2)||substr(d,13,2)||substr(d,11,2)||substr(d,9,2)||substr(d,7,2)||substr(d,5,2)||substr(d,3,2)||substr(d,1,2))::ubigint as u from h),
s as (select page_id, case when u >= 9223372036854775808 then (u::hugeint - 18446744073709551616)::bigint else u::bigint end as url_hash from u)
select page_id, url_hash, abs(url_hash % 7)::bigint as bucket from s""")
def url_hashes(spark, sf_dir):
    """STR-08."""
    from ..functions.text import url_hash

    h = url_hash(F.col("url"))
    return pages(spark, sf_dir).select("page_id", h.alias("url_hash"), F.abs(h % 7).alias("bucket"))


@query(f"""select page_id, not regexp_matches({PATH}, '\\.(pdf|zip|png|jpg)$') and not regexp_matches({PATH} || '?' || regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), 'page=2|/es/') as kept from pages""")
def url_filter(spark, sf_dir):
    """FLT-01."""
    return pages(spark, sf_dir).select("page_id", U.page_filter(F.col("url"), exclude=["page=2", "/es/"]).alias("kept"))


@query(f"""with p as (select page_id, {PATH} || case when contains(url, '?') then '?' || regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) else '' end as path from pages)
select page_id, case when path like '/%?page=%' then false when path like '/de/1%' then true when path like '/de/%' then false else true end as allow from p""")
def robots_longest_match(spark, sf_dir):
    """FLT-02, SRC-03: where several rules match, the longest pattern decides."""
    rules = P.robots(spark.createDataFrame([("all", ROBOTS)], "site string, body string"))
    u = F.regexp_replace("url", "#.*$", "")
    q = U.part(u, "QUERY")
    path = F.concat(F.coalesce(U.part(u, "PATH"), F.lit("")), F.when(q.isNull(), "").otherwise(F.concat(F.lit("?"), q)))
    urls = pages(spark, sf_dir).select("page_id", F.lit("all").alias("site"), path.alias("path"))
    return P.allowed(urls, rules, "site", "path").select("page_id", "allow")


@query(f"""select page_id, case when {PATH} in ('', '/') then 'home' when regexp_matches({PATH}, '/(p|product|produkt|item)[-/]') then 'product'
when contains(lower({PATH}), 'imprint') or contains(lower({PATH}), '/de/4') then 'legal' else 'content' end as class from pages""")
def page_classify(spark, sf_dir):
    """FLT-05."""
    path = U.part(F.regexp_replace("url", "#.*$", ""), "PATH")
    return pages(spark, sf_dir).select("page_id", M.page_class(path, ["imprint", "/de/4"]).alias("class"))


@query(f"""select {HOST} as host, count(*) as n, substr(sha256(string_agg(distinct url, chr(10) order by url)), 1, 16) as group_key from pages group by 1""")
def hreflang_groups(spark, sf_dir):
    """JSN-03."""
    g = pages(spark, sf_dir).groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.collect_set("url").alias("urls"))
    return g.select("host", "n", U.group_key(F.col("urls")).alias("group_key"))


@query()
def html_blocks(spark, sf_dir):
    """SRC-05, GEN-01."""
    return P.blocks(P.parsed(pages(spark, sf_dir)))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as link from pages) select page_id as id, link, count(*) as n from l group by all""")
def html_links(spark, sf_dir):
    """GEN-07, links only."""
    links = P.parsed(pages(spark, sf_dir)).select("id", F.explode("links").alias("link"))
    return links.groupBy("id", "link").agg(F.count("*").alias("n"))


@query()
def template_cluster(spark, sf_dir):
    """DOM-07, GEN-08: a host is a site."""
    shapes = P.parsed(pages(spark, sf_dir)).select(F.col("id"), "tokens")
    site = pages(spark, sf_dir).select(F.col("page_id").alias("id"), U.host(F.col("url")).alias("site"))
    return M.clusters(shapes.join(site, "id"), "site", "id", "tokens").select("site", "id", "leader")


SIGNATURES = [("shop", "script", "track\\("), ("shop", "markup", 'class="ad"'), ("blog", "markup", "<article class"), ("wiki", "head", "MediaWiki")]


@query("""select page_id, case when (contains(html, 'track(') or contains(html, 'class="ad"')) and (contains(html, '<article class') or contains(html, 'MediaWiki')) then 'unknown'
when contains(html, 'track(') and contains(html, 'class="ad"') then 'certain' when contains(html, 'track(') or contains(html, 'class="ad"') or contains(html, '<article class') or contains(html, 'MediaWiki') then 'likely' else 'unknown' end as platform from pages""")
def platform_detect(spark, sf_dir):
    """FLT-18, AGG-19."""
    p = pages(spark, sf_dir)
    return p.select("page_id", M.platform(M.signatures(p, "html", SIGNATURES)).alias("platform"))


@query("""select page_id, contains(lower(left(html, 1024)), '<html') or contains(lower(left(html, 1024)), '<!doctype html') as is_html,
length(html) < 1000 as short from pages""")
def html_detect(spark, sf_dir):
    """FLT-07, FLT-21."""
    return pages(spark, sf_dir).select("page_id", P.is_html(F.lit(None).cast("string"), F.col("html")).alias("is_html"), (F.length("html") < 1000).alias("short"))


@query("""with f as (select page_id, url, html from pages where url ilike '%\\_%' escape '\\' or html ilike '%fr/8%') select page_id, url from f order by page_id limit 10""")
def search(spark, sf_dir):
    """FLT-14: the limit is the feature."""
    hit = F.col("url").ilike("%\\_%") | F.col("html").ilike("%fr/8%")
    return pages(spark, sf_dir).filter(hit).select("page_id", "url").orderBy("page_id").limit(10)
