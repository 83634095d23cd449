"""Signals of a market on a page: language switches by URL shape, switches of a shop platform, and a table of all signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

#: The shape of a segment or subdomain that names a language, of a language tag, and parameters that choose a language.
LABEL = r"(?i)^[a-z]{2}(?:-[a-z]{2})?$"
TAG = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8}){0,2}$"
LANGUAGE_PARAMETERS = "lang language locale".split()


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(U.part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")


def parameter(url: Column, *names: str) -> Column:
    """The decoded value of the first query parameter of one of these names, in any case; null without one."""
    pairs = F.transform(F.split(F.coalesce(U.part(url, "QUERY"), F.lit("")), "&"), lambda p: F.split(p, "=", 2))
    own = F.filter(pairs, lambda p: (F.size(p) == 2) & F.lower(F.coalesce(F.try_url_decode(p[0]), p[0])).isin([n.lower() for n in names]))
    return F.trim(F.coalesce(F.try_url_decode(F.get(F.get(own, 0), 1)), F.get(F.get(own, 0), 1)))


def switch(link: Column, site: Column) -> Column:
    """struct(kind, language) where an absolute link differs from the site only by a language: as a path segment, a query
    parameter, a subdomain or another top-level domain (language null). Null for any other link, and for the site itself."""
    to, home = U.normalized(link), U.normalized(site)
    segments, host, own = _segments(to), U.host(to), U.host(home)
    asked = parameter(to, *LANGUAGE_PARAMETERS)
    root = F.size(segments) == 0
    label = F.regexp_extract(host, r"^([^.]+)\.", 1)

    def found(kind: str, language: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), T.language_tag(language).alias("language"))

    bare = root & U.part(to, "QUERY").isNull()
    return (
        F.when(to == home, F.lit(None))
        .when((host == own) & (F.size(segments) == 1) & F.rlike(F.get(segments, 0), F.lit(LABEL)), found("path", F.get(segments, 0)))
        .when((host == own) & root & F.rlike(T.language_tag(asked), F.lit(TAG)), found("query", asked))
        .when(bare & F.endswith(host, F.concat(F.lit("."), own)) & F.rlike(label, F.lit(LABEL)), found("subdomain", label))
        .when(bare & (host != own) & ~F.endswith(host, F.concat(F.lit("."), own)) & (label == F.regexp_extract(own, r"^([^.]+)\.", 1)), found("domain", F.lit(None).cast("string")))
    )


def platform_switches(pages: DataFrame, platforms: list[tuple[str, str, str, str, str]], key: str, site: str, links: str, scripts: str) -> DataFrame:
    """(key, platform, kind, value, link): links of the own site that switch currency or language by their own address.

    platforms, in order: (platform, script host, kind "currency" or "language", path, parameter). Only the first platform counts
    that the page loads a script of and that has such a link. Pages without a platform give no row; a repeated value comes once.
    """
    name = F.transform(F.coalesce(scripts, F.array()), lambda s: F.lower(F.coalesce(U.part(s, "HOST"), F.lit(""))))

    def matching(place: int, row: tuple[str, str, str, str, str]) -> Column:
        platform, script, kind, path, param = row
        loaded = F.exists(name, lambda h: (h == script) | F.endswith(h, F.lit("." + script)))
        shape = TAG if kind == "language" else r"^[A-Z]{3}$"

        def value(link: Column) -> Column:
            found = parameter(link, param)
            return T.language_tag(found) if kind == "language" else F.upper(found)

        def hit(link: Column) -> Column:
            at = F.lower(F.rtrim(F.coalesce(U.part(link, "PATH"), F.lit("")), F.lit("/")))
            return loaded & U.same_site(link, F.col(site)) & (at == path.rstrip("/").lower()) & F.coalesce(F.rlike(value(link), F.lit(shape)), F.lit(False))

        def made(link: Column) -> Column:
            return F.struct(F.lit(place).alias("place"), F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), value(link).alias("value"), link.alias("link"))

        return F.transform(F.filter(F.coalesce(links, F.array()), hit), made)

    order = {p: i for i, p in enumerate(dict.fromkeys(r[0] for r in platforms))}
    every = F.flatten(F.array(*[matching(order[r[0]], r) for r in platforms]))
    first = F.array_min(F.transform(F.col("_all"), lambda x: x["place"]))
    rows = pages.select(key, every.alias("_all")).select(key, F.explode(F.filter("_all", lambda x: x["place"] == first)).alias("_x"))
    return rows.groupBy(key, "_x.platform", "_x.kind", "_x.value").agg(F.min("_x.link").alias("link"))


def market_signals(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, kind, value), distinct by page: language of the page, alternates, currencies, calling codes, top-level domain, switches.

    One pass over the pages: every kind is an array of the row, so no kind costs a scan of its own. Null html gives the domain only.
    """
    body, at = F.coalesce(F.col(html), F.lit("")), F.col(url)

    def all_of(pattern: str) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))

    def signals(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    origin = F.regexp_extract(at, r"^([a-z]+://[^/?#]+)", 1)
    links = F.transform(all_of(r'<a\b[^>]*?\bhref="([^"]*)"'), lambda x: F.when(x.rlike("^[a-z]+://"), x).when(x.startswith("/"), F.concat(origin, x)))
    switches = F.filter(F.transform(links, lambda x: switch(x, origin)), lambda s: s.isNotNull())
    kinds = [
        signals("lang", F.transform(all_of(r'<html\b[^>]*?\blang="([^"]*)"'), T.language_tag)),
        signals("hreflang", F.filter(F.transform(all_of(r'<link\b[^>]*?\bhreflang="([^"]*)"'), T.language_tag), lambda v: v != "x-default")),
        signals("currency", F.transform(all_of(r'\bitemprop="priceCurrency"[^>]*?\bcontent="([A-Za-z]{3})"'), F.upper)),
        signals("phone", F.transform(all_of(r'\bhref="tel:(\+[0-9 ().-]+)"'), T.calling_code)),
        signals("tld", F.array(F.lower(F.regexp_extract(F.coalesce(U.part(at, "HOST"), F.lit("")), r"([^.]*)$", 1)))),
        signals("switch", F.transform(switches, lambda s: F.concat_ws(" ", s["kind"], s["language"]))),
    ]
    found = F.array_distinct(F.filter(F.flatten(F.array(*kinds)), lambda s: s["value"].isNotNull() & (s["value"] != "")))
    return pages.select(key, F.explode(found).alias("_s")).select(key, "_s.kind", "_s.value")
