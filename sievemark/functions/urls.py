"""URL functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid ref".split()
#: Endings of files that aren't pages.
NO_PAGES = "pdf zip jpg jpeg png gif webp svg css js xml json mp4 mp3 doc docx xls xlsx ico woff woff2".split()


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower case, without www."""
    return F.regexp_replace(F.lower(part(url, "HOST")), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def subdomain(a: Column, b: Column) -> Column:
    """Whether the host of a is that of b or one below it."""
    return same_site(a, b) | F.endswith(host(a), F.concat(F.lit("."), host(b)))


def without_tracking(url: Column) -> Column:
    """No fragment, no tracking parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.coalesce(part(bare, "QUERY"), F.lit(""))
    rest = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(TRACKING))
    base = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(F.size(rest) > 0, F.concat(base, F.lit("?"), F.array_join(rest, "&"))).otherwise(base)


def normalized(url: Column) -> Column:
    """Scheme https, host without www, no default port, no tracking, no slash at the end."""
    plain = without_tracking(url)
    plain = F.regexp_replace(plain, r"^(?i)https?://(?:www\.)?", "https://")
    plain = F.regexp_replace(plain, r"^(https://[^/?:]+):(?:80|443)(?=[/?]|$)", "$1")
    return F.regexp_replace(plain, r"/+(?=\?|$)", "")


def file_name(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(part(F.regexp_replace(url, "#.*$", ""), "PATH"), F.lit("")), r"([^/]*)$", 1)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(url), r"\.([A-Za-z0-9]+)$", 1))


def page_filter(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a URL is a page to look at: no file, no excluded path, and included where anything is."""
    path = F.try_url_decode(F.concat(F.coalesce(part(url, "PATH"), F.lit("")), F.lit("?"), F.coalesce(part(url, "QUERY"), F.lit(""))))
    ok = ~extension(url).isin(NO_PAGES)
    if include:
        ok &= path.rlike("|".join(f"(?:{p})" for p in include))
    if exclude:
        ok &= ~path.rlike("|".join(f"(?:{p})" for p in exclude))
    return ok


def group_key(urls: Column) -> Column:
    """16 hex digits of SHA-256 over the sorted distinct URLs, a line each."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.array_distinct(urls)), "\n"), 256), F.lit(16))
