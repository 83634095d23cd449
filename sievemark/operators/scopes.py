"""Which pages belong to which crawl scope: host, port, base path, excluded paths, and conditions on the query.

Scopes are found by their base path among the prefixes of a page's path (one row for each segment), an equi-join; the
other conditions are checked on what it finds. Hosts are compared without www., paths and queries without case. Defined
results: a null URL and one without a host are in no scope; repeated pages give repeated rows; null arrays hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scope: base '' or '/' is the whole host, port null the scheme's own; `any` as a value stands for each value.
SCOPE = (
    "scope string, host string, port int, base string, excluded array<string>, "
    "required array<struct<name:string,value:string>>, banned array<struct<name:string,value:string>>"
)
ANY = "*"
#: The ports that go without saying.
PORTS = {"http": 80, "https": 443}


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower case, without www.), path and query of a URL, also of one whose query is badly encoded."""
    bare_url = F.regexp_replace(url, "(?s)#.*$", "")
    host = F.regexp_extract(bare_url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1)
    path = F.regexp_extract(bare_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", ""), path, F.regexp_extract(bare_url, r"\?(.*)$", 1)


def segments(path: Column) -> Column:
    """The prefixes of a path by whole segments, in lower case without a slash at the end; '' first."""
    names = F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), lambda p: p != "")
    upto = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    return F.transform(upto, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("/"), p)))


def bare(path: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(path, F.lit(""))), "/+$", "")


def query_pairs(query: Column) -> Column:
    """(name, value) of a query, decoded, in lower case; what can't be decoded stays as it is."""
    plain = lambda c: F.lower(F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))
    each = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    cut = lambda p: F.split(p, "=", 2)
    pair = lambda p: F.struct(plain(cut(p)[0]).alias("name"), plain(F.coalesce(F.get(cut(p), F.lit(1)), F.lit(""))).alias("value"))
    return F.array_distinct(F.transform(each, pair))


def port(url: Column) -> Column:
    """The port that a URL names, or null if it is the scheme's own."""
    named = F.nullif(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*:(\d{1,5})(?:[/?#]|$)", 1), F.lit("")).cast("int")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    own = F.coalesce(*[F.when(scheme == s, p) for s, p in PORTS.items()])
    return F.when(~named.eqNullSafe(own), named)


def in_scope(pages: DataFrame, key: str, url: str, scopes: DataFrame) -> DataFrame:
    """(key, scope) of every scope that a page belongs to."""
    host, path, query = parts(F.col(url))
    each = pages.select(
        key, host.alias("host"), F.coalesce(port(F.col(url)), F.lit(0)).alias("port"), segments(path).alias("prefixes"), query_pairs(query).alias("pairs")
    )
    each = each.filter("host != ''").select("*", F.explode("prefixes").alias("base"))
    nothing = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pairs = "array<struct<name:string,value:string>>"
    low = lambda c: F.transform(nothing(F.col(c), pairs), lambda p: F.struct(F.lower(p["name"]).alias("name"), F.lower(p["value"]).alias("value")))
    wanted = scopes.select(
        "scope", F.regexp_replace(F.lower("host"), r"^www\.", "").alias("host"), F.coalesce("port", F.lit(0)).alias("port"), bare(F.col("base")).alias("base"),
        F.transform(nothing(F.col("excluded"), "array<string>"), bare).alias("excluded"), low("required").alias("required"), low("banned").alias("banned"),
    )
    met = each.join(wanted, ["host", "port", "base"])
    met = met.filter(~F.arrays_overlap("prefixes", "excluded") & (F.size(F.array_except("required", "pairs")) == 0))
    hit = F.exists("banned", lambda b: F.exists("pairs", lambda p: (p["name"] == b["name"]) & ((b["value"] == ANY) | (p["value"] == b["value"]))))
    return met.filter(~hit).select(key, "scope")
