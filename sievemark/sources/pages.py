"""Sources of web pages: HTML as rows of blocks and links, recordings, robots.txt and sitemaps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.batches import bounded, bounded_udf

#: Fixed values of HTML.
BLOCK_TAGS = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SKIPPED = {"script", "style", "noscript", "template", "title"}
MOST_DEPTH = 12  # levels of JSON-LD that are read
REGIONS = {"nav": "navigation", "header": "chrome", "footer": "chrome", "aside": "chrome", "article": "main", "main": "main"}


class _Reader(HTMLParser):
    """Text blocks with region and heading level, links and structure tokens of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.links: list[str] = []
        self.tokens: list[str] = []
        self.json_ld: list[str] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.heading = 0
        self.skip: str | None = None
        self.ld = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            region = next((REGIONS[t] for t in reversed(self.stack) if t in REGIONS), "rest")
            self.blocks.append((region, self.heading, text))

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        name = re.sub(r"\d+", "#", tag if tag[0] != "h" or not tag[1:].isdigit() else "h")
        self.tokens.append(name)
        self.tokens += [f"{name}.{re.sub(r'[0-9]+', '#', c)}" for c in (found.get("class") or "").split()]
        if found.get("id"):
            self.tokens.append(f"{name}#{re.sub(r'[0-9]+', '#', found['id'])}")
        if tag in SKIPPED:
            self.skip, self.ld = tag, found.get("type") == "application/ld+json"
            return
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK_TAGS:
            self.flush()
            if tag != "hr":
                self.stack.append(tag)
            self.heading = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip, self.ld = None, False
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = 0
            if tag in self.stack:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if self.ld:
            self.json_ld.append(data)
        if self.skip is None:
            self.text.append(data)


def read_page(source: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    reader.flush()
    return reader


PARSED = (
    "id long, blocks array<struct<region:string,heading_level:int,text:string>>, links array<string>, "
    "tokens array<string>, json_ld array<string>"
)


def parsed(df: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """Each page read once: blocks, links, distinct structure tokens and JSON-LD bodies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [read_page(h) for h in batch["body"]]
            yield pd.DataFrame({
                "id": batch["id"],
                "blocks": [[{"region": r, "heading_level": h, "text": t} for r, h, t in p.blocks] for p in pages],
                "links": [p.links for p in pages], "tokens": [sorted(set(p.tokens)) for p in pages], "json_ld": [p.json_ld for p in pages],
            })

    bounded(df.sparkSession)
    return df.select(df[key].cast("long").alias("id"), df[body].alias("body")).mapInPandas(run, PARSED)


def blocks(pages: DataFrame) -> DataFrame:
    """(id, ord, region, heading_level, text) from parsed()."""
    return pages.select("id", F.posexplode("blocks").alias("ord", "b")).select("id", F.col("ord").cast("long").alias("ord"), "b.*")


def objects(value, depth: int = 0) -> Iterator[dict]:
    """The objects of a JSON value, outer ones first, at most MOST_DEPTH levels down."""
    if depth > MOST_DEPTH:
        return
    if isinstance(value, dict):
        yield value
    for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from objects(inner, depth + 1)


def product_rows(bodies) -> list[dict]:
    """Name, description and first currency of each product in JSON-LD bodies, wherever it stands (as in @graph)."""
    text = lambda x: x if isinstance(x, str) else None
    out = []
    for body in bodies:
        try:
            found = [*objects(json.loads(body))]
        except (ValueError, RecursionError):
            continue
        for node in found:
            kinds = node.get("@type")
            kinds = {re.split("[/#:]", k.strip().rstrip("/"))[-1] for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}
            if "Product" in kinds:
                money = (x.get("priceCurrency") for x in objects(node))
                money = next((m.strip().upper() for m in money if isinstance(m, str) and re.fullmatch("[A-Za-z]{3}", m.strip())), None)
                out.append({"name": text(node.get("name")), "description": text(node.get("description")), "currency": money})
    return out


@bounded_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("name", "description", "currency")])))
def _product_rows(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: product_rows([] if b is None else b))


def products(pages: DataFrame) -> DataFrame:
    """(id, name, description, currency) of JSON-LD products, nested ones and those of several types too; invalid JSON is ignored."""
    return pages.select("id", F.explode(_product_rows("json_ld")).alias("p")).select("id", "p.*")


def recording(spark: SparkSession, index: str, bodies: str) -> DataFrame:
    """A recorded crawl: an index of JSON lines (url, status, body) and a folder of bodies, joined by file name."""
    listed = spark.read.schema("url string, status int, body string").json(index)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = spark.read.format("binaryFile").load(bodies).select(name.alias("body"), F.col("content").cast("string").alias("html"))
    return listed.join(files, "body", "left").select("url", F.when(F.col("html").isNull(), 404).otherwise(F.col("status")).alias("status"), "html")


def _robot_lines(df: DataFrame, site: str, body: str, agent: str) -> DataFrame:
    """(site, pairs, lines): all lines of a robots.txt (k, v), and those (agent, k, v) of the groups that hold for an agent:
    those that name it, even without a rule, else those of *.

    A file's lines are folded in order within its row; a group is all agents named before its first line of another kind.
    """
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    line = "struct<agent:string,k:string,v:string>"
    zero = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("open"), F.array().cast(f"array<{line}>").alias("lines"))

    def step(s: Column, p: Column) -> Column:
        name, free = p["k"] == "user-agent", p["k"] == "sitemap"
        added = F.transform(s["agents"], lambda a: F.struct(F.lower(a).alias("agent"), p["k"].alias("k"), p["v"].alias("v")))
        agents = F.when(name & s["open"], F.concat(s["agents"], F.array(p["v"]))).when(name, F.array(p["v"])).otherwise(s["agents"])
        kept = F.when(name | free, s["lines"]).otherwise(F.concat(s["lines"], added))
        return F.struct(agents.alias("agents"), F.when(free, s["open"]).otherwise(name).alias("open"), kept.alias("lines"))

    folded = df.select(site, pairs.alias("pairs")).select(site, "pairs", F.aggregate("pairs", zero, step)["lines"].alias("lines"))
    own = F.filter("lines", lambda r: r["agent"] == agent.lower())
    chosen = F.when(F.size(own) > 0, own).otherwise(F.filter("lines", lambda r: r["agent"] == "*"))
    return folded.select(site, "pairs", chosen.alias("lines"))


def robots(df: DataFrame, site: str = "site", body: str = "body", agent: str = "*") -> DataFrame:
    """(site, allow, path, length) of the rules that hold for an agent; without a group of its own, those of *."""
    rules = _robot_lines(df, site, body, agent).select(site, F.explode("lines").alias("r"))
    rules = rules.filter("r.k in ('allow', 'disallow') and r.v != ''")
    return rules.select(site, (F.col("r.k") == "allow").alias("allow"), F.col("r.v").alias("path"), F.length("r.v").alias("length"))


def robots_facts(df: DataFrame, site: str = "site", body: str = "body", agent: str = "*") -> DataFrame:
    """(site, sitemaps, delay): the sitemaps that a robots.txt names, in order, and an agent's longest crawl delay in seconds."""
    maps = F.transform(F.filter("pairs", lambda p: (p["k"] == "sitemap") & (p["v"] != "")), lambda p: p["v"])
    delays = F.transform(F.filter("lines", lambda r: r["k"] == "crawl-delay"), lambda r: r["v"].try_cast("double"))
    delay = F.array_max(F.filter(delays, lambda d: d >= 0))
    return _robot_lines(df, site, body, agent).select(site, maps.alias("sitemaps"), delay.alias("delay"))


def path_pattern(path: Column) -> Column:
    """A robots path as a regular expression: * is anything, $ at the end is the end."""
    quoted = F.regexp_replace(F.regexp_replace(path, r"([.?+^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\$(?!$)", r"\\\$"))


def allowed(urls: DataFrame, rules: DataFrame, site: str, path: str) -> DataFrame:
    """urls with `allow`: of the site's rules that match, the longest decides, allow wins ties, none allows.

    The rules of a site become one array, so a URL meets them in one equi join.
    """
    own = rules.groupBy(site).agg(F.collect_list(F.struct("length", "allow", path_pattern(F.col("path")).alias("pattern"))).alias("_rules"))
    hit = F.array_max(F.transform(F.filter("_rules", lambda r: F.rlike(F.col(path), r["pattern"])), lambda r: F.struct(r["length"], r["allow"])))
    return urls.join(own, site, "left").withColumn("allow", F.coalesce(hit["allow"], F.lit(True))).drop("_rules")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, alternates) of sitemap files; gzip by file name."""
    schema = "loc string, lastmod string, `xhtml:link` array<struct<_hreflang:string,_href:string>>"
    rows = spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
    links = F.transform(F.coalesce("`xhtml:link`", F.array()), lambda x: F.struct(x["_hreflang"].alias("language"), x["_href"].alias("url")))
    return rows.select("loc", F.to_date(F.left("lastmod", F.lit(10))).alias("lastmod"), links.alias("alternates"))


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of the sitemaps that index files name; a file of another kind gives none."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path)
    return rows.select("loc", F.to_date(F.left("lastmod", F.lit(10))).alias("lastmod"))


def is_html(media_type: Column, body: Column) -> Column:
    head = F.lower(F.left(body, F.lit(1024)))
    return F.coalesce(F.contains(F.lower(media_type), F.lit("html")), F.lit(False)) | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html"))


__all__ = ["allowed", "blocks", "is_html", "parsed", "path_pattern", "products", "recording", "robots", "robots_facts", "sitemap", "sitemap_index"]
