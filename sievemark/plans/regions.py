"""Queries on regions of pages: main text, frame, navigation, tiles, skip regions, lists of links and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import elements as E
from .registry import query, table


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _plain(x: str) -> str:
    """SQL: character references of the pages decoded."""
    for name, value in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''")):
        x = f"replace({x}, '&{name};', '{value}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _blocks(part: str) -> str:
    """SQL: the texts between the tags of a part of a page."""
    return f"""list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '{part}', 1, 's'), '<[^>]*>'),
lambda x: trim(regexp_replace({_plain("x")}, '\\s+', ' ', 'g'))), lambda x: x <> '')"""


PARTS = f"""parts as (select page_id, {_blocks("<nav>(.*?)</nav>")} as menu, {_blocks('<div class="ad">(.*?)</div>')} as ad,
{_blocks("<article[^>]*>(.*)</article>")} as main, {_blocks("<footer>(.*?)</footer>")} as frame from pages),
own as (select page_id, menu, main, frame, list_filter(ad, lambda x: not list_contains(main, x)
and not (length(x) >= {E.LEAST_CONTAINED} and contains(lower(array_to_string(main, chr(10))), lower(x)))) as rest from parts)"""


def _joined(blocks: Column) -> Column:
    return F.sha2(F.array_join(blocks, "\n"), 256)


def _texts(region: str) -> Column:
    return F.transform(F.filter("blocks", lambda b: b["region"] == region), lambda b: b["text"])


REGIONS = {"navigation": "menu", "rest": "rest", "main": "main", "chrome": "frame"}


@query(f"""with {PARTS} {" union all ".join(f"select page_id, '{r}' as region, len({c}) as n_blocks, sha256(array_to_string({c}, chr(10))) as text_sha256 from own where len({c}) > 0" for r, c in REGIONS.items())}""")
def page_regions(spark, sf_dir):
    """GEN-02: each page's regions with their texts; the pages hold no tiles (a fixture does). Headings may be cut in a
    character reference."""
    found = E.judged(pages(spark, sf_dir), closed=True)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), _texts(r).alias("texts")) for r in (*REGIONS, "tile")]))
    rows = found.select(F.col("id").alias("page_id"), each.alias("r")).filter(F.size("r.texts") > 0)
    return rows.select("page_id", "r.region", F.size("r.texts").cast("long").alias("n_blocks"), _joined(F.col("r.texts")).alias("text_sha256"))


@query(f"""with {PARTS} select page_id, len(main) as n_blocks, sha256(array_to_string(main, chr(10))) as text_sha256 from own""")
def main_by_density(spark, sf_dir):
    """GEN-03: the main text without a look at main and article elements; it is theirs nevertheless. Headings may be cut
    in a character reference."""
    found = E.judged(pages(spark, sf_dir), tell=False, closed=True)
    return found.select(F.col("id").alias("page_id"), F.size(_texts("main")).cast("long").alias("n_blocks"), _joined(_texts("main")).alias("text_sha256"))


PROFILE = [("div.ad", "skip", "advert"), ("body > footer", "skip", "imprint"), ("nav li", "skip", "menu"), ("article > p", "skip", "text"), ("body", "skip", "all"), ("article h1", "check", "title")]


@query(f"""with {PARTS} select page_id, len(rest)::bigint as adverts, len(frame)::bigint as imprints, len(main)::bigint as main,
len(main) > 0 as whole_page_kept from own""")
def skip_regions(spark, sf_dir):
    """DOM-08: skip regions of a profile. Main text stays, though `article > p` would skip it, and so does a page whose
    skip region `body` holds the check region."""
    rules = F.array(*[F.struct(F.lit(s).alias("selector"), F.lit(a).alias("action"), F.lit(r).alias("role")) for s, a, r in PROFILE])
    found = E.judged(pages(spark, sf_dir).withColumn("rules", rules), rules="rules", closed=True)
    count = lambda keep: F.size(F.filter("blocks", keep)).cast("long")
    return found.select(
        F.col("id").alias("page_id"),
        count(lambda b: b["role"] == "advert").alias("adverts"),
        count(lambda b: b["role"] == "imprint").alias("imprints"),
        count(lambda b: b["region"] == "main").alias("main"),
        F.exists("unused", lambda u: (u["selector"] == "body") & (u["reason"] == "check region")).alias("whole_page_kept"),
    )


@query("""with u as (select page_id, unnest(regexp_extract_all(html, '<ul>(.*?)</ul>', 1, 's')) as body from pages)
select page_id, count(*) as lists, sum(len(regexp_extract_all(body, '<li>')))::bigint as items from u where len(regexp_extract_all(body, '<li>')) >= 2 group by page_id""")
def link_lists(spark, sf_dir):
    """GEN-02: lists of nothing but links, from the subtrees of all pages."""
    lists = E.subtrees(pages(spark, sf_dir)).filter("listed")
    return lists.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("lists"), F.sum("children").alias("items"))


@query("""with li as (select page_id, len(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>')) as n from pages)
select page_id, 'li' as tag, n as times from li where n >= 3""")
def repeated_subtrees(spark, sf_dir):
    """GEN-02: runs of at least three siblings of one shape that hold a link, as in lists and listings."""
    s = E.subtrees(pages(spark, sf_dir)).filter("link_chars > 0 and parent >= 0")
    runs = s.groupBy("id", "parent", "shape").agg(F.min("tag").alias("tag"), F.count("*").alias("times")).filter("times >= 3")
    return runs.select(F.col("id").alias("page_id"), "tag", "times")
