"""Queries on regions against their SQL on pages whose headings were cut in the middle of a character reference."""

import duckdb
import pytest

from sievemark.plans.queries import ORACLES, QUERIES
from sievemark.sources import elements as E

CUTS = ["&quot", "&copy", "&middot", "&lt", "&gt", "&#x27", "&#39", "&#x2", "&amp", "&am", "&", "&quot;", "&amp;quot;", "&ampquot;", "&quotes;", "&ampere;", "&#", "&nope;"]
PAGE = """<!DOCTYPE html><html lang="en"><head><title>Token = {0}</title></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="ad">{1}</div><article><h1>Token = {0}</h1><p><b>Token = &quot;9c44caf4&quot; of the {0} shop.<br><p>Pots &amp; pans.</p></article>
<footer>&copy; shop.example &middot; Imprint</footer></body></html>"""


@pytest.mark.parametrize("name", ["main_by_density", "page_regions", "skip_regions"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    pages = [(i, "https://shop.example/en/1", PAGE.format(x, "Token = &quot;" if i < len(CUTS) else "An advert.")) for i, x in enumerate(CUTS * 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) >= len(CUTS)


def test_closed_references():
    """Without closed, references are read as HTML has them."""
    read = lambda html, closed: [x for _, _, x in E.Tree(html, closed).blocks]
    html = '<h1>A &quot</h1><p title="&copy">&copy 2024 &eacute;&#233;&#233 &amp B &amp;lt &nope; & C &'
    assert read(html, True) == ["A &quot", "&copy 2024 éé&#233 & B &lt &nope; & C &"]
    assert read(html, False) == ['A "', "© 2024 ééé & B &lt &nope; & C &"]
    assert read(None, True) == [] and read("&" * 50_000, True) == ["&" * 50_000]
