"""Crawl scopes against a plain predicate, and claim lists from macros."""

import random
import re
from urllib.parse import unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from sievemark.operators import claims, scopes


def plain(url, s):
    """Whether a URL is in a scope, by its parts."""
    _, host, port, base, excluded, required, banned = s
    parts = urlsplit(url or "")
    own = parts.port if parts.port != {"http": 80, "https": 443}.get(parts.scheme) else None
    if not parts.hostname or parts.hostname.removeprefix("www.") != host.lower().removeprefix("www.") or own != port:
        return False
    under = lambda root: root in ("", "/") or (parts.path.lower() + "/").startswith(root.lower().rstrip("/") + "/")
    pairs = {(unquote(n).lower(), unquote(v).lower()) for n, _, v in (x.partition("=") for x in parts.query.split("&") if x)}
    if not under(base) or any(under(x) for x in excluded or []) or not set(required or []) <= pairs:
        return False
    return not any(n == m and v in ("*", w) for n, v in banned or [] for m, w in pairs)


def test_scopes_are_the_plain_predicate(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    path = lambda: "".join("/" + pick("sk", "SK", "a", "b", "skate") for _ in range(rng.randint(0, 3))) + pick("", "/")
    pair = lambda: (pick("lang", "p"), pick("sk", "2", ""))
    query = lambda: "&".join(pick("lang=sk", "LANG=SK", "l%61ng=sk", "p=2", "p=", "p", "", "q=a%20b", "x=%zz") for _ in range(rng.randint(0, 3)))
    urls = [f"{pick('http', 'https')}://{pick('www.', '')}{pick('a.example', 'b.example')}{pick('', '', ':80', ':443', ':8080')}{path()}?{query()}{pick('', '#top')}" for _ in range(400)]
    urls += [None, "", "nonsense", "mailto:a@b.example", "https://a.example"]
    some = [
        (f"s{i}", pick("a.example", "WWW.b.example"), pick(None, None, 8080, 80, 443), pick("", "/", "/sk", "/sk/", "/a/b"), [path() or "/x" for _ in range(rng.randint(0, 2))] or None,
         [pair() for _ in range(pick(0, 0, 1))] or None, [(pair()[0], pick("*", "2")) for _ in range(pick(0, 1))])
        for i in range(80)
    ]
    some = [(*s[:4], [x for x in s[4] or [] if x != "/"], *s[5:]) for s in some]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, host int, base int")
    out = scopes.in_scope(pages, "page_id", "url", spark.createDataFrame(some, scopes.SCOPE))
    got = sorted(map(tuple, out.collect()))
    want = sorted((i, s[0]) for i, u in enumerate(urls) for s in some if plain(u, s))
    assert got == want and len(want) > 300
    assert out.filter(F.lit(False)).columns == ["page_id", "scope"]
    assert scopes.in_scope(pages.limit(0), "page_id", "url", spark.createDataFrame(some, scopes.SCOPE)).count() == 0


def document(**item):
    return {
        "macros": {"abs_cz": "bez", "abs_sk": "bez", "gap": r"(?:\w+\s+)?"},
        "categories": {"food": {"cz": "jogurt", "sk": "jogurt"}},
        "claims": [{"id": "x", "outcome": "text", "category": "food", "subst": "laktózy", **item}],
    }


def test_composed_forms():
    pattern = claims.composed("bez", r"(?:\w+\s+)?", "cukru", "cukerný", "sugar", "light")
    for text in ("Bez cukru", "bez přidaného cukru", "bez-cukerný", "sugar-free", "free from sugar", "0 % cukru", "very light"):
        assert re.search(pattern, text), text
    assert not re.search(pattern, "cukr") and not re.search(claims.composed("bez", "", "cukru"), "sugar free")


@pytest.mark.parametrize("item,rows,fault", [
    ({}, 2, None), ({"outcome": "maybe"}, 0, "outcome"), ({"outcome_cz": "maybe"}, 0, "outcome"), ({"category": "none"}, 0, "category"),
    ({"subst": None, "subst_cz": "mléka"}, 1, "no claim or subst for sk"), ({"claim_sk": "("}, 1, "x (sk)"), ({"id": None}, 0, "needed"),
])
def test_faults_are_named(item, rows, fault):
    got, faults = claims.claim_rows(document(**item))
    assert len(got) == rows and (fault is None) == (not faults) and all(fault in f for f in faults)


def test_whole_document_faults():
    given = document()
    del given["macros"]["gap"]
    assert claims.claim_rows(given) == ([], ["macro gap is missing"])
    twice = document()
    twice["claims"] *= 2
    assert claims.claim_rows(twice)[1] == ["x: listed twice"]
    assert claims.claim_rows({}) == ([], ["macro gap is missing"]) and claims.claim_rows("claims: []")[0] == []


def test_hits_are_one_expression_at_a_time(spark):
    given = document(outcome_cz="verify", category_exclude="sója")
    given["claims"].append({"id": "y", "outcome": "none", "category": "food", "claim": "(?i)light"})
    rows, faults = claims.claim_rows(given)
    assert not faults
    texts = [(1, "cz", "Bez laktózy, light", "jogurt"), (2, "sk", "bez pridanej laktózy", "jogurt"), (3, "cz", "bez laktózy", "jogurt a sója"), (4, "de", "bez laktózy", "jogurt"), (5, "cz", None, "jogurt"), (6, None, "light", "jogurt"), (7, "cz", "light", None), (7, "sk", "LIGHT", "jogurt")]
    df = spark.createDataFrame(texts, "id long, country string, text string, product string")
    got = sorted(map(tuple, claims.claim_hits(df, ["id"], "text", "country", rows, "product").collect()))
    want = [(i, n, o) for i, land, t, p in texts for n, c, claim, cat, no, o in rows if c == land and t and p and re.search(claim, t) and re.search(cat, p) and not (no and re.search(no, p))]
    assert got == sorted(want) == [(1, "x", "verify"), (1, "y", "none"), (2, "x", "text"), (7, "y", "none")]
    assert claims.claim_hits(df, ["id"], "text", "country", []).count() == 0
