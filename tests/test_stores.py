"""Paragraphs, sample plans, coverage and stored findings against plain Python."""

import hashlib
import itertools
import random

from sievemark.operators import coverage as C
from sievemark.operators import finding_store as S
from sievemark.operators import paragraphs as G
from sievemark.operators import pricing as P
from sievemark.operators import samples as M
from sievemark.plans.queries import QUERIES
from sievemark.sources import elements as E

SF = "/root/testdata/sf0.001"


def plain_paragraphs(blocks, most):
    """Sections by heading first, then each packed by itself."""
    sections = [(None, [])]
    for level, text in blocks:
        if level:
            sections.append((text, []))
        else:
            sections[-1][1].append(text)
    out = []
    for heading, texts in sections:
        room = max(3, most - (len(heading) + 1 if heading is not None else 0))
        parts = [p for t in texts for p in G.pieces(t, room)]
        while parts:
            n = next((n for n in range(len(parts), 1, -1) if len("\n".join(parts[:n])) <= room), 1)
            whole = "\n".join([heading] * (heading is not None) + parts[:n])
            if len(whole) >= 3 and any(all(c.isalpha() for c in whole[i : i + 3]) for i in range(len(whole) - 2)):
                out.append((heading, whole))
            del parts[:n]
    return out


def test_paragraphs_are_those_of_packed_sections():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    say = lambda n: " ".join(word() + rng.choice(["", "", ".", ";", ","]) for _ in range(n))
    for _ in range(300):
        blocks = [(rng.choice([0, 0, 0, 2]), say(rng.randint(1, 40))) for _ in range(rng.randint(0, 12))]
        for most in (1, 20, 90, 400, 10_000):
            assert G.folded(blocks, most) == plain_paragraphs(blocks, most)
    assert G.folded([]) == [] and G.folded([(1, "A heading"), (2, "B")]) == []
    assert G.folded([(1, "T"), (0, "12"), (2, "U"), (0, "some words")]) == [("U", "U\nsome words")]
    long = "x" * 5000
    assert [t for _, t in G.folded([(0, long)])] == ["x" * 1500] * 3 + ["x" * 500]


def test_paragraphs_of_pages(spark):
    found = E.judged(spark.read.parquet(f"{SF}/pages.parquet"))
    want = set()
    for row in found.collect():
        blocks = [(b.heading_level, b.text) for r in ("main", "rest") for b in row.blocks if b.region == r]
        want |= {(row.id, i, h, t) for i, (h, t) in enumerate(plain_paragraphs(blocks, 1500))}
    got = {tuple(r) for r in QUERIES["page_paragraphs"](spark, SF).collect()}
    assert got == want and {h for _, _, h, _ in got} != {None}
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<main><h2>A</h2><p>one two<h2>B</h2><p>three</main>")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in G.paragraphs(E.judged(odd)).collect()) == [(3, 0, "A", "A\none two"), (3, 1, "B", "B\nthree")]


def plain_plan(rows, budget, seed):
    plans = {}
    for site in {r[0] for r in rows}:
        own = {r for r in rows if r[0] == site and r[3] is not None}
        best = {}
        for _, version, turn, url, mandatory, at in own:
            x = (not mandatory, turn, at, version)
            best[url] = min(best.get(url, x), x)
        must = sorted((turn, version, at, url) for url, (p, turn, at, version) in best.items() if not p)
        plan = [(url, version, "mandatory") for _, version, _, url in must]
        lanes = {}
        for url, (p, turn, _, version) in best.items():
            if p:
                lanes.setdefault((turn, version), []).append(url)
        for lane in lanes.values():
            lane.sort(key=lambda u: (hashlib.md5(f"{seed}:{u}".encode()).hexdigest(), u), reverse=True)
        while any(lanes.values()):
            plan += [(lanes[k].pop(), k[1], "product") for k in sorted(lanes) if lanes[k]]
        plans[site] = {(site, i + 1, *p) for i, p in enumerate(plan[:budget])}
    return set().union(*plans.values()) if plans else set()


def test_sample_plans_match_a_plain_planner(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(3)}", "v%d" % (v := rng.randrange(3)), v, rng.choice([None, *[f"/p{i}" for i in range(60)]]), rng.random() < 0.1, rng.randrange(9)) for _ in range(400)]
    schema = "site string, version string, turn int, url string, mandatory boolean, ord int"
    pages = spark.createDataFrame(rows, schema)
    for budget, seed in itertools.product((1, 7, 500), (1, 2)):
        want = plain_plan(rows, budget, seed)
        for parts in (1, 5):
            assert {tuple(r) for r in M.sample_plan(pages.repartition(parts), budget, seed).collect()} == want
    assert M.sample_plan(pages.limit(0), 5, 1).count() == 0
    plan = M.sample_plan(pages, 5, 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_coverage(spark):
    rows = [("eco", "a", True, ["CZ", "SK"]), ("eco", "b", False, ["DE"]), ("zoo", "c", True, ["DE", "CZ", None]), ("dur", "d", False, ["CZ"]), ("dur", "d", False, ["CZ"]), (None, "x", True, ["CZ"]), ("ucp", "e", None, None)]
    sets = spark.createDataFrame(rows, "module string, name string, enabled boolean, jurisdictions array<string>")
    got = {(r.module, r.jurisdiction): r for r in C.coverage(sets, ["dur", "eco", "lr", "zoo", "ucp", "dur"], ["CZ", "DE", "FR"]).collect()}
    assert len(got) == 15 and {k for k, r in got.items() if r.state == "ran"} == {("eco", "CZ"), ("zoo", "CZ"), ("zoo", "DE")}
    why = {k: (r.reason, r.warning, r.elsewhere, r.names) for k, r in got.items() if r.state != "ran"}
    assert why["eco", "DE"] == ("rule_set_disabled", "module_disabled", None, ["b"])
    assert why["dur", "CZ"] == ("rule_set_disabled", "module_disabled", None, ["d"])
    assert why["dur", "FR"] == ("no_rules_for_jurisdiction", "module_other_jurisdiction", ["CZ"], None)
    assert why["lr", "CZ"] == ("no_rules_for_jurisdiction", "module_no_rule_set", [], None)
    assert why["ucp", "DE"] == ("no_rules_for_jurisdiction", "module_other_jurisdiction", [], None)
    free = C.coverage(sets, None, ["CZ", "FR"]).orderBy("place", "module", "jurisdiction").collect()
    assert [(r.module, r.jurisdiction, r.state, r.warning) for r in free] == [("eco", "CZ", "ran", None), ("eco", "FR", "not_run", None), ("zoo", "CZ", "ran", None), ("zoo", "FR", "not_run", None)]
    assert sorted(r.name for r in C.selected(sets.filter("module is not null"), None, ["CZ"]).collect()) == ["a", "c"]
    assert C.coverage(sets.limit(0), None, ["CZ"]).count() == 0


FOUND = "shop long, rule string, scope string, segment long, severity long, score double, page long"


def test_findings_are_stored_once(spark, tmp_path):
    runs = [
        [(1, "r", "segment", 7, 2, 0.5, 10), (1, "r", "segment", 7, 1, 0.4, 11), (1, "r", "site", 7, 1, 0.9, None), (2, "q", "site", None, 3, 0.1, 5)],
        [(1, "r", "segment", 7, 3, 0.6, 11), (1, "r", "segment", 8, 1, 0.2, 12), (1, "r", "site", 9, 2, 0.8, 4), (1, "r", "site", 9, 2, 0.8, 4)],
    ]
    folder = str(tmp_path)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    for i, rows in enumerate(runs, 1):
        for _ in range(2):  # a run that is started again changes nothing
            S.store(spark, folder, spark.createDataFrame(rows, FOUND), i)
    rows = {(r.shop, r.rule, r.scope, r.segment): r for r in read("findings").collect()}
    assert len(rows) == read("findings").count() == 4
    seen = lambda k: (rows[k].severity, rows[k].score, rows[k].page, rows[k].occurrences, rows[k].first_run, rows[k].last_run)
    assert seen((1, "r", "segment", "7")) == (3, 0.6, 11, 1, 1, 2)
    assert seen((1, "r", "segment", "8")) == (1, 0.2, 12, 1, 2, 2)
    assert seen((1, "r", "site", None)) == (2, 0.8, 4, 1, 1, 2)
    assert seen((2, "q", "site", None)) == (3, 0.1, 5, 1, 1, 1)
    got = sorted((r.shop, r.page, r.run) for r in read("occurrences").collect())
    assert got == [(1, 4, 2), (1, 10, 1), (1, 11, 1), (1, 12, 2), (2, 5, 1)]
    closed = read("findings").withColumn("status", S.F.lit("dismissed"))
    again = S.merged(closed.drop("bucket"), S.run_findings(spark.createDataFrame(runs[1], FOUND), 3))
    assert {(r.status, r.first_run) for r in again.filter("last_run = 3").collect()} == {("dismissed", 1), ("dismissed", 2)}
    S.store(spark, folder, spark.createDataFrame([], FOUND), 4)
    assert read("findings").count() == 4


def test_get_or_insert(spark):
    old = spark.createDataFrame([("eco", "1", 5), (None, "1", 6)], "module string, version string, id long")
    new = spark.createDataFrame([("eco", "1", 9), ("eco", "2", 8), ("eco", "2", 7), (None, "1", 4)], "module string, version string, id long")
    assert {tuple(r) for r in S.inserted(old, new, ["module", "version"], "id").collect()} == {("eco", "1", 5), (None, "1", 6), ("eco", "2", 7)}


def test_list_faults(spark):
    tiers = spark.createDataFrame([(1, "a", 0, 9), (1, "b", 10, 19), (1, "c", 21, None), (2, "a", 0, None), (2, "b", 5, 6), (2, "c", 6, 9)], "k int, code string, low int, high int")
    assert {tuple(r) for r in P.list_faults(tiers, "k", "code").collect()} == {(1, "b", "gap"), (2, "a", "overlap"), (2, "b", "overlap")}
