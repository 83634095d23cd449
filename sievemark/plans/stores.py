"""Queries on paragraphs of pages, sample plans, coverage of rule sets, stored findings and tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import finding_store as S
from ..operators import paragraphs as G
from ..operators import pricing as P
from ..operators import samples as M
from ..sources import elements as E
from .registry import query, table


@query()
def page_paragraphs(spark, sf_dir):
    """GEN-05: paragraphs of all pages with the nearest heading; held against a fold of the blocks in the tests."""
    found = G.paragraphs(E.judged(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "paragraph", "heading", "text")


SEED, BUDGET = 11, 40


@query(f"""with p as (select source as site, lang as version, dense_rank() over (partition by source order by lang nulls first) as turn, 'doc/' || doc_id as url,
contains(lower(text), 'license') as mandatory, doc_id as ord from documents),
o as (select site, url, turn, version, ord, not coalesce(mandatory, false) as product from p),
k as (select *, case when product then md5('{SEED}:' || url) else lpad(ord::varchar, 20, '0') end as key from o),
r as (select *, row_number() over (partition by site, product, turn, version order by key, url) as round from k),
w as (select *, row_number() over (partition by site order by product, case when product then round else 0 end, turn, version, key, url) as place from r)
select site, place, url, version, case when product then 'product' else 'mandatory' end as kind from w where place <= {BUDGET}""")
def sample_plan(spark, sf_dir):
    """GEN-11: mandatory pages of each site, then its versions in turn by a seeded order; the budget is the feature."""
    d = table(spark, sf_dir, "documents")
    turns = d.select("source", "lang").distinct().groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    turn = F.array_position("langs", F.col("lang")).cast("long")
    pages = d.join(turns, "source").select(
        F.col("source").alias("site"), F.col("lang").alias("version"), turn.alias("turn"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.coalesce(F.lower("text").contains("license"), F.lit(False)).alias("mandatory"), F.col("doc_id").alias("ord"),
    )
    return M.sample_plan(pages, BUDGET, SEED)


MODULES, COUNTRIES = ["Brand#1", "Brand#2", "Brand#25", "Brand#99"], [f"NATION_{i}" for i in range(8)] + ["ATLANTIS"]
SETS = """r as (select p_brand as module, p_type as name, avg(l_tax) > 0.05 as enabled, n_name as jurisdiction
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_discount = 0 group by all)"""


def rule_sets(spark, sf_dir):
    """Stand-ins: types of parts of a brand are its rule sets, for the nations that sell them without a discount."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").filter("l_discount = 0").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    each = rows.groupBy(F.col("p_brand").alias("module"), F.col("p_type").alias("name"), F.col("n_name").alias("country"))
    return each.agg((F.avg("l_tax") > 0.05).alias("enabled")).select("module", "name", "enabled", F.array("country").alias("jurisdictions"))


@query(f"""with {SETS}, cells as (select unnest([{", ".join(f"'{m}'" for m in MODULES)}]) as module, j.* from (select unnest([{", ".join(f"'{c}'" for c in COUNTRIES)}]) as jurisdiction) j),
here as (select module, jurisdiction, bool_or(enabled) as runs, list_sort(list(distinct name)) as names from r group by all),
everywhere as (select module, list_sort(list(distinct jurisdiction)) as places from r group by all)
select module, jurisdiction, case when runs then 'ran' else 'not_run' end as state, case when runs is null then 'no_rules_for_jurisdiction' when not runs then 'rule_set_disabled' end as reason,
case when places is null then 'module_no_rule_set' when runs is null then 'module_other_jurisdiction' when not runs then 'module_disabled' end as warning,
case when runs is null then coalesce(array_to_string(places, ','), '') end as elsewhere, case when not runs then array_to_string(names, ',') end as names
from cells left join here using (module, jurisdiction) left join everywhere using (module)""")
def coverage_matrix(spark, sf_dir):
    """DOM-06: modules by jurisdictions, with gaps, disabled sets and warnings; brands stand for modules."""
    found = C.coverage(rule_sets(spark, sf_dir), MODULES, COUNTRIES)
    return found.select("module", "jurisdiction", "state", "reason", "warning", F.array_join("elsewhere", ",").alias("elsewhere"), F.array_join("names", ",").alias("names"))


def line_findings(spark, sf_dir):
    """Stand-ins for findings: a customer's lines by priority; returned or shipped parts are segments, open ones the site."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("shop"), F.col("o_orderpriority").alias("rule"), F.when(F.col("l_returnflag") == "N", "site").otherwise("segment").alias("scope"),
        F.col("l_partkey").alias("segment"), F.col("l_linenumber").cast("long").alias("severity"), F.col("l_quantity").cast("double").alias("score"),
        F.col("l_orderkey").alias("page"), F.year("l_shipdate").alias("year"),
    )


LINES = """f as (select o_custkey as shop, o_orderpriority as rule, case when l_returnflag = 'N' then 'site' else 'segment' end as scope, case when l_returnflag <> 'N' then l_partkey::varchar end as segment,
l_linenumber::bigint as severity, l_quantity::double as score, l_orderkey as page, case when year(l_shipdate) < 1998 then 1 else 2 end as run from lineitem join orders on l_orderkey = o_orderkey)"""


def two_runs(found):
    """The findings of two runs: shipped before 1998, and from then on."""
    return found.filter("year < 1998").drop("year"), found.filter("year >= 1998").drop("year")


@query(f"""with {LINES}, g as (select shop, rule, scope, segment, run, min(struct_pack(a := severity, b := -score)) as x, min(page) as page, count(distinct page) as occurrences from f group by all)
select shop, rule, scope, segment, arg_max(x.a, run) as severity, arg_max(-x.b, run) as score, arg_max(page, run) as page, arg_max(occurrences, run) as occurrences,
'open' as status, min(run)::bigint as first_run, max(run)::bigint as last_run from g group by all""")
def stored_findings(spark, sf_dir):
    """SNK-12: findings of two runs merged by identity; the first run stays, the rest is the last run's."""
    one, two = two_runs(line_findings(spark, sf_dir))
    return S.merged(S.run_findings(one, 1), S.run_findings(two, 2)).drop("finding_id")


@query(f"""with {LINES} select shop, rule, scope, segment, page, min(run)::bigint as run from f group by shop, rule, scope, segment, page""")
def stored_occurrences(spark, sf_dir):
    """SNK-12, SET-02: pages of findings inserted once, with the run that did; of known ones the row stays."""
    found = S.identified(line_findings(spark, sf_dir))
    names = found.select("finding_id", *S.IDENTITY).distinct().drop("shop")
    one, two = two_runs(found.drop("finding_id"))
    rows = S.inserted(S.occurrences(one, 1), S.occurrences(two, 2), ["finding_id", "page"], "run")
    return rows.join(names, "finding_id").select(*S.IDENTITY, "page", "run")


@query("""with t as (select s_nationkey, s_suppkey, floor(s_acctbal)::bigint as low, floor(s_acctbal)::bigint + 400 as high from supplier),
n as (select *, lead(low) over (partition by s_nationkey order by low, s_suppkey) as nxt from t)
select s_nationkey, s_suppkey, case when nxt > high + 1 then 'gap' else 'overlap' end as fault from n where nxt is not null and nxt <> high + 1""")
def tier_list_faults(spark, sf_dir):
    """DOM-14: gaps and overlaps of each nation's tiers; suppliers' balances stand for their lower bounds."""
    low = F.floor("s_acctbal").cast("long")
    tiers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", low.alias("low"), (low + 400).alias("high"))
    return P.list_faults(tiers, "s_nationkey", "s_suppkey")
