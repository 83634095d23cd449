"""Queries on orders, customers and markets: prices, subscriptions, evidence, places of sale."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import pricing as P
from ..operators import versions as V
from .registry import query, table

TIERS = [("t500", 0, 10, "39.00"), ("t2000", 11, 16, "69.00"), ("t5000", 17, 24, "119.00"), ("custom", 25, None, "0.00")]
STEPS = [(1, 0), (3, 5), (10, 10), (20, 15)]
TIER_SQL = "t(code, low, high, price) as (values ('t500', 0, 10, 39.00), ('t2000', 11, 16, 69.00), ('t5000', 17, 24, 119.00), ('custom', 25, null, 0.00))"
STEP_SQL = "s(lo, percent) as (values (1, 0), (3, 5), (10, 10), (20, 15))"
COUNTS = "c as (select o_custkey, count(*) as n from orders group by o_custkey)"


def tiers(spark):
    return spark.createDataFrame(TIERS, "code string, low long, high long, price string").withColumn("price", F.col("price").cast("decimal(12,2)"))


def steps(spark):
    return spark.createDataFrame(STEPS, "at int, percent int")


def counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(f"with {COUNTS}, {TIER_SQL} select o_custkey, n, code from c left join t on n >= low and (high is null or n <= high)")
def tier_resolve(spark, sf_dir):
    """JOIN-10."""
    return P.tier(counts(spark, sf_dir), "n", tiers(spark)).select("o_custkey", "n", "code")


@query(f"with {COUNTS}, {STEP_SQL} select o_custkey, n, (select arg_max(percent, lo) from s where lo <= n)::int as percent from c")
def volume_discount_asof(spark, sf_dir):
    """JOIN-11."""
    return P.as_of(counts(spark, sf_dir), "n", steps(spark), "at", "percent").select("o_custkey", "n", "percent")


@query(f"""with {COUNTS}, {TIER_SQL}, {STEP_SQL}, j as (select o_custkey, n, code, t.price::decimal(12,2) as price, (select arg_max(percent, lo) from s where lo <= n) as percent from c left join t on n >= low and (high is null or n <= high))
select o_custkey, code, case when code = 'custom' then 'custom' else 'priced' end as status, round(price * (100 - percent) / 100.0, 2)::decimal(18,2) as net,
round(round(price * (100 - percent) / 100.0, 2) * 0.21, 2)::decimal(18,2) as vat,
floor(1.5::double * greatest(n, 1))::bigint as fair_use from j""")
def price_quote(spark, sf_dir):
    """DOM-13, MTH-02, MTH-03, MTH-04."""
    q = P.as_of(P.tier(counts(spark, sf_dir), "n", tiers(spark)), "n", steps(spark), "at", "percent")
    net = N.money(F.col("price") * (100 - F.col("percent")) / 100)
    tax, _ = N.vat(net, F.lit("0.21").cast("decimal(6,4)"))
    return q.select("o_custkey", "code", F.when(F.col("code") == "custom", "custom").otherwise("priced").alias("status"), net.alias("net"), tax.alias("vat"), N.fair_use(F.col("n"), 1.5).alias("fair_use"))


@query("""select c_custkey, case when c_nationkey = 3 then 'domestic' when c_nationkey in (6, 7, 19) and c_custkey % 2 = 0 then 'reverse_charge'
when c_nationkey in (6, 7, 19) then 'one_stop' else 'export' end as treatment from customer""")
def vat_treatment(spark, sf_dir):
    """MTH-03."""
    country = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", N.vat_treatment(country, "3", F.col("c_custkey") % 2 == 0, ["6", "7", "19"]).alias("treatment"))


@query("""select l_returnflag, sum(round(cast(l_extendedprice as decimal(18,6)) * 0.21, 2))::decimal(28,2) as vat,
sum(round(cast(l_extendedprice as decimal(18,6)), 2))::decimal(28,2) as net from lineitem group by l_returnflag""")
def vat_split(spark, sf_dir):
    """MTH-02, MTH-03."""
    net = F.col("l_extendedprice").cast("decimal(18,6)")
    tax, _ = N.vat(net, F.lit("0.21").cast("decimal(6,4)"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(tax).cast("decimal(28,2)").alias("vat"), F.sum(N.money(net)).cast("decimal(28,2)").alias("net"))


@query("""select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as ordinal from orders""")
def subscription_ordinals(spark, sf_dir):
    """WIN-02."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("ordinal"))


@query("""select o_custkey, o_orderkey, o_orderdate from (select *, rank() over (partition by o_custkey order by date_trunc('day', o_orderdate)) as r from orders where o_orderstatus = 'P') where r = 1""")
def earliest_changes(spark, sf_dir):
    """WIN-06."""
    w = Window.partitionBy("o_custkey").orderBy(F.date_trunc("day", "o_orderdate"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumn("r", F.rank().over(w))
    return o.filter("r = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("""select * from (select o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders)
where previous is null or previous <> o_orderpriority""")
def price_phases(spark, sf_dir):
    """WIN-08."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return V.price_phases(o, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("""select o_orderkey, case when d < 0 then 'expired' when d <= 30 then 'expiring' else 'valid' end as status from
(select o_orderkey, date_diff('day', date '1998-06-01', o_orderdate::date) as d from orders)""")
def evidence_status(spark, sf_dir):
    """DT-02."""
    today = F.to_date(F.lit("1998-06-01"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.evidence_status(F.to_date("o_orderdate"), today).alias("status"))


@query("""select o_custkey, count(*) filter (d > 30) as valid, count(*) filter (d between 0 and 30) as expiring, count(*) filter (d < 0) as expired, count(distinct o_orderpriority) filter (d >= 0) as covered from
(select *, date_diff('day', date '1998-06-01', o_orderdate::date) as d from orders) group by o_custkey""")
def evidence_stats(spark, sf_dir):
    """AGG-27, AGG-28."""
    s = N.evidence_status(F.to_date("o_orderdate"), F.to_date(F.lit("1998-06-01")))
    return table(spark, sf_dir, "orders").withColumn("s", s).groupBy("o_custkey").agg(
        *[F.count_if(F.col("s") == x).alias(x) for x in ("valid", "expiring", "expired")],
        F.count_distinct(F.when(F.col("s") != "expired", F.col("o_orderpriority"))).alias("covered"),
    )


@query("""select o_orderkey, (select min(o_orderdate::date + to_months(k::int)) from range(0, 481, 3) as r(k) where o_orderdate::date + to_months(k::int) >= timestamp '1999-01-15')::date as next_day from orders""")
def next_period(spark, sf_dir):
    """DT-04."""
    floor = F.to_date(F.lit("1999-01-15"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.next_period(F.to_date("o_orderdate"), 3, floor, 480).alias("next_day"))


@query("""select date_trunc('month', o_orderdate)::date as month, o_orderstatus, count(*) as n, sum(cast(o_totalprice as decimal(18,2)))::decimal(28,2) as total, count(distinct o_custkey) as customers from orders group by all""")
def monthly_totals(spark, sf_dir):
    """AGG-24, AGG-25, DT-06."""
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")
    return table(spark, sf_dir, "orders").groupBy(month, "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query("""with d as (select p_partkey, p_brand, cast(p_retailprice as decimal(12,2)) as old, round(cast(p_retailprice as decimal(12,2)), -1) as draft from part)
select p_brand, count(*) filter (draft > old) as up, count(*) filter (draft < old) as down, count(*) filter (draft = old) as same from d group by p_brand""")
def price_impact(spark, sf_dir):
    """AGG-26: prices of a draft list (here rounded to tens) against those that hold."""
    old = F.col("p_retailprice").cast("decimal(12,2)")
    draft = F.round(old, -1)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(draft > old).alias("up"), F.count_if(draft < old).alias("down"), F.count_if(draft == old).alias("same"))


@query("""with f as (select o_orderkey, o_custkey, o_orderpriority, o_totalprice from orders)
select o_orderkey, o_orderpriority from f where (o_orderpriority, o_orderkey) > ('2-HIGH', 500) order by o_orderpriority, o_orderkey limit 26""")
def findings_page(spark, sf_dir):
    """SRT-05, SRT-11: keyset paging; the limit is the feature."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return V.page_after(o, {"o_orderpriority": "2-HIGH", "o_orderkey": 500}, ["o_orderpriority", "o_orderkey"])


@query("""select c_mktsegment, count(*) as all_items, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus = 'F') as fixed,
count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as urgent, count(distinct c_custkey) as owners from orders join customer on o_custkey = c_custkey group by c_mktsegment""")
def findings_tabs(spark, sf_dir):
    """AGG-11, AGG-12, JOIN-01, FLT-13, FLT-15."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(
        F.count("*").alias("all_items"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("fixed"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"), F.count_distinct("c_custkey").alias("owners"),
    )


@query("""with w as (select o_custkey as key, c_name as title, count(*) as n, min(o_orderpriority) as rank from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by all)
select key, title, n, rank from w union all select -1, 'whole site', count(*), min(o_orderpriority) from orders where o_orderstatus = 'P'""")
def work_items(spark, sf_dir):
    """AGG-13, SET-01, SRT-06."""
    o = table(spark, sf_dir, "orders")
    pages = o.filter("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("rank"))
    named = pages.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title")), "key")
    whole = o.filter("o_orderstatus = 'P'").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("rank")).select(F.lit(-1).cast("long").alias("key"), F.lit("whole site").alias("title"), "n", "rank")
    return named.select("key", "title", "n", "rank").unionByName(whole)


@query("""with li as (select case when l_quantity > 25 then l_orderkey end as own, l_orderkey + 1 as next, l_partkey as id from lineitem where l_linenumber = 1),
x as (select o_orderkey, 0 as i, id from orders join li on own = o_orderkey union all select o_orderkey, 1, id from orders join li on next = o_orderkey),
b as (select o_orderkey, min((i, id)) as b from x group by o_orderkey)
select o_orderkey, b[2] as id from orders left join b using (o_orderkey)""")
def first_match(spark, sf_dir):
    """JOIN-18, JOIN-02: any of two keys, by a union of equi joins; the neighbour's part where the order's own is no large one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("other"))
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    li = li.select(F.when(F.col("l_quantity") > 25, F.col("l_orderkey")).alias("o_orderkey"), (F.col("l_orderkey") + 1).alias("other"), F.col("l_partkey").alias("id"))
    return P.first_of_keys(o, li, ["o_orderkey", "other"], "id", "o_orderkey").select("o_orderkey", "id")


@query("""select c_custkey, coalesce(s.v, a.v, 30)::bigint as setting from customer c left join (select c_custkey as k, c_custkey % 7 as v from customer where c_custkey % 10 = 0) s on s.k = c.c_custkey
left join (select n_nationkey as k, n_regionkey * 10 as v from nation where n_nationkey % 2 = 0) a on a.k = c.c_nationkey""")
def override_chain(spark, sf_dir):
    """JOIN-04, JOIN-17: shop over account over default."""
    c = table(spark, sf_dir, "customer")
    shop = c.filter("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") % 7).alias("a"))
    account = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") * 10).alias("b"))
    return c.join(shop, "c_custkey", "left").join(account, "c_nationkey", "left").select("c_custkey", F.coalesce("a", "b", F.lit(30)).cast("long").alias("setting"))


@query("""select s_nationkey::bigint as nation, case when bool_or(s_acctbal < 0) then null else sum(cast(s_acctbal as decimal(18,2)))::decimal(28,2) end as total from supplier group by s_nationkey""")
def strict_totals(spark, sf_dir):
    """AGG-21: unknown if any part is."""
    s = table(spark, sf_dir, "supplier").withColumn("v", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("decimal(18,2)")))
    return s.groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.when(~F.bool_or(F.col("v").isNull()), F.sum("v").cast("decimal(28,2)")).alias("total"))


@query("""with m as (select n_nationkey, n_name, n_regionkey from nation), v as (select s_nationkey, count(*) as versions from supplier group by s_nationkey)
select n_name as market, coalesce(versions, 0) as own, case when versions is null then 'main' else 'own' end as version,
row_number() over (partition by n_regionkey order by coalesce(versions, 0) desc, n_name) as place from m left join v on s_nationkey = n_nationkey""")
def market_plan(spark, sf_dir):
    """DOM-09, DOM-06, SRT-07, SRT-08."""
    v = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("versions"))
    m = table(spark, sf_dir, "nation").join(v, "n_nationkey", "left")
    own = F.coalesce("versions", F.lit(0)).cast("long")
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("own"), "n_name")
    m = m.withColumn("own", own)
    return m.select(F.col("n_name").alias("market"), "own", F.when(F.col("versions").isNull(), "main").otherwise("own").alias("version"), F.row_number().over(w).cast("long").alias("place"))


@query("""with e as (select upper(n_name) as country, case when s_acctbal > 5000 then 0 when s_acctbal > 0 then 1 else 2 end as level, s_name from supplier join nation on n_nationkey = s_nationkey)
select country, min(level)::int as level, count(*) as reasons, string_agg(s_name, '; ' order by s_name) as names from e where level < 2 group by country""")
def places_of_sale(spark, sf_dir):
    """AGG-20, DOM-10."""
    level = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    j = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    j = j.select(F.upper("n_name").alias("country"), level.alias("level"), "s_name").filter("level < 2")
    return j.groupBy("country").agg(F.min("level").alias("level"), F.count("*").alias("reasons"), F.array_join(F.array_sort(F.collect_list("s_name")), "; ").alias("names"))


@query("""with x as (select p_brand, p_type, list_sort(list(distinct p_size)) as sizes from part group by all)
select a.p_brand, a.p_type, round(len(list_intersect(a.sizes, b.sizes)) / len(list_distinct(list_concat(a.sizes, b.sizes))), 6) as similarity
from x a join x b on a.p_brand = b.p_brand and a.p_type < b.p_type""")
def jaccard(spark, sf_dir):
    """SET-04, SET-05, SET-06, ARR-01."""
    x = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_set("p_size").alias("sizes"))
    y = x.select("p_brand", F.col("p_type").alias("other"), F.col("sizes").alias("theirs"))
    j = x.join(y, "p_brand").filter("p_type < other")
    return j.select("p_brand", "p_type", F.round(N.jaccard(F.col("sizes"), F.col("theirs")), 6).alias("similarity"))


@query("""select o_orderstatus, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders) where r <= 5""")
def sample_top(spark, sf_dir):
    """SRT-03, SRT-10: a top-k report."""
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("""select c_custkey, replace(replace('{name} in {segment}', '{name}', c_name), '{segment}', c_mktsegment) as line, regexp_replace(lower(regexp_replace(c_mktsegment, '([A-Z])', '_\\1', 'g')), '^_', '') as snake from customer""")
def rendered_lines(spark, sf_dir):
    """STR-20, STR-22."""
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.rendered(F.lit("{name} in {segment}"), values).alias("line"), T.snake(F.col("c_mktsegment")).alias("snake"))


@query("""select o_orderpriority, o_orderstatus, list_sum(list_value(count(*)))::bigint as n from orders group by all""")
def severity_counts(spark, sf_dir):
    """AGG-10, AGG-33."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""select o_custkey, o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_quantity > 45)
and o_custkey not in (select c_custkey from customer where c_acctbal < 0)""")
def semi_and_anti(spark, sf_dir):
    """JOIN-05, JOIN-06."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    big = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(big, "o_orderkey", "left_semi").join(poor, "o_custkey", "left_anti").select("o_custkey", "o_orderkey")
