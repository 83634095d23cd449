"""Queries on events: queue, usage, versions, rates and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import versions as V
from ..operators import work_queue as Q
from ..operators.ranks import ranked
from .registry import query, table

K = "cast(json_extract_string(props, '$.k') as int)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def k():
    return F.get_json_object("props", "$.k").cast("int")


@query(f"""with ready as (select user_id as tenant, {K} % 4 as priority, event_id as id from events where event_type <> 'purchase'),
running as (select user_id as tenant, count(*) as n from events where event_type = 'purchase' and value > 50 group by user_id),
r as (select *, row_number() over (partition by tenant order by priority, id) as rn from ready)
select r.tenant, r.id, rn::bigint as rn from r left join running using (tenant) where coalesce(n, 0) + rn <= 3""")
def queue_claim(spark, sf_dir):
    """WIN-01, FLT-17, JOIN-03."""
    e = events(spark, sf_dir)
    ready = e.filter("event_type <> 'purchase'").select(F.col("user_id").alias("tenant"), (k() % 4).alias("priority"), F.col("event_id").alias("id"))
    running = e.filter("event_type = 'purchase' and value > 50").groupBy(F.col("user_id").alias("tenant")).agg(F.count("*").alias("n"))
    return Q.claim(ready, running, 3).select("tenant", "id", F.col("rn").cast("long").alias("rn"))


@query(f"""select user_id, arg_min(event_id, ({K} % 4, event_id)) as id, min({K} % 4)::bigint as priority from events group by user_id""")
def queue_key_head(spark, sf_dir):
    """WIN-04."""
    jobs = events(spark, sf_dir).select("user_id", F.col("event_id").alias("id"), (k() % 4).cast("long").alias("priority"))
    return Q.heads(jobs, "user_id").select("user_id", "id", "priority")


@query("""with s as (select user_id, event_type, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as s from events group by all)
select event_type, sum(s)::bigint as seconds, round(sum(s) / (select count(distinct user_id) from events), 4) as mean from s group by event_type""")
def step_durations(spark, sf_dir):
    """AGG-16, JOIN-14."""
    out = Q.step_durations(events(spark, sf_dir), "user_id", "event_type", "ts")
    return out.select("event_type", "seconds", F.round("mean", 4).alias("mean"))


@query("""with s as (select event_type, row_number() over (order by event_type) as idx, count(*) as n from events group by event_type),
u as (select user_id, max(event_type) as cur from events group by user_id)
select user_id, (cn.n + coalesce(sum(l.n), 0))::bigint as remaining from u join s cn on cn.event_type = u.cur left join s l on l.idx > cn.idx group by user_id, cn.n""")
def queue_eta(spark, sf_dir):
    """MTH-06: the current step and all later ones; the table of steps is as small as the kinds of steps."""
    e = events(spark, sf_dir)
    steps = e.groupBy("event_type").agg(F.count("*").alias("n")).groupBy().agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("steps"))
    later = F.aggregate(F.filter("steps", lambda s: s["event_type"] >= F.col("cur")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return e.groupBy("user_id").agg(F.max("event_type").alias("cur")).join(F.broadcast(steps)).select("user_id", later.alias("remaining"))


@query("""select date_trunc('day', ts)::date as day, event_type, count(*) as n, sum(cast(value as decimal(18,4)))::decimal(28,4) as total from events group by all""")
def usage_daily(spark, sf_dir):
    """AGG-14, DT-06, SNK-13."""
    day = F.to_date("ts").alias("day")
    return events(spark, sf_dir).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("total"))


@query(f"""select case when {K} < 20 then 'blocked' when {K} < 50 then 'timeout' when {K} is null then 'unknown' else 'other' end as reason,
count(*) as n, count(distinct user_id) as users from events where event_type not in ('purchase') group by all""")
def unchecked_report(spark, sf_dir):
    """AGG-15, AGG-32, FLT-22."""
    reason = F.when(k() < 20, "blocked").when(k() < 50, "timeout").when(k().isNull(), "unknown").otherwise("other")
    return events(spark, sf_dir).filter("event_type not in ('purchase')").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""select user_id, count(*) as changes, count(*) filter (value > 50) as large, count(*) + count(*) filter (value > 50) as version,
max(ts) as last_at, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id""")
def change_version(spark, sf_dir):
    """AGG-11, AGG-22, AGG-23, WIN-05."""
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("changes"), F.count_if(F.col("value") > 50).alias("large"),
        (F.count("*") + F.count_if(F.col("value") > 50)).alias("version"), F.max("ts").alias("last_at"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


@query("""select * exclude (rn, props) from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def latest_per_key(spark, sf_dir):
    """WIN-07, SET-03."""
    return V.latest(events(spark, sf_dir).drop("props"), ["user_id", "event_type"], "ts", "event_id")


@query("""with c as (select user_id, ts, event_id, event_type, lag(event_type) over w as p, row_number() over w as rn from events window w as (partition by user_id order by ts, event_id))
select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_to,
lead(ts) over (partition by user_id order by ts, event_id) is null as current from c where rn = 1 or p is distinct from event_type""")
def scd2_versions(spark, sf_dir):
    """SNK-11, DOM-26."""
    return V.scd2(events(spark, sf_dir), ["user_id"], "event_type", "ts", "event_id")


@query("""with o as (select user_id, event_type, count(*) as attempts, max(value) as v, min(ts) as first_at from events where event_id % 2 = 0 group by all),
n as (select user_id, event_type, count(*) as attempts, max(value) as v, max(ts) as first_at from events where event_id % 2 = 1 group by all),
os as (select *, case when v > 80 then 'done' else 'pending' end as state from o), ns as (select *, case when v > 90 then 'done' else 'pending' end as state from n)
select coalesce(os.user_id, ns.user_id) as user_id, coalesce(os.event_type, ns.event_type) as event_type,
case when ns.state is null then os.state when os.state = 'done' and ns.state = 'pending' then 'done' else ns.state end as state,
coalesce(os.attempts, 0) + coalesce(ns.attempts, 0) as attempts, coalesce(ns.first_at, os.first_at) as first_at
from os full join ns on os.user_id = ns.user_id and os.event_type = ns.event_type""")
def upsert_states(spark, sf_dir):
    """SNK-09, SNK-10, SNK-12, SET-02."""
    e = events(spark, sf_dir)

    def side(odd, limit, at):
        g = e.filter(F.col("event_id") % 2 == odd).groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"), F.max("value").alias("v"), at("ts").alias("first_at"))
        return g.withColumn("state", F.when(F.col("v") > limit, "done").otherwise("pending")).drop("v")

    return V.upsert(side(0, 80, F.min), side(1, 90, F.max), ["user_id", "event_type"], ["attempts"], ("done",), "state")


@query("""select event_id, event_type, user_id from events where event_id > 4200 order by event_id limit 100""")
def event_replay(spark, sf_dir):
    """STM-08: the limit is the feature, a bounded page of a replay."""
    return events(spark, sf_dir).filter("event_id > 4200").orderBy("event_id").limit(100).select("event_id", "event_type", "user_id")


@query(f"""select event_id, least(5.0::double * pow(2.0::double, {K} % 12), 3600.0::double) as seconds from events""")
def retry_backoff(spark, sf_dir):
    """MTH-05."""
    return events(spark, sf_dir).select("event_id", N.backoff(k() % 12 + 1).alias("seconds"))


@query()
def token_bucket(spark, sf_dir):
    """STM-03; a fold, held against plain Python in the tests."""
    state = Q.token_bucket(F.col("ts").cast("timestamp").cast("double"), F.lit(1.0), 5.0, 0.0005)
    return events(spark, sf_dir).groupBy("user_id").agg(state.alias("s")).select("user_id", F.round("s.tokens", 6).alias("tokens"), "s.granted", "s.denied")


@query()
def adaptive_rate(spark, sf_dir):
    """STM-04; a fold, held against plain Python in the tests."""
    status = F.when(k() < 5, 429).when(k() < 10, 500).otherwise(200)
    rate = Q.adaptive_rate(F.struct("ts", "event_id"), status, F.col("value") / 40.0)
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(rate, 6).alias("rate"))


@query(f"""with x as (select user_id, {K} as kk, row_number() over (partition by user_id order by ts, event_id) as pos, event_id from events),
p as (select user_id, pos, event_id, case when kk % 3 <> 0 then event_id end as page from x)
select user_id, event_id, pos::bigint as pos, last_value(page ignore nulls) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding) as prev_page,
first_value(page ignore nulls) over (partition by user_id order by pos rows between 1 following and unbounded following) as next_page from p""")
def page_neighbours(spark, sf_dir):
    """WIN-10."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = events(spark, sf_dir).select("user_id", "event_id", F.when(k() % 3 != 0, F.col("event_id")).alias("page"), F.row_number().over(w).cast("long").alias("pos"))
    by = Window.partitionBy("user_id").orderBy("pos")
    return p.select(
        "user_id", "event_id", "pos", F.last("page", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_page"),
        F.first("page", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("next_page"),
    )


@query(f"""select event_id, case when {K} % 2 = 0 then 'open' else 'fixed' end as from_state, case when value > 50 then 'fixed' else 'closed' end as to_state,
(case when {K} % 2 = 0 then 'open' else 'fixed' end, case when value > 50 then 'fixed' else 'closed' end) in (('open', 'fixed'), ('fixed', 'closed')) as legal
from events where {K} is not null""")
def state_transitions(spark, sf_dir):
    """DOM-15."""
    changes = events(spark, sf_dir).filter(k().isNotNull()).select("event_id", F.when(k() % 2 == 0, "open").otherwise("fixed").alias("from_state"), F.when(F.col("value") > 50, "fixed").otherwise("closed").alias("to_state"))
    legal = spark.createDataFrame([("open", "fixed"), ("fixed", "closed")], "from_state string, to_state string")
    return V.allowed(changes, legal).select("event_id", "from_state", "to_state", "legal")


@query(f"""with f as (select event_id, user_id, {K} as kk, event_type from events),
held as (select distinct user_id from f where event_type = 'purchase' and kk > 97)
select event_id, user_id from f where event_type = 'click' and kk < 30 and not exists (select 1 from held where held.user_id = f.user_id)""")
def reopen_anti_join(spark, sf_dir):
    """JOIN-05, JOIN-06, DOM-20."""
    f = events(spark, sf_dir).withColumn("kk", k())
    held = f.filter("event_type = 'purchase' and kk > 97").select("user_id").distinct()
    return f.filter("event_type = 'click' and kk < 30").join(held, "user_id", "left_anti").select("event_id", "user_id")


@query("""with r as (select user_id, min(ts) as started from events where event_type = 'view' group by user_id), d as (select user_id, max(ts) as ended from events where event_type = 'purchase' group by user_id)
select user_id, bool_and(value > 1) as all_ok, bool_or(value > 99) as any_bad,
case when bool_and(value > 1) then 'ok' when bool_or(value > 99) then 'partial' else 'failed' end as code from events group by user_id""")
def run_outcome(spark, sf_dir):
    """DOM-27."""
    ok, bad = F.bool_and(F.col("value") > 1), F.bool_or(F.col("value") > 99)
    return events(spark, sf_dir).groupBy("user_id").agg(ok.alias("all_ok"), bad.alias("any_bad"), F.when(ok, "ok").when(bad, "partial").otherwise("failed").alias("code"))


@query(f"""select event_id, {K} as k, json_exists(props, '$.k') as has_k, '{{"id":' || event_id || ',"type":"' || event_type || '"}}' as doc from events""")
def event_json(spark, sf_dir):
    """JSN-01, SNK-04."""
    m = F.from_json("props", "map<string,string>")
    return events(spark, sf_dir).select("event_id", k().alias("k"), F.coalesce(F.map_contains_key(m, F.lit("k")), F.lit(False)).alias("has_k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query("""select lower(event_type) || coalesce(nullif('-' || rn, '-1'), '') as name, event_id from (select *, row_number() over (partition by lower(event_type) order by event_id) as rn from events)""")
def unique_names(spark, sf_dir):
    """SNK-14: unique names by a running number."""
    named = events(spark, sf_dir).select(F.lower("event_type").alias("kind"), "event_id")
    n = F.col("n")
    return ranked(named, ["kind"], ["event_id"], "n").select(F.concat("kind", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")).alias("name"), "event_id")


@query("""select event_id, timezone('Europe/Prague', timezone('UTC', ts))::date as local_day from events""")
def local_days(spark, sf_dir):
    """DT-03."""
    return events(spark, sf_dir).select("event_id", N.local_day(F.col("ts"), "Europe/Prague").alias("local_day"))


@query("""select * from (select *, row_number() over (partition by user_id order by hash % 1000, event_id) as rn from (select user_id, event_id, event_id * 7919 as hash from events)) where rn <= 2""")
def seeded_sample(spark, sf_dir):
    """GEN-11: a sampling operator; two rows of each key by a seeded order."""
    h = events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") * 7919).alias("hash"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("hash") % 1000, "event_id")).cast("long")
    return h.withColumn("rn", rn).filter("rn <= 2")


@query(f"""with x as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as round from events)
select event_id, round::bigint as round, (row_number() over (order by round, user_id) - 1) // 100 as batch from x where round <= 2""")
def interleaved(spark, sf_dir):
    """GEN-10, GEN-12: one of each key in turn, in batches by the place among all; both numbers are ranks by ranges."""
    turns = ranked(events(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "round").filter("round <= 2")
    placed = ranked(turns, [], ["round", "user_id"], "at")
    return placed.select("event_id", "round", F.floor((F.col("at") - 1) / 100).cast("long").alias("batch"))
