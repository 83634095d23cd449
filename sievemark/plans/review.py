"""Queries around findings: questions, groups, proposals, reviews, frontiers and versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import phrases as H
from ..operators import pricing as P
from ..operators import segments as S
from ..operators import workflow as W
from .registry import query, table

K = "cast(json_extract_string(props, '$.k') as int)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("kk", F.get_json_object("props", "$.k").cast("int"))


@query(f"""with e as (select *, {K} as kk from events), a as (select event_type, kk, arg_max('answer ' || event_id, (ts, event_id)) as answer from e where event_id % 5 = 0 group by all)
select e.event_id as question, a.answer from e left join a on e.event_type = a.event_type and e.kk = a.kk""")
def answer_propagation(spark, sf_dir):
    """DOM-16."""
    e = events(spark, sf_dir)
    answers = e.filter("event_id % 5 = 0").select("event_type", "kk", F.col("event_id").alias("question"), F.concat(F.lit("answer "), "event_id").alias("answer"), F.col("ts").alias("at"))
    return W.propagated(answers, e.select("event_type", "kk", F.col("event_id").alias("question")), ["event_type", "kk"]).select("question", "answer")


@query(f"""with a as (select user_id as segment, event_type as q, {K} % 3 as d from events), r as (select segment, q, dense_rank() over (partition by segment, q order by d) as part from a)
select segment, part::bigint as part, string_agg(distinct q, ',' order by q) as questions from r group by all""")
def request_grouping(spark, sf_dir):
    """DOM-02."""
    asked = events(spark, sf_dir).select(F.col("user_id").alias("segment"), F.col("event_type").alias("q"), (F.col("kk") % 3).alias("d"))
    return W.request_parts(asked, "segment", "q", "d").withColumn("questions", F.array_join("questions", ","))


@query("""with d as (select doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as body from documents),
q as (select item_id as id, 'src' || (item_id % 20) as site, item_id as page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as quote from benchmark),
h as (select id, min((doc_id <> page, doc_id)) as b from q join d on d.source = q.site and contains(d.body, q.quote) group by id)
select id, b[2] as page, b[1] as moved from h""")
def quote_verification(spark, sf_dir):
    """JOIN-16, STR-18."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("site"), F.col("item_id").alias("page"), F.col("text").alias("quote"))
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("page"), "text")
    return H.verified_quotes(q, d, lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


@query("""with t as (select doc_id, list_distinct(string_split(text, ' ')) as w from documents),
p(profile, known) as (values ('en', ['the', 'of', 'and', 'to']), ('fr', ['de', 'la', 'le']), ('es', ['de', 'que', 'la'])),
s as (select doc_id, profile, len(list_filter(w, lambda x: not list_contains(known, x))) / greatest(len(w), 1) as share from t, p),
b as (select doc_id, min((share, profile)) as b from s group by doc_id)
select doc_id, case when b[1] <= 0.9 then b[2] end as profile, b[1] as share from b""")
def profile_match(spark, sf_dir):
    """JOIN-15."""
    profiles = spark.createDataFrame([("en", ["the", "of", "and", "to"]), ("fr", ["de", "la", "le"]), ("es", ["de", "que", "la"])], "profile string, known array<string>")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return W.best_profile(docs, profiles, "doc_id", "w", 0.9)


@query("""select doc_id, replace(replace(text, 'the', 'THE'), ' of ', ' OF ') as fixed from documents""")
def composed_text(spark, sf_dir):
    """Every place of literal pairs; placed_changes is STR-21."""
    changes = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("the", "THE"), (" of ", " OF "), ("", "x"))])
    return table(spark, sf_dir, "documents").select("doc_id", W.composed(F.col("text"), changes).alias("fixed"))


@query("""select doc_id, regexp_replace(regexp_replace(text, 'the', 'THE'), 'de[ \\n\\t]+la', 'DE LA') as fixed,
concat_ws(',', case when not coalesce(contains(text, 'the'), false) then '0' end, case when not coalesce(regexp_matches(text, 'de[ \\n\\t]+la'), false) then '1' end, '2') as unplaced from documents""")
def placed_changes(spark, sf_dir):
    """STR-21: each change at its first free spot, whatever the white space; overlaps are held by a unit test."""
    changes = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in (("the", "THE"), ("de  la", "DE LA"), (" ", "x"))])
    docs = table(spark, sf_dir, "documents").select("doc_id", W.placed(F.col("text"), changes).alias("p"))
    return docs.select("doc_id", F.col("p.text").alias("fixed"), F.array_join("p.unplaced", ",").alias("unplaced"))


@query("""select d.doc_id, case when l.quality = 1 then 'still_finding' when l.quality = 0 then 'resolved' else 'waiting' end as status from documents d left join labels l using (doc_id)""")
def rewrite_recheck(spark, sf_dir):
    """DOM-18."""
    after = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "match").otherwise("no_match").alias("outcome"))
    return W.recheck(table(spark, sf_dir, "documents"), after, "doc_id")


@query(f"""with s as (select distinct user_id, {K} % 5 as p, event_type as state from events),
r as (select user_id, p, state, row_number() over (partition by user_id order by p, state) as n from s)
select user_id, max(state) filter (n = 1) as state, coalesce(string_agg(state, ',' order by n) filter (n > 1), '') as notices from r group by user_id""")
def version_summary(spark, sf_dir):
    """DOM-25."""
    return W.summary(events(spark, sf_dir).select("user_id", (F.col("kk") % 5).alias("priority"), F.col("event_type").alias("state")), "user_id")


CLASS = "case when page_id % 7 = 0 then 'legal' when page_id % 3 = 0 then 'product' else 'other' end"


@query(f"""with u as (select page_id, page_id % 10 as site, {CLASS} as class from pages),
q as (select *, case class when 'legal' then 0 when 'product' then 1 else 2 end as queue from u),
p as (select *, row_number() over (partition by site, queue order by page_id) as place from q),
t as (select *, case when queue = 0 then 0 else place end as turn from p)
select page_id, site, n from (select page_id, site, row_number() over (partition by site order by turn, queue, place) as n from t) where n <= 15""")
def crawl_frontier(spark, sf_dir):
    """DOM-23: the page limit is the feature."""
    p = F.col("page_id")
    kind = F.when(p % 7 == 0, "legal").when(p % 3 == 0, "product").otherwise("other")
    urls = table(spark, sf_dir, "pages").select("page_id", (p % 10).alias("site"), kind.alias("class"), p.alias("ord"))
    return W.frontier(urls, "site", 15).select("page_id", "site", F.col("n").cast("long").alias("n"))


@query(f"""with e as (select *, {K} as kk from events), g as (select kk as grp, event_id from e where event_type = 'click'),
x as (select event_id from e where value > 90)
select grp, count(*) as all_items, count(*) filter (event_id not in (select event_id from x)) as included from g group by grp""")
def fix_groups(spark, sf_dir):
    """DOM-17, SET-04."""
    e = events(spark, sf_dir)
    out = e.filter("value > 90").select("event_id", F.lit(True).alias("out"))
    g = e.filter("event_type = 'click'").select(F.col("kk").alias("grp"), "event_id").join(out, "event_id", "left")
    return g.groupBy("grp").agg(F.count("*").alias("all_items"), F.count_if(F.col("out").isNull()).alias("included"))


@query(f"""with e as (select *, {K} as kk from events), p as (select event_id, user_id, case when kk % 4 = 0 then null else kk end as block, 'proposal' as kind from e where event_type = 'purchase'),
f as (select event_id, user_id, kk as block, 'question' as kind from e where event_type = 'click' and event_id not in (select event_id + 1 from p))
select user_id, event_id, kind, row_number() over (partition by user_id order by block nulls last, event_id) as ord from (select * from p union all select * from f)""")
def page_review(spark, sf_dir):
    """DOM-24, SRT-12, FLT-16."""
    e = events(spark, sf_dir)
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.when(F.col("kk") % 4 != 0, F.col("kk")).alias("block"), F.lit("proposal").alias("kind"))
    f = e.filter("event_type = 'click'").select("event_id", "user_id", F.col("kk").alias("block"), F.lit("question").alias("kind"))
    f = f.join(p.select((F.col("event_id") + 1).alias("event_id")), "event_id", "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("block"), "event_id")
    return p.unionByName(f).select("user_id", "event_id", "kind", F.row_number().over(w).cast("long").alias("ord"))


@query(f"""with q as (select event_id as id, value < 50 as open, case when {K} % 3 = 0 then null else {K} end as rank from events where event_type = 'click')
select id, open, coalesce(rank, 32767)::bigint as rank from q order by open desc, coalesce(rank, 32767), id limit 50""")
def question_list(spark, sf_dir):
    """DOM-28: a list of 50, the limit is the feature."""
    rank = F.coalesce(F.when(F.col("kk") % 3 != 0, F.col("kk")), F.lit(32767)).cast("long")
    q = events(spark, sf_dir).filter("event_type = 'click'").select(F.col("event_id").alias("id"), (F.col("value") < 50).alias("open"), rank.alias("rank"))
    return q.orderBy(F.desc("open"), "rank", "id").limit(50)


@query(f"""with f as (select user_id, min(ts) as ended from events where event_type = 'purchase' group by user_id), d as (select user_id, min(ts) as began from events where event_type = 'view' group by user_id)
select user_id, epoch(date_trunc('second', ended))::bigint - epoch(date_trunc('second', began))::bigint as seconds from f join d using (user_id)""")
def run_spans(spark, sf_dir):
    """JOIN-13."""
    e = events(spark, sf_dir)
    end = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("ended"))
    start = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("began"))
    return end.join(start, "user_id").select("user_id", (F.unix_timestamp("ended") - F.unix_timestamp("began")).alias("seconds"))


@query("""with t(code, low, high) as (values ('a', 0, 500), ('b', 502, 2000), ('c', 2000, 5000), ('d', 5001, null)), n as (select *, lead(low) over (order by low) as nxt from t)
select code, case when nxt > high + 1 then 'gap' else 'overlap' end as fault from n where nxt is not null and (nxt > high + 1 or nxt <= high or high is null)""")
def tier_validation(spark, sf_dir):
    """DOM-14."""
    return P.tier_faults(spark.createDataFrame([("a", 0, 500), ("b", 502, 2000), ("c", 2000, 5000), ("d", 5001, None)], "code string, low long, high long"))


@query("""with i as (select o_custkey, o_orderkey, o_orderdate as at_day, 'invoice' as kind from orders where o_orderstatus = 'F'
union all select o_custkey, o_orderkey, min(o_orderdate) over (partition by o_custkey) as at_day, 'scheduled' from orders where o_orderstatus = 'P')
select o_custkey, o_orderkey, kind, row_number() over (partition by o_custkey order by at_day desc, kind desc, o_orderkey desc) as ord from i""")
def billing_overview(spark, sf_dir):
    """DOM-21, SRT-09."""
    o = table(spark, sf_dir, "orders")
    done = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"), F.lit("invoice").alias("kind"))
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    coming = o.filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", first.alias("at"), F.lit("scheduled").alias("kind"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("at"), F.desc("kind"), F.desc("o_orderkey"))
    return done.unionByName(coming).select("o_custkey", "o_orderkey", "kind", F.row_number().over(w).cast("long").alias("ord"))


@query("""select l_orderkey, case when count(distinct l_shipdate::date) = 1 then sum(l_quantity)::bigint when bool_or(l_returnflag = 'R') then null else max(l_quantity)::bigint end as counted from lineitem group by l_orderkey""")
def counted_products(spark, sf_dir):
    """DOM-22."""
    one = F.count_distinct(F.to_date("l_shipdate")) == 1
    value = F.when(one, F.sum("l_quantity").cast("long")).when(F.bool_or(F.col("l_returnflag") == "R"), None).otherwise(F.max("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(value.alias("counted"))


@query("""with j as (select p_brand, p_type, count(*) as n, sum(p_size) as chars from part group by all)
select p_brand, sum(n)::bigint as pages, string_agg(p_type || '=' || chars, ',' order by p_type) as by_role from j group by p_brand""")
def profile_usage(spark, sf_dir):
    """AGG-29."""
    j = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("chars"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("p_type", "chars"))), lambda r: F.concat(r["p_type"], F.lit("="), r["chars"]))
    return j.groupBy("p_brand").agg(F.sum("n").alias("pages"), F.array_join(roles, ",").alias("by_role"))


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
LANG = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})(?:/|$)', 1)"


@query(f"""with v as (select {HOST} as host, {LANG} as lang, page_id, case when url like 'https%' then 0 else 1 end as source from pages where {LANG} <> '')
select host, lang, page_id, source::bigint as source from (select *, row_number() over (partition by host, lang order by source, page_id) as n from v) where n = 1""")
def language_versions(spark, sf_dir):
    """DOM-12: of each language the source of highest priority."""
    lang = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    v = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), lang.alias("lang"), "page_id", F.when(F.col("url").startswith("https"), 0).otherwise(1).cast("long").alias("source"))
    best = v.filter("lang <> ''").groupBy("host", "lang").agg(F.min(F.struct("source", "page_id")).alias("b"))
    return best.select("host", "lang", "b.page_id", "b.source")


@query(f"""with e as (select event_id, user_id, 'k=' || {K} as code, event_type as kind from events), d as (select *, row_number() over (partition by user_id, kind, code order by event_id) as n from e)
select user_id, kind, code, string_split(code, '=')[2] as param, event_id from d where n = 1""")
def market_evidence(spark, sf_dir):
    """DOM-29."""
    e = events(spark, sf_dir).filter("kk is not null").select("event_id", "user_id", F.concat(F.lit("k="), "kk").alias("code"), F.col("event_type").alias("kind"))
    first = e.groupBy("user_id", "kind", "code").agg(F.min("event_id").alias("event_id"))
    return first.select("user_id", "kind", "code", F.element_at(F.split("code", "="), 2).alias("param"), "event_id")


@query(f"""with v as (select user_id, event_id, ts, {K} as kk from events), s as (select *, lead(ts) over (partition by user_id, kk order by ts, event_id) as superseded_at from v)
select user_id, event_id, superseded_at from s""")
def decision_memory(spark, sf_dir):
    """DOM-26."""
    w = Window.partitionBy("user_id", "kk").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("user_id", "event_id", F.lead("ts").over(w).alias("superseded_at"))


@query("""with w(pos, word) as (values (1, 'the'), (2, 'que'), (3, 'und')), m as (select doc_id, pos, word from documents, w where contains(strip_accents(lower(text)), word))
select doc_id, arg_min(word, pos) as keyword from m group by doc_id""")
def keyword_review(spark, sf_dir):
    """FLT-19: the first keyword of a list in each text, marks removed."""
    words = ("the", "que", "und")
    plain = T.strip_marks(F.lower("text"))
    hits = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains("p", w))
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("p")).select("doc_id", F.try_element_at(hits, F.lit(1)).alias("keyword")).filter("keyword is not null")


@query()
def legal_paragraphs(spark, sf_dir):
    """GEN-05: paragraphs of at most 1500 characters, blocks of a page in order; held against plain Python in the tests."""
    return S.chunks(table(spark, sf_dir, "conversations").filter("role <> 'system'"), "conv_id", "turn", "text", 1500)


@query()
def sentence_rules(spark, sf_dir):
    """STR-09, STR-11."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence"))
    return docs
