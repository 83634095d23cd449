"""Queries on market signals, canonical documents, reach of answers and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import numbers as N
from ..operators import signals as G
from ..operators import workflow as W
from .registry import query, table
from .texts import VERDICTS, _verdicts

LINKS = """l as (select page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1))) as link from pages)"""


@query(f"""with {LINKS}
select page_id, 'lang' as kind, lower(regexp_extract(html, '<html\\b[^>]*?\\blang="([^"]*)"', 1)) as value from pages where regexp_matches(html, '<html\\b[^>]*?\\blang="[^"]+"')
union all select page_id, 'tld', regexp_extract(url, '^[a-z]+://[^/?#]*?\\.([a-z]+)(?:[/?#]|$)', 1) from pages
union all select distinct page_id, 'switch', 'path ' || lower(regexp_extract(link, '^/([A-Za-z]{{2}}(?:-[A-Za-z]{{2}})?)/?$', 1)) from l where regexp_matches(link, '^/[A-Za-z]{{2}}(?:-[A-Za-z]{{2}})?/?$')""")
def market_signals(spark, sf_dir):
    """DOM-11, GEN-09; operators.signals.switch knows more shapes than these pages hold, tests cover them."""
    return G.market_signals(table(spark, sf_dir, "pages"))


@query("""with e as (select event_id, '{"a":[1,{"b":null,"c":"' || event_type || '"}],"z":{"user":' || user_id || '}}' as canonical from events)
select event_id, canonical, sha256(canonical) as digest from e""")
def canonical_json(spark, sf_dir):
    """JSN-02: the digest doesn't depend on the order of keys."""
    text = F.concat(F.lit('{ "z": {"user": '), F.col("user_id"), F.lit('}, "a": [1, {"c": "'), F.col("event_type"), F.lit('", "b": null}] }'))
    made = table(spark, sf_dir, "events").select("event_id", D.canonical(text).alias("canonical"))
    return made.withColumn("digest", F.sha2("canonical", 256))


@query("""select conv_id, turn, regexp_full_match(text, '[A-Za-z0-9_.:+\\-]{0,100}') as allowed from conversations where text is not null""")
def notification_check(spark, sf_dir):
    """FLT-23."""
    c = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    return c.select("conv_id", "turn", D.without_text(F.to_json(F.struct("turn", F.struct("role", "text").alias("body")))).alias("allowed"))


@query("""select o_orderkey, (o_orderdate + interval 1 month)::date as next_month, o_orderdate::date + 30 as days_30 from orders""")
def trial_end(spark, sf_dir):
    """DT-05; the SQL adds 30 to the date, as DuckDB takes an interval of 30 days in one query with an interval of a month for the same."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.trial_end(day).alias("next_month"), N.trial_end(day, 30).alias("days_30"))


@query("""with p as (select o_custkey, list(o_orderkey) as ids from orders group by o_custkey), x as (select o_custkey, unnest(ids) as id from p)
select l_partkey, o_custkey, count(distinct id) as n from x join lineitem on l_orderkey = id where l_returnflag = 'R' group by all""")
def proposal_findings(spark, sf_dir):
    """JOIN-12: proposals, here the orders of a customer as a list of ids, that hold a finding, here a returned line."""
    proposals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), "l_partkey").distinct()
    return W.holding(proposals, "ids", found, "id").groupBy("l_partkey", "o_custkey").agg(F.count_distinct("id").alias("n"))


@query("""with f as (select o_custkey, o_orderkey, o_orderpriority from orders), p as (select o_custkey, l_partkey as page from f join lineitem on l_orderkey = o_orderkey union select o_custkey, o_custkey from f),
n as (select o_custkey, count(distinct page) as pages from p group by all)
select o_custkey, count(distinct o_orderpriority) as questions, count(distinct o_orderkey) as findings, any_value(pages) as pages from f join n using (o_custkey) group by o_custkey""")
def answer_reach(spark, sf_dir):
    """AGG-17: a customer is an answer, a priority a question, an order a finding, a part a page; the own page has the customer's number."""
    f = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("question"), F.col("o_orderkey").alias("finding"), F.col("o_custkey").alias("own"))
    places = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("page"))
    return W.reach(f, places, "o_custkey", "question", "finding", "own", "page")


@query("""with r as (select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by all)
select source as id, '{"id":"' || source || '","pages":' || sum(n)::bigint || ',"skipped_chars_by_role":{' || string_agg('"' || lang || '":' || chars, ',' order by lang) || '}}' as profile from r group by source""")
def profiles_document(spark, sf_dir):
    """SNK-06: a source is a profile, a language a role."""
    by = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    roles = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "chars"))))
    made = by.groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("pages"), roles.alias("skipped_chars_by_role"))
    return made.select("id", F.to_json(F.struct("id", "pages", "skipped_chars_by_role")).alias("profile"))


@query(f"""with {VERDICTS}, f as (select rule_id, doc_id, count(*) as n from v group by all)
select rule_id as section, 0 as part, null::bigint as item, '## ' || rule_id || ': ' || count(*) || ' documents, ' || sum(n)::bigint || ' places' as line from f group by rule_id
union all select rule_id, 1, doc_id, '- document ' || doc_id || ': ' || n || ' places' from f""")
def report_lines(spark, sf_dir):
    """SNK-07: the Markdown report as ordered lines, so that no section has to fit into one row."""
    return W.markdown(_verdicts(spark, sf_dir), "rule_id", "doc_id", "document")
