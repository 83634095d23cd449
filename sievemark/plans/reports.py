"""Queries behind reports: documents of findings, decisions, orders, answer merges, rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from ..operators.ranks import ranked
from ..sources import tables as S
from .registry import query, table
from .texts import RULES, SCORED, VERDICTS, _answers, _verdicts


@query(f"""with {SCORED}, c as (select doc_id, question, p from ans where doc_id % 3 = 0), f as (select doc_id, question, p from ans where doc_id % 3 <> 0)
select doc_id, question, p from c union all select doc_id, question, p from f""")
def answer_merge(spark, sf_dir):
    """DOM-03, SRC-10: answers of the cache, and fresh ones only for what it lacks."""
    wanted = _answers(spark, sf_dir).select("doc_id", "question")
    cache = _answers(spark, sf_dir).filter("doc_id % 3 = 0")
    return S.cached_answers(wanted, cache, ["doc_id", "question"], lambda rest: rest.join(_answers(spark, sf_dir), ["doc_id", "question"]))


@query(f"""with {VERDICTS}, f as (select doc_id, rule_id, min(strictness) as strictness, count(*) as occurrences from v group by all)
select doc_id, rule_id, strictness::bigint as strictness, row_number() over (partition by rule_id order by strictness, occurrences desc, doc_id) as place from f""")
def findings_order(spark, sf_dir):
    """SRT-04."""
    f = _verdicts(spark, sf_dir).groupBy("doc_id", "rule_id").agg(F.min("strictness").cast("long").alias("strictness"), F.count("*").alias("occurrences"))
    return ranked(f, ["rule_id"], ["strictness", F.desc("occurrences"), "doc_id"], "place").drop("occurrences")


@query(f"""with {VERDICTS} select doc_id, '[' || string_agg('{{"jurisdiction":"' || jurisdiction || '","status":"' || status || '","band":"' || band || '"}}', ',' order by rule_id, jurisdiction) || ']' as verdicts from v group by doc_id""")
def findings_json(spark, sf_dir):
    """SNK-05: nested documents as canonical JSON, keys and items in a fixed order."""
    item = F.struct("rule_id", "jurisdiction", "status", "band")
    items = F.transform(F.array_sort(F.collect_list(item)), lambda v: F.struct(v["jurisdiction"].alias("jurisdiction"), v["status"].alias("status"), v["band"].alias("band")))
    return _verdicts(spark, sf_dir).groupBy("doc_id").agg(F.to_json(items).alias("verdicts"))


@query("""select * from (values ('R1', 'claims', 'high', 'text', 'CZ', null::date), ('R1', 'claims', 'high', 'text', 'SK', date '2024-01-01'), ('R1', 'claims', 'high', 'text', 'DE', date '2030-01-01'),
('R2', 'style', 'medium', 'assess', 'CZ', null), ('R3', 'claims', 'critical', 'verify', 'AT', null), ('R3', 'claims', 'critical', 'verify', 'DE', date '2025-06-01')) t(rule_id, module, severity, checkability, jurisdiction, effective_from)""")
def rule_table(spark, sf_dir):
    """SRC-07, UDF-06, DOM-06."""
    return R.rule_table(spark, RULES)


@query("""select doc_id, greatest(0, n_chars - length(regexp_replace(text, '[^!$%&#*]', '', 'g')) - 200)::bigint as unchecked,
n_chars > 0 and greatest(0, n_chars - length(regexp_replace(text, '[^!$%&#*]', '', 'g')) - 200) >= 0.2 * n_chars as much from documents""")
def unchecked_text(spark, sf_dir):
    """FLT-08."""
    rest = F.greatest(F.lit(0), F.col("n_chars") - F.length(F.regexp_replace("text", "[^!$%&#*]", "")) - 200).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", rest.alias("unchecked"), ((F.col("n_chars") > 0) & (rest >= 0.2 * F.col("n_chars"))).alias("much"))


@query("""with c as (select c_custkey, '+' || (1 + c_custkey % 998) || '555' as phone, case c_custkey % 3 when 0 then 'en_GB' when 1 then 'de-AT' else 'fr' end as tag, c_mktsegment, c_name from customer),
d as (select *, substr(phone, 2) as digits from c)
select c_custkey, case when left(digits, 1) in ('1', '7') then left(digits, 1) when left(digits, 2) in ('20','27','30','31','32','33','34','36','39','40','41','43','44','45','46','47','48','49','51','52','53','54','55','56','57','58','60','61','62','63','64','65','66','81','82','84','86','90','91','92','93','94','95','98') then left(digits, 2) else left(digits, 3) end as code,
string_split(replace(lower(tag), '_', '-'), '-')[1] as lang, case when c_mktsegment = c_name then c_mktsegment else c_mktsegment || ' | ' || c_name end as category from d""")
def shop_labels(spark, sf_dir):
    """STR-16, STR-17, STR-19."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("+"), 1 + k % 998, F.lit("555"))
    tag = F.when(k % 3 == 0, "en_GB").when(k % 3 == 1, "de-AT").otherwise("fr")
    parts = F.array_distinct(F.filter(F.array("c_mktsegment", "c_name"), lambda x: x.isNotNull() & (x != "")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.calling_code(phone).alias("code"), T.language(tag).alias("lang"), F.array_join(parts, " | ").alias("category"))


@query("""with u as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host, url from pages)
select page_id, 'https://' || regexp_replace(host, '^www\\.', '') || '/' as shop, regexp_matches(host, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') and not regexp_matches(host, '^[0-9.]+$|(^|\\.)(localhost|local|internal)$') as valid from u""")
def shop_addresses(spark, sf_dir):
    """STR-15: a public host name, no address and no internal name."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    valid = host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$") & ~host.rlike(r"^[0-9.]+$|(^|\.)(localhost|local|internal)$")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), F.regexp_replace(host, r"^www\.", ""), F.lit("/")).alias("shop"), valid.alias("valid"))


@query("""with d as (select user_id, event_type, max(ts) as decided_at, count(*) as times, bool_or(value > 90) as published from events group by all)
select user_id, event_type, decided_at, times, case when published then 'published' when times > 12 then 'approved' else 'noted' end as decision from d""")
def decision_protocol(spark, sf_dir):
    """DOM-19."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("decided_at"), F.count("*").alias("times"), F.bool_or(F.col("value") > 90).alias("published"))
    return d.select("user_id", "event_type", "decided_at", "times", F.when(F.col("published"), "published").when(F.col("times") > 12, "approved").otherwise("noted").alias("decision"))


@query("""select time_bucket(interval '1 hour', ts) as start_at, event_type, count(*) as n from events group by all""")
def usage_windows(spark, sf_dir):
    """STM-06: the batch twin of streaming.rates.usage."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start_at"), "event_type", "n")


@query("""select o_orderkey, o_custkey, o_totalprice from orders where o_custkey = 42""")
def tenant_rows(spark, sf_dir):
    """FLT-20, SRC-11: one tenant's rows; the predicate reaches the scan."""
    return S.tenant(table(spark, sf_dir, "orders"), "o_custkey", 42).select("o_orderkey", "o_custkey", "o_totalprice")
