"""Queries on texts: normalization, sentences, scoring and rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import claims as K
from ..operators import phrases as H
from ..operators import rules as R
from ..operators import segments as S
from .registry import query, table

NORM = "lower(trim(regexp_replace(regexp_replace({0}, '[­​‌‍﻿]', '', 'g'), '\\s+', ' ', 'g')))"
SIGNED = "case when {0} >= 9223372036854775808 then ({0}::hugeint - 18446744073709551616)::bigint else {0}::bigint end"
SPLIT = "string_split(regexp_replace(text, '([.!?…])\\s+([\\p{Lu}\\d„\"])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
SENTENCES = f"""
parts as (select doc_id, source, lang, {SPLIT} as all_parts from documents where text is not null),
kept as (select doc_id, source, lang, list_filter(all_parts, lambda s: length(s) >= 3) as l from parts),
sent as (select doc_id, source, lang, i - 1 as pos, l[i] as sentence from kept, unnest(range(1, len(l) + 1)) as u(i))
"""


def sentence_table(spark, sf_dir):
    return S.sentences(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang")


@query(f"""with n as (select doc_id, {NORM.format('text')} as t from documents),
h as (select doc_id, t, ('0x' || substr(sha256(t), 1, 16))::ubigint as u from n)
select doc_id, 'sha256:' || sha256(t) as norm_hash, {SIGNED.format('u')} as fingerprint, length(t)::bigint as n_chars from h""")
def text_fingerprint(spark, sf_dir):
    """STR-01, 02, 06, 07."""
    n = T.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sha(n).alias("norm_hash"), T.fingerprint(n).alias("fingerprint"), F.length(n).cast("long").alias("n_chars"))


@query("""select doc_id, 'sha256:' || sha256(lang || chr(31) || source || chr(31) || text) as segment_hash from documents""")
def text_segment_hash(spark, sf_dir):
    """STR-06."""
    return table(spark, sf_dir, "documents").select("doc_id", T.sha(F.col("lang"), F.col("source"), F.col("text")).alias("segment_hash"))


@query("""select doc_id, case when length(text) <= 80 then text else '…' || regexp_replace(right(text, 80), '^\\S* ', '') end as tail,
case when length(text) <= 80 then text else regexp_replace(left(text, 80), ' \\S*\\z', '') || '…' end as head from documents""")
def trim_context(spark, sf_dir):
    """STR-12."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.keep_end(t, 80).alias("tail"), T.keep_start(t, 80).alias("head"))


@query("""select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') as slug from documents""")
def slugs(spark, sf_dir):
    """STR-03, 04: of whole texts, marks removed by Unicode's decomposition."""
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(T.strip_marks(F.col("text"))).alias("slug"))


@query("select doc_id, strip_accents(text) as plain from documents")
def unmarked_text(spark, sf_dir):
    """STR-03, all of Unicode."""
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_marks(F.col("text")).alias("plain"))


@query(f"with {SENTENCES} select doc_id, pos::bigint as pos, sentence from sent")
def sentence_split(spark, sf_dir):
    """STR-10, GEN-04."""
    return sentence_table(spark, sf_dir).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(f"""with {SENTENCES} select doc_id, pos::bigint as pos,
coalesce(string_agg(sentence, ' ') over (partition by doc_id order by pos rows between 2 preceding and 1 preceding), '') as before,
coalesce(string_agg(sentence, ' ') over (partition by doc_id order by pos rows between 1 following and 2 following), '') as after from sent""")
def sentence_context(spark, sf_dir):
    """WIN-03."""
    out = S.with_context(sentence_table(spark, sf_dir), "doc_id")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "before", "after")


@query(f"""with {SENTENCES}, h as (select *, 'sha256:' || sha256({NORM.format('sentence')}) as hash from sent),
f as (select hash, source, min((doc_id, pos)) as first_at from h group by all)
select h.hash, arg_min(sentence, (doc_id, pos)) as text, count(*) as occurrences, count(distinct doc_id) as documents,
any_value(s.sites) as sites from h join (select hash, string_agg(source, ',' order by first_at) as sites from f group by hash) s
on h.hash = s.hash group by h.hash""")
def segment_dedupe(spark, sf_dir):
    """AGG-02, SET-03."""
    return S.dedupe(sentence_table(spark, sf_dir), "doc_id", "source").withColumn("sites", F.array_join("sites", ","))


@query(f"""with {SENTENCES}, n as (select source, doc_id, {NORM.format('sentence')} as norm from sent),
t as (select source, count(distinct doc_id) as total from n group by source),
c as (select source, norm, count(distinct doc_id) as pages from n group by all)
select source, norm, pages, total, pages >= 3 and pages > 0.05 * total as boilerplate from c join t using (source)""")
def boilerplate_flag(spark, sf_dir):
    """AGG-01."""
    return S.boilerplate(sentence_table(spark, sf_dir), "doc_id", "source", share=0.05).select("source", "norm", "pages", "total", "boilerplate")


@query(f"""with {SENTENCES} select lang, count(*) as sentences,
count(*) filter (length(sentence) >= 3 and regexp_matches(sentence, '\\p{{L}}{{3,}}')) as worth from sent group by lang""")
def worth_evaluating(spark, sf_dir):
    """FLT-06."""
    out = sentence_table(spark, sf_dir).groupBy("lang")
    return out.agg(F.count("*").alias("sentences"), F.count_if(T.worth_evaluating(F.col("sentence"))).alias("worth"))


@query()
def sieve_chunks(spark, sf_dir):
    """GEN-06; a fold, held against plain Python in the tests."""
    return S.chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""with w(w, l) as (values ('the', 'en'), ('und', 'de'), ('que', 'es')),
d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' as t from documents)
select doc_id, w.w as label, contains(t, ' ' || w.w || ' ') as found from d, w""")
def label_match(spark, sf_dir):
    """STR-05."""
    labels = F.explode(F.array(*map(F.lit, ("the", "und", "que")))).alias("label")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", labels)
    return docs.select("doc_id", "label", T.whole_word(F.col("text"), F.col("label")).alias("found"))


#: A rule set on words that occur in the test texts.
RULES = R.compiled({
    "questions": {"claims": ("tion", "ment"), "shouts": ("!!",), "repeats": ("lich", "ción"), "links": ("www", "http")},
    "rules": [
        {"id": "R1", "module": "claims", "all": [("claims", 0.7)], "none": [("links", 0.5)], "severity": "high",
         "jurisdictions": {"CZ": None, "SK": dt.date(2024, 1, 1), "DE": dt.date(2030, 1, 1)}},
        {"id": "R2", "module": "style", "any": [("shouts", 0.6), ("links", 0.6)], "checkability": "assess", "high": 0.9,
         "jurisdictions": {"CZ": None}},
        {"id": "R3", "module": "claims", "all": [("claims", 0.5), ("repeats", 0.5)], "severity": "critical", "checkability": "verify",
         "jurisdictions": {"AT": None, "DE": dt.date(2025, 6, 1)}},
    ],
})
AS_OF = dt.date(2025, 6, 1)
TOKENS = "(values ('claims', ['tion', 'ment']), ('shouts', ['!!']), ('repeats', ['lich', 'ción']), ('links', ['www', 'http'])) as q(question, tokens)"
SCORED = f"""
base as (select doc_id, question, sha256(question || chr(31) || text) as h,
  len(list_filter(tokens, lambda t: contains(lower(text), t))) > 0 as hit from documents, {TOKENS}),
ans as (select doc_id, question, round(greatest(0.0, least(1.0, case when hit then 0.9::double else 0.06::double end
  + round(('0x' || substr(h, 3, 2) || substr(h, 1, 2))::int::double / 65535.0::double * 0.08::double - 0.04::double, 3))), 3) as p from base)
"""
OUTCOMES = f"""{SCORED},
wide as (select doc_id, max(p) filter (question = 'claims') as c, max(p) filter (question = 'shouts') as s,
  max(p) filter (question = 'repeats') as r, max(p) filter (question = 'links') as l from ans group by doc_id),
res as (
  select doc_id, 'R1' as rule_id, c >= 0.7 and l < 0.5 as ok, least(c, 1 - l) as v, 0.8 as high from wide union all
  select doc_id, 'R2', s >= 0.6 or l >= 0.6, greatest(s, l), 0.9 from wide union all
  select doc_id, 'R3', c >= 0.5 and r >= 0.5, least(c, r), 0.8 from wide),
outc as (select doc_id, rule_id, case when ok and v >= 0.5 then 'match' else 'no_match' end as outcome, round_even(v, 3) as score,
  case when ok and v >= high then 'high' when ok and v >= 0.5 then 'review' end as band from res)
"""
VERDICTS = f"""{OUTCOMES},
rt(rule_id, sev, chk, jurisdiction, eff) as (values ('R1', 1, 0, 'CZ', null::date), ('R1', 1, 0, 'SK', date '2024-01-01'),
  ('R1', 1, 0, 'DE', date '2030-01-01'), ('R2', 2, 1, 'CZ', null), ('R3', 0, 2, 'AT', null), ('R3', 0, 2, 'DE', date '2025-06-01')),
v0 as (select doc_id, rule_id, score, jurisdiction, coalesce(date '2025-06-01' < eff, false) as up, band as b0, sev, chk
  from outc join rt using (rule_id) where outcome = 'match'),
v as (select doc_id, rule_id, score, jurisdiction, case when up then 'upcoming' else 'effective' end as status,
  case when up then 'review' else b0 end as band,
  case when up then 64 else 0 end + chk * 16 + sev * 4 + case when up or b0 = 'review' then 1 else 0 end as strictness from v0)
"""


def _answers(spark, sf_dir):
    return R.answers(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", RULES)


def _verdicts(spark, sf_dir):
    return R.verdicts(R.outcomes(_answers(spark, sf_dir), "doc_id", RULES), RULES, AS_OF)


@query(f"with {SCORED} select doc_id, question, p from ans")
def mock_score(spark, sf_dir):
    """MTH-07, DOM-04, UDF-02."""
    return _answers(spark, sf_dir)


@query(f"with {OUTCOMES} select * from outc")
def rule_segment_outcomes(spark, sf_dir):
    """FLT-09, AGG-09."""
    return R.outcomes(_answers(spark, sf_dir), "doc_id", RULES)


@query(f"with {VERDICTS} select doc_id, rule_id, jurisdiction, status, band, score, strictness::bigint as strictness from v")
def rule_multi_jurisdiction(spark, sf_dir):
    """JOIN-07, DT-01, SRT-02."""
    out = _verdicts(spark, sf_dir)
    return out.select("doc_id", "rule_id", "jurisdiction", "status", "band", "score", F.col("strictness").cast("long").alias("strictness"))


@query(f"""with {VERDICTS} select doc_id, rule_id, min(strictness)::bigint as strictness, max(score) as score,
string_agg(jurisdiction, ',' order by strictness, jurisdiction) as jurisdictions,
arg_min(status, (strictness, jurisdiction)) as status, arg_min(band, (strictness, jurisdiction)) as band from v group by all""")
def rule_findings(spark, sf_dir):
    """DOM-05, AGG-03, SRT-01."""
    out = R.findings(_verdicts(spark, sf_dir), "doc_id")
    return out.withColumn("strictness", F.col("strictness").cast("long"))


@query(f"""with {VERDICTS}, w as (select v.*, {NORM.format('d.text')} as norm, d.source from v join documents d using (doc_id)),
j as (select rule_id, norm, jurisdiction, max(score) as score, min(strictness) as strictness, count(distinct source) as urls from w group by all)
select rule_id, sha256(norm) as text_hash, count(*) as jurisdictions, max(score) as score, min(strictness)::bigint as strictness, max(urls) as urls
from j group by rule_id, norm""")
def merge_same_text(spark, sf_dir):
    """AGG-04, AGG-05."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.normalized(F.col("text")), 256).alias("text_hash"))
    out = R.merged_same_text(_verdicts(spark, sf_dir).join(docs, "doc_id"), "text_hash", "source")
    return out.withColumn("strictness", F.col("strictness").cast("long"))


SUPPRESS = f"""{SENTENCES}, f as (select doc_id * 100000 + pos as id, 'R' || (doc_id % 3) as rule_id, 'source' || (doc_id % 5) as url,
 {NORM.format('sentence')} as text, case when pos % 2 = 0 then 'primary' else 'secondary' end as source_kind,
 case when doc_id % 2 = 0 then ['CZ'] else ['CZ', 'SK'] end as jur from sent),
p as (select distinct rule_id, url, text, jur from f where source_kind = 'primary' and text <> '')"""


@query(f"""with {SUPPRESS}, gone as (select distinct s.id from f s join p on s.rule_id = p.rule_id and s.url = p.url and len(list_filter(s.jur, lambda x: not list_contains(p.jur, x))) = 0
where s.source_kind = 'secondary' and length(s.text) - length(p.text) between 0 and 40 and contains(s.text, p.text))
select id, rule_id, source_kind from f where id not in (select id from gone)""")
def suppress_repeated(spark, sf_dir):
    """JOIN-09, JOIN-06."""
    odd = F.col("pos") % 2 == 1
    found = sentence_table(spark, sf_dir).select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("id"), F.concat(F.lit("R"), F.col("doc_id") % 3).alias("rule_id"),
        F.concat(F.lit("source"), F.col("doc_id") % 5).alias("url"), F.col("sentence").alias("text"),
        F.when(odd, "secondary").otherwise("primary").alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("CZ"))).otherwise(F.array(F.lit("CZ"), F.lit("SK"))).alias("jur"),
    )
    return R.without_repeated(found, "id", jurisdictions="jur").select("id", "rule_id", F.col("source").alias("source_kind"))


@query(f"""with {SCORED}, b as (select source, max(p) as top from ans join documents using (doc_id) where question = 'shouts' group by source)
select source, case when top >= 0.7 then 'present' else 'missing' end as outcome, round_even(1 - top, 3) as score from b""")
def site_presence(spark, sf_dir):
    """AGG-06, AGG-07."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    top = _answers(spark, sf_dir).filter("question = 'shouts'").join(docs, "doc_id").groupBy("source").agg(F.max("p").alias("top"))
    return top.select("source", F.when(F.col("top") >= 0.7, "present").otherwise("missing").alias("outcome"), N.score(1 - F.col("top")).alias("score"))


@query("""with c as (select source, count(*) filter (regexp_matches(text, '[A-Z]{4,}!!')) as hits from documents group by source)
select c.source, c.hits, d.doc_id from c left join documents d on c.source = d.source and regexp_matches(d.text, '[A-Z]{4,}!!')""")
def site_signal(spark, sf_dir):
    """AGG-08, AGG-22, FLT-12: a row for each hit (one without a document where a source has none), so no source gathers all."""
    docs = table(spark, sf_dir, "documents")
    hit = F.col("text").rlike("[A-Z]{4,}!!")
    counts = docs.groupBy("source").agg(F.count_if(hit).alias("hits"))
    return counts.join(docs.filter(hit).select("source", "doc_id"), "source", "left").select("source", "hits", "doc_id")


CLAIMS = [("c1", "(?i)tion\\w*", "!!", "www"), ("c2", "ment\\w*", "\\?|\\*\\*", "###"), ("c3", "lich\\w*", ".", "!!")]


@query("""with c(id, claim, category, exclude) as (values ('c1', '(?i)tion\\w*', '!!', 'www'), ('c2', 'ment\\w*', '\\?|\\*\\*', '###'), ('c3', 'lich\\w*', '.', '!!'))
select id, doc_id from c, documents where regexp_matches(text, claim) and regexp_matches(text, category) and not regexp_matches(text, exclude)""")
def rule_claim_list(spark, sf_dir):
    """FLT-11, JOIN-08, SRC-08: every claim is a column expression over one scan."""
    t = F.col("text")
    hits = F.filter(F.array(*[F.when(t.rlike(c) & t.rlike(k) & ~t.rlike(x), F.lit(i)) for i, c, k, x in CLAIMS]), lambda v: v.isNotNull())
    return table(spark, sf_dir, "documents").select(F.explode(hits).alias("id"), "doc_id")


MACROS = r"""
macros: {abs_en: '(?:the|of)', abs_es: '(?:de|la)', gap: '(?:with\s+)?'}
categories: {ends: {en: 'ing\b', es: 'ado'}, shouts: {en: '!!', es: '!!'}}
claims:
  - {id: words, outcome: text, outcome_es: verify, category: ends, subst: 'th\w+', subst_es: 'que\b|las'}
  - {id: english, outcome: verify, category: ends, category_exclude: '!!', subst: 'qqq', adj: 'in', en: 'is|her', extra: 'ringing'}
  - {id: own, outcome: none, category: shouts, claim_en: '(?i)tion', claim_es: '(?i)mente'}
"""
CLAIM_SQL = r"""
('words', 'en', '(?i)(?:\b(?:the|of)\s+(?:with\s+)?(?:th\w+)|\b0\s*%\s*(?:th\w+))', 'ing\b', null, 'text'),
('words', 'es', '(?i)(?:(?:^|[^\p{L}\p{N}_])(?:de|la)\s+(?:with\s+)?(?:que(?:$|[^\p{L}\p{N}_])|las)|\b0\s*%\s*(?:que\b|las))', 'ado', null, 'verify'),
('english', 'en', '(?i)(?:\b(?:the|of)\s+(?:with\s+)?(?:qqq)|\bbez-?(?:in)|\b(?:is|her)\s*-?\s*free\b|\bfree\s+(?:from|of)\s+(?:is|her)|\b0\s*%\s*(?:qqq)|ringing)', 'ing\b', '!!', 'verify'),
('english', 'es', '(?i)(?:\b(?:de|la)\s+(?:with\s+)?(?:qqq)|\bbez-?(?:in)|\b(?:is|her)\s*-?\s*free\b|\bfree\s+(?:from|of)\s+(?:is|her)|\b0\s*%\s*(?:qqq)|ringing)', 'ado', '!!', 'verify'),
('own', 'en', '(?i)tion', '!!', null, 'none'), ('own', 'es', '(?i)mente', '!!', null, 'none')"""


@query(f"""with c(claim, country, re, category, exclude, outcome) as (values {CLAIM_SQL})
select doc_id, claim, outcome from documents d join c on d.lang = c.country where regexp_matches(text, re) and regexp_matches(text, category)
and (exclude is null or not regexp_matches(text, exclude))""")
def claim_macros(spark, sf_dir):
    """SRC-08, FLT-11: expressions of each claim and country from the macros of a document."""
    rows, faults = K.claim_rows(MACROS)
    if faults:
        raise ValueError("; ".join(faults))
    return K.claim_hits(table(spark, sf_dir, "documents"), ["doc_id"], "text", "lang", rows)


@query("""select b.item_id, count(d.doc_id) as pages from benchmark b left join documents d on contains(d.text, b.text) group by b.item_id""")
def rule_allowlist_page(spark, sf_dir):
    """FLT-10: pages that hold a listed phrase."""
    phrases = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    hits = H.occurrences(table(spark, sf_dir, "documents"), ["doc_id"], "text", phrases, "phrase").groupBy("phrase").agg(F.count("*").alias("n"))
    return phrases.join(hits, "phrase", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("pages"))


@query(f"""with d as (select doc_id, 'doc/' || doc_id as url, {NORM.format("coalesce(text, '')")} as body from documents),
ph as (select 'L' || (item_id % 2) as list, {NORM.format('text')} as phrase from benchmark),
f as (select doc_id // 10 as id, list(url order by doc_id) as urls, min(doc_id) as head from d group by id),
k as (select id, 'L' || (id % 2) as list, case when id % 3 = 0 then 'segment' else 'page' end as scope, urls, body as text from f join d on d.doc_id = f.head),
e as (select id, list, scope, text, unnest(urls) as url from k),
c as (select e.id, e.url, d.doc_id, not exists (select 1 from ph where ph.list = e.list and contains(case when scope = 'page' then d.body else e.text end, ph.phrase)) as stays from e join d using (url)),
r as (select id, string_agg(url, ',' order by doc_id) filter (stays) as urls from c group by id)
select id, coalesce(urls, '') as urls, urls is null as excluded from r""")
def allowlist_urls(spark, sf_dir):
    """FLT-10: listed phrases take URLs from a finding, by page or by the finding's own text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text"))
    phrases = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("L"), F.col("item_id") % 2).alias("list"), F.col("text").alias("phrase"))
    ten = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "url"))).alias("d"), F.min_by("text", "doc_id").alias("text"))
    found = ten.select(
        "id", F.concat(F.lit("L"), F.col("id") % 2).alias("list"), F.when(F.col("id") % 3 == 0, "segment").otherwise("page").alias("scope"),
        F.transform("d", lambda x: x["url"]).alias("urls"), "text",
    )
    return H.without_listed(found, "id", docs, phrases, T.normalized).select("id", F.array_join("urls", ",").alias("urls"), "excluded")


@query("""select lang, sum(n_chars)::bigint as chars, ceil(sum(n_chars) / 2.6::double)::bigint as tokens,
round_even(ceil(sum(n_chars) / 2.6::double)::double * 0.042::double / 1e6::double, 6) as usd from documents group by lang""")
def cost_estimate(spark, sf_dir):
    """AGG-30, MTH-01."""
    sums = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"))
    tokens, usd = N.token_cost(F.col("chars"))
    return sums.select("lang", "chars", tokens.alias("tokens"), usd.alias("usd"))


@query(f"""with {SCORED}, a as (select ans.*, source from ans join documents using (doc_id))
select question, count(*) filter (p >= 0.2) as passed, count(*) as asked from a group by question""")
def sieve_gate(spark, sf_dir):
    """DOM-01: a missing answer lets a sentence through."""
    open_ = F.col("p").isNull() | (F.col("p") >= 0.2)
    return _answers(spark, sf_dir).groupBy("question").agg(F.count_if(open_).alias("passed"), F.count("*").alias("asked"))


@query(f"""with {SCORED} select doc_id, max(p) filter (question = 'claims') as sieve_claims, max(p) filter (question = 'links') as sieve_links,
max(p) filter (question = 'repeats') as sieve_repeats, max(p) filter (question = 'shouts') as sieve_shouts from ans group by doc_id""")
def sieve_pivot(spark, sf_dir):
    """SNK-02, SNK-03, MAP-01."""
    modules = sorted(RULES.questions)
    wide = _answers(spark, sf_dir).groupBy("doc_id").pivot("question", modules).agg(F.first("p"))
    return wide.select("doc_id", *[F.col(m).alias(f"sieve_{m}") for m in modules])


@query("""with c as (select source, lang, count(*) as n from documents group by all),
s as (select source, lang, n, sum(n) over (partition by source) as total, row_number() over (partition by source order by n desc, lang) as rn from c)
select source, lang, n, round_even(n / total, 3) as share, rn = 1 and n * 2 > total as majority from s""")
def language_share(spark, sf_dir):
    """AGG-18, DOM-31."""
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("source"))
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))
    out = counts.select("source", "lang", "n", N.score(F.col("n") / total).alias("share"), ((rn == 1) & (F.col("n") * 2 > total)).alias("majority"))
    return out
