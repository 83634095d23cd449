"""The library's front door: scan pages or analyse texts with a rule document and a scorer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import rules as R
from .operators import segments as S
from .sources import pages as P

#: From segments (hash, text) and the rule set to answers (hash, question, p).
Scorer = Callable[[DataFrame, R.RuleSet], DataFrame]


@dataclass(frozen=True)
class Report:
    segments: DataFrame
    outcomes: DataFrame
    findings: DataFrame


def mock_scorer(segments: DataFrame, rules: R.RuleSet) -> DataFrame:
    return R.answers(segments, "hash", "text", rules)


def analyze_texts(df: DataFrame, rules: dict | str, key: str, body: str, site: str, as_of: dt.date, scorer: Scorer = mock_scorer) -> Report:
    """Sentences of texts, de-duplicated, scored once each, judged by the rules of every jurisdiction."""
    compiled = R.compiled(rules)
    sentences = S.sentences(df, key, body, site)
    worth = sentences.filter(T.worth_evaluating(F.col("sentence")))
    segments = S.dedupe(worth, key, site)
    outcomes = R.outcomes(scorer(segments.select("hash", "text"), compiled), "hash", compiled)
    found = R.findings(R.verdicts(outcomes, compiled, as_of), "hash")
    return Report(segments, outcomes, found.join(segments, "hash"))


def scan(pages: DataFrame, rules: dict | str, as_of: dt.date, scorer: Scorer = mock_scorer) -> Report:
    """Pages (page_id, url, html): their blocks outside navigation as texts, then as analyze_texts does."""
    blocks = P.blocks(P.parsed(pages)).filter("region <> 'navigation'")
    host = pages.select(F.col("page_id").alias("id"), F.regexp_extract(F.lower("url"), "^[a-z]+://([^/:?#]+)", 1).alias("site"))
    texts = blocks.join(host, "id").withColumn("key", F.col("id") * 100_000 + F.col("ord"))
    return analyze_texts(texts, rules, "key", "text", "site", as_of, scorer)


def register_functions(spark: SparkSession) -> None:
    """SQL functions of this library, as SQL expressions that Catalyst sees through."""
    spark.sql(
        "create or replace temporary function strictness_rank(status int, grp int, severity int, band int) returns int "
        "return coalesce(status * 64 + grp * 16 + severity * 4 + band, 127)"
    )
    spark.sql(
        "create or replace temporary function fingerprint(t string) returns bigint "
        "return cast(conv(substr(sha2(t, 256), 1, 16), 16, -10) as bigint)"
    )
