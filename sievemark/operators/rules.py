"""The rule engine: questions answered with probabilities become findings per jurisdiction.

Rules are a declarative document (YAML or a dict) compiled into small tables and Columns. Their number doesn't grow with
the data; `compiled` refuses more than MOST_RULES.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..functions import numbers as N
from ..functions import text as T
from ..functions.batches import bounded

MOST_RULES = 5_000
#: Order of statuses, groups of checkability, severities and bands, strictest first.
STATUSES = ("effective", "upcoming")
GROUPS = ("text", "assess", "verify", "not_checkable")
SEVERITIES = ("critical", "high", "medium", "low")
BANDS = ("high", "review")


@dataclass(frozen=True)
class Rule:
    """A rule: each of `all` and `none` must hold, and one of `any`; conditions are (question, threshold)."""

    id: str
    module: str
    all: tuple[tuple[str, float], ...] = ()
    any: tuple[tuple[str, float], ...] = ()
    none: tuple[tuple[str, float], ...] = ()
    severity: str = "medium"
    checkability: str = "text"
    high: float = 0.8
    review: float = 0.5
    #: Jurisdiction to the day from which the rule is in force there (None: it is).
    jurisdictions: dict[str, dt.date | None] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleSet:
    questions: dict[str, tuple[str, ...]]
    rules: tuple[Rule, ...]


def compiled(document: dict | str) -> RuleSet:
    """A rule set from a dict or YAML text; unknown keys, questions and values are errors."""
    if isinstance(document, str):
        import yaml

        document = yaml.safe_load(document)
    if extra := set(document) - {"questions", "rules"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    questions = {q: tuple(tokens) for q, tokens in document.get("questions", {}).items()}
    rules = []
    for raw in document.get("rules", []):
        if extra := set(raw) - {f for f in Rule.__dataclass_fields__}:
            raise ValueError(f"rule {raw.get('id')}: unknown keys {sorted(extra)}")
        rule = Rule(**{k: tuple(map(tuple, v)) if k in ("all", "any", "none") else v for k, v in raw.items()})
        asked = [q for q, _ in (*rule.all, *rule.any, *rule.none)]
        if not asked or (unknown := set(asked) - set(questions)):
            raise ValueError(f"rule {rule.id}: no or unknown questions {asked}")
        if rule.severity not in SEVERITIES or rule.checkability not in GROUPS or not 0 <= rule.review <= rule.high <= 1:
            raise ValueError(f"rule {rule.id}: severity, checkability or bands are out of range")
        rules.append(rule)
    if len({r.id for r in rules}) != len(rules) or len(rules) > MOST_RULES:
        raise ValueError("rule ids repeat, or there are too many rules")
    return RuleSet(questions, tuple(rules))


def answers(segments: DataFrame, key: str, body: str, rules: RuleSet) -> DataFrame:
    """(key, question, p) from the reproducible scorer; any table of that shape can stand in for it."""
    asked = F.array(*[F.struct(F.lit(q).alias("question"), F.array(*map(F.lit, tokens)).alias("tokens")) for q, tokens in rules.questions.items()])
    rows = segments.select(key, body, F.explode(asked).alias("q"))
    return rows.select(key, "q.question", T.mock_probability(F.col("q.question"), F.col(body), F.col("q.tokens")).alias("p"))


def rule_score(p: dict[str, Column], rule: Rule) -> tuple[Column, Column, Column]:
    """(evaluated, matched, score) of a rule, given its answers as Columns. A missing answer is not a zero."""
    every = [p[q] for q, _ in (*rule.all, *rule.any, *rule.none)]
    evaluated = ~_or([x.isNull() for x in every])
    ok = [p[q] >= t for q, t in rule.all] + [p[q] < t for q, t in rule.none]
    if rule.any:
        ok.append(_or([p[q] >= t for q, t in rule.any]))
    parts = [p[q] for q, _ in rule.all] + [1 - p[q] for q, _ in rule.none]
    if rule.any:
        parts.append(F.greatest(*some) if len(some := [p[q] for q, _ in rule.any]) > 1 else some[0])
    matched = ok[0]
    for x in ok[1:]:
        matched &= x
    return evaluated, evaluated & matched, F.least(*parts) if len(parts) > 1 else parts[0]


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for x in columns[1:]:
        out |= x
    return out


def outcomes(asked: DataFrame, key: str, rules: RuleSet) -> DataFrame:
    """(key, rule_id, outcome, score, band) of each rule on each segment, from answers (key, question, p).

    outcome is match, no_match or not_evaluated; band is of a match only, by the score before rounding.
    """
    wide = asked.groupBy(key).agg(*[F.max(F.when(F.col("question") == q, F.col("p"))).alias(f"p{i}") for i, q in enumerate(rules.questions)])
    p = {q: F.col(f"p{i}") for i, q in enumerate(rules.questions)}
    rows = []
    for rule in rules.rules:
        evaluated, matched, value = rule_score(p, rule)
        band = F.when(value >= rule.high, "high").when(value >= rule.review, "review")
        found = matched & band.isNotNull()
        rows.append(F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.when(~evaluated, "not_evaluated").when(found, "match").otherwise("no_match").alias("outcome"),
            F.when(evaluated, N.score(value)).alias("score"), F.when(found, band).alias("band"),
        ))
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """(rule_id, module, severity, checkability, jurisdiction, effective_from), bounded by the rule documents."""
    rows = [(r.id, r.module, r.severity, r.checkability, j, d) for r in rules.rules for j, d in r.jurisdictions.items()]
    return spark.createDataFrame(rows, "rule_id string, module string, severity string, checkability string, jurisdiction string, effective_from date")


def rank(values: tuple[str, ...], column: Column) -> Column:
    """Place in a fixed order from 0."""
    out = F.lit(len(values))
    for i, v in reversed([*enumerate(values)]):
        out = F.when(column == v, i).otherwise(out)
    return out


def verdicts(matches: DataFrame, rules: RuleSet, as_of: dt.date) -> DataFrame:
    """Matches in each jurisdiction of their rule: a rule not yet in force is upcoming and only for review."""
    joined = matches.filter("outcome = 'match'").join(F.broadcast(rule_table(matches.sparkSession, rules)), "rule_id")
    upcoming = F.coalesce(F.lit(as_of) < F.col("effective_from"), F.lit(False))
    out = joined.withColumn("status", F.when(upcoming, "upcoming").otherwise("effective"))
    out = out.withColumn("band", F.when(upcoming, "review").otherwise(F.col("band")))
    ranks = (rank(o, F.col(c)) for o, c in ((STATUSES, "status"), (GROUPS, "checkability"), (SEVERITIES, "severity"), (BANDS, "band")))
    return out.withColumn("strictness", N.strictness(*ranks))


def findings(judged: DataFrame, key: str) -> DataFrame:
    """One row per rule and segment: strictest verdict first, all jurisdictions in that order, best score."""
    order = F.struct("strictness", "jurisdiction", "status", "band")
    return judged.groupBy(key, "rule_id").agg(
        F.min("strictness").alias("strictness"),
        F.max("score").alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda v: v["jurisdiction"]), ",").alias("jurisdictions"),
        F.min_by("status", F.struct("strictness", "jurisdiction")).alias("status"),
        F.min_by("band", F.struct("strictness", "jurisdiction")).alias("band"),
    )


def merged_same_text(judged: DataFrame, text: str, url: str) -> DataFrame:
    """Per rule, text and jurisdiction the best score, and its URLs; two stages, so no text gathers all its rows."""
    by = judged.groupBy("rule_id", text, "jurisdiction").agg(F.max("score").alias("score"), F.min("strictness").alias("strictness"), F.count_distinct(url).alias("urls"))
    return by.groupBy("rule_id", text).agg(
        F.count("*").alias("jurisdictions"), F.max("score").alias("score"), F.min("strictness").alias("strictness"), F.max("urls").alias("urls")
    )


#: log2 of the bits (64 MB) that tell which texts may be inner ones, and bits for each; when full, more stretches are looked up.
MARK_BITS, MARKS = 29, 5
#: The base of the hash that marks are set by; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15


class Stretches:
    """Hashes of stretches of a text: sums of its code points times powers of the base, shifted back to the start."""

    def __init__(self):
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def sums(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        if len(points) >= len(self.powers):
            steps = np.ones(2 * len(points) + 1, np.uint64)
            steps[1:] = BASE
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(BASE, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)
        return np.r_[np.uint64(0), np.add.accumulate(points * self.powers[: len(points)])]

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, group: str) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32)) ^ np.uint64(zlib.crc32(group.encode()))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def mark(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the places that a hash marks."""
    return (x + np.uint64(k) * (x >> np.uint64(32) | np.uint64(1))) & np.uint64((1 << MARK_BITS) - 1)


def marks(texts: DataFrame) -> np.ndarray:
    """Words of the bits that the texts (group, text) set; of fixed size, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, one = Stretches(), np.zeros(1, np.int64)
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.append(stretches.hashes(stretches.sums(text), one, one + len(text), group))
            hashes = np.concatenate(found)
            places = np.unique(np.concatenate([mark(hashes, k) for k in range(MARKS)]))
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], ["place"])

    words = texts.mapInArrow(run, "place long").groupBy(F.shiftright("place", 6).alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << MARK_BITS - 6, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def contained(outer: DataFrame, inner: DataFrame, group: str, most: int) -> DataFrame:
    """(group, outer, inner), as digests, of the texts of inner that stand in one of outer with at most `most` further characters.

    outer, inner: (group, text), distinct. The texts of inner set bits, by a hash, in a filter of fixed size; of a text of
    outer only those stretches go on whose bits are set, as digests, and meet the digests of inner. A row meets one text at
    most, so no group is a hot key; what the filter lets through wrongly meets none.
    """
    spark = inner.sparkSession
    bounded(spark)
    parts = inner.filter("text != ''").select(group, "text")
    named = lambda df: df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), "text")
    held = spark.sparkContext.broadcast(marks(named(parts)))
    ends = [(a, e) for a in range(most + 1) for e in range(most + 1 - a)]
    starts, tails = (np.array(x, np.int64) for x in zip(*ends, strict=True))
    schema = StructType([outer.schema[group]]).add("outer", StringType()).add("inner", StringType())
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, bits = Stretches(), held.value
        for batch in batches:
            rows, whole, part = [], [], []
            for row, (name, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                n = len(text)
                fits = slice(None) if n > most else starts + tails < n
                start, end = starts[fits], n - tails[fits]
                x = stretches.hashes(stretches.sums(text), start, end, name)
                for k in range(MARKS):
                    at = mark(x, k)
                    keep = bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
                    start, end, x = start[keep], end[keep], x[keep]
                inside = {text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)}
                if inside:
                    rows += [row] * len(inside)
                    whole += [hashlib.md5(text.encode()).hexdigest()] * len(inside)
                    part += [hashlib.md5(x.encode()).hexdigest() for x in inside]
            groups = batch.column(0).take(pa.array(rows, pa.int64())).cast(fields[0].type)
            yield pa.RecordBatch.from_arrays([groups, pa.array(whole, pa.string()).cast(fields[1].type), pa.array(part, pa.string()).cast(fields[2].type)], schema=fields)

    asked = outer.filter("text != ''").select(group, F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), "text")
    found = asked.mapInArrow(run, schema)
    return found.join(parts.select(group, digest(F.col("text")).alias("inner")), [group, "inner"], "left_semi").select(group, "outer", "inner")


def digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def without_repeated(found: DataFrame, key: str, most: int = 40, jurisdictions: str | None = None) -> DataFrame:
    """Findings but those of secondary sources that repeat a primary one of the same rule and URL in somewhat longer words.

    found: key, rule_id, url (one, or an array of them), text, source ('primary' or 'secondary'). A secondary finding goes
    where its text contains the other's, with at most `most` further characters, and, if a column of `jurisdictions`
    (arrays) is named, the other has all of its own. Texts are compared without case and as to white space and invisible
    characters; an empty one repeats nothing.
    """
    covered = F.array_sort(F.array_distinct(F.coalesce(jurisdictions or F.lit(None), F.array().cast("array<string>"))))
    urls = F.explode("url") if found.schema["url"].dataType.typeName() == "array" else F.col("url")
    each = found.select(key, "rule_id", urls.alias("url"), T.normalized(F.col("text")).alias("text"), "source", covered.alias("jur"))
    main, small = each.filter("source = 'primary'"), each.filter("source = 'secondary'")
    pairs = contained(*[x.select("rule_id", "text").distinct() for x in (small, main)], "rule_id", most)
    over = main.select("rule_id", "url", digest(F.col("text")).alias("inner"), F.col("jur").alias("over")).distinct()
    own = small.select(key, "rule_id", "url", digest(F.col("text")).alias("outer"), "jur")
    asked = own.select("rule_id", "url", "outer", "jur").distinct().join(pairs, ["rule_id", "outer"]).join(over, ["rule_id", "url", "inner"])
    asked = asked.filter(F.size(F.array_except("jur", "over")) == 0).select("rule_id", "url", "outer", "jur").distinct()
    gone = own.join(asked, ["rule_id", "url", "outer", "jur"], "left_semi").select(key).distinct()
    return found.join(gone, key, "left_anti")
