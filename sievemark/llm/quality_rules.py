"""Quality rules as a ledger of bits, in DataFrame functions only.

`ledger` evaluates every rule once on every text and keeps its measurements and one bit a rule (`failed`, bit i for
RULES[i]). Policies are versions of masks over those bits, so that changing one, comparing two or leaving a rule out
never reads a text again: `verdicts` applies a policy to each row, `ablations` counts what each rule of each policy
decides from one aggregation by bit pattern, and `spread` joins bits by group.

Words are runs of anything but the six ASCII white-space characters. All measurements stay within the row: nothing is
shuffled, and a long text costs its own task only. Repeated five-word windows are found by 64-bit hashes; only texts in
which two hashes agree are sorted, with the windows' own words, so the count is exact.

Defined results: a null or empty text has no words and fails few_words only; repeated rows get equal rows, a null id
too; only the two named columns are read, so other columns can have any name; an empty table gives an empty result.
Texts are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bits of a word's place within its text: more than a text of 2 GB, the longest that Spark holds, has words.
PLACE = 30

#: name, condition over the measurements (the same in Spark SQL and DuckDB); the order gives the bits and only grows.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("wordless", "5 * n_letter_words < 4 * n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("upper_case", "10 * n_upper > 4 * word_chars"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("cut_lines", "10 * n_cut_lines > 3 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
MEASURES = (
    "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_letter_words n_upper n_bullet_lines n_cut_lines"
).split()
#: The rules that every policy has.
BASE = BIT["few_words"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """A text stays if it fails none of the rules in `hard` and at most `allowed` of those in `soft`."""

    version: int
    hard: int
    soft: int = 0
    allowed: int = 0

    def keeps(self, failed: Column) -> Column:
        hard = failed.bitwiseAND(F.lit(self.hard).cast("long")) == 0
        return hard & (F.bit_count(failed.bitwiseAND(F.lit(self.soft).cast("long"))) <= self.allowed)


def mask(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


POLICIES = [
    Policy(1, BASE),
    Policy(2, BASE | mask("symbols", "duplicate_lines", "wordless")),
    Policy(
        3,
        BASE | mask("symbols", "duplicate_lines", "wordless"),
        mask("short_words", "long_words", "upper_case", "bullet_lines", "cut_lines"),
        1,
    ),
]
CURRENT = POLICIES[-1]


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements as longs, and `failed`; a row for each row of df."""
    text = F.coalesce(df[text_col], F.lit(""))
    start = df.select(df[id_col].alias("doc_id"), text.alias("text"))
    body = F.trim("text", F.lit(" \t\n\x0b\x0c\r"))
    split = start.select(
        "doc_id", "text",
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"{SPACE}+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    hashed = split.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("word_hashes", i + k) for k in range(WINDOW)])
    starts = F.sequence(F.lit(0), n - WINDOW)
    windows = hashed.select("doc_id", "text", "words", "lines", F.when(n >= WINDOW, F.transform(starts, window)).otherwise(F.array().cast("array<long>")).alias("windows"))
    # a part of the hash above the place, as one long that sorts fast; the words decide below
    packed = F.transform("windows", lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    packed = windows.select("doc_id", "text", "words", "lines", F.when(some, F.sort_array(packed)).alias("packed"))
    alike = lambda x, i: F.coalesce(F.shiftright(F.get("packed", i), PLACE) == F.shiftright(x, PLACE), F.lit(False))
    found = packed.select("doc_id", "text", "words", "lines", F.filter("packed", lambda x, i: alike(x, i - 1) | alike(x, i + 1)).alias("found"))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    exact = lambda x: F.struct(F.shiftright(x, PLACE).alias("h"), F.array_join(F.slice("words", place(x) + 1, WINDOW), " ").alias("w"), place(x).alias("i"))
    at = found.select("doc_id", "text", "words", "lines", F.sort_array(F.transform("found", exact)).alias("sorted"))
    same = lambda x, i: F.coalesce((F.get("sorted", i)["h"] == x["h"]) & (F.get("sorted", i)["w"] == x["w"]), F.lit(False))
    twice = F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    count = lambda keep: F.size(F.filter("lines", keep))
    left = F.regexp_replace("text", f"{SPACE}+", "")
    measured = at.select(
        "doc_id",
        *[
            x.cast("long").alias(name)
            for name, x in zip(
                MEASURES,
                (
                    n,
                    F.char_length(left),
                    F.char_length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")),
                    F.size("lines"),
                    F.size("lines") - F.size(F.array_distinct("lines")),
                    F.coalesce(covered, F.lit(0)),
                    F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))),
                    F.char_length(F.regexp_replace("text", "[^A-Z]+", "")),
                    count(lambda x: x.rlike(f"^{SPACE}*[-*•]")),
                    count(lambda x: x.rlike(f"(\\.\\.\\.|…){SPACE}*\\z")),
                ),
                strict=True,
            )
        ],
    )
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("long") for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def verdicts(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed, policy (its version) and kept."""
    failed = F.col("failed")
    base = failed.bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select("*", base.alias("base_failed"), F.lit(policy.version).alias("policy"), (~base & policy.keeps(failed)).alias("kept"))


def patterns(rows: DataFrame) -> DataFrame:
    """failed and n: at most 2 to the number of rules rows, whatever the table holds."""
    return rows.groupBy("failed").agg(F.count("*").alias("n"))


def ablations(rows: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule of it: rows that fail the rule, that go by the policy, and that only this rule removes."""
    each = []
    for p in policies:
        for name, _ in RULES:
            if (p.hard | p.soft) & BIT[name]:
                without = Policy(p.version, p.hard & ~BIT[name], p.soft & ~BIT[name], p.allowed)
                failed = F.col("failed")
                each.append(
                    F.struct(
                        F.lit(p.version).alias("policy"),
                        F.lit(name).alias("rule"),
                        (failed.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0).alias("fails"),
                        (~p.keeps(failed)).alias("goes"),
                        (~p.keeps(failed) & without.keeps(failed)).alias("alone"),
                    )
                )
    cases = patterns(rows).select("n", F.explode(F.array(*each)).alias("case")).select("n", "case.*")
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return cases.groupBy("policy", "rule").agg(total("fails"), total("goes"), total("alone"))


def spread(rows: DataFrame, group: str) -> DataFrame:
    """For each group: rows, the rules that any of them fails, and those that all of them fail."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(ledger(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", *MEASURES, "failed", "base_failed", "kept")


def _kept(policy: Policy) -> str:
    return f"(failed & {policy.hard}) = 0 and bit_count(failed & {policy.soft}) <= {policy.allowed}"


ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
split as (select *, regexp_extract_all(text, '{WORD}+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from docs),
windows as (select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w
  from split, unnest(range(1, len(words) - {WINDOW - 2})) as u(i)),
counted as (select *, count(*) over (partition by doc_id, w) as times from windows),
covered as (select doc_id, count(distinct i + k) as n from counted, range({WINDOW}) as r(k) where times > 1 group by doc_id),
measured as (select split.doc_id, len(words) as n_words,
  length(regexp_replace(text, '{SPACE}+', '', 'g')) as word_chars,
  length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols,
  len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(covered.n, 0) as n_repeat_words,
  len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}'))) as n_letter_words,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
  len(list_filter(lines, lambda x: regexp_matches(x, '^{SPACE}*[-*•]'))) as n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){SPACE}*$'))) as n_cut_lines
  from split left join covered using (doc_id)),
judged as (select *, {" + ".join(f"case when {rule} then {BIT[name]} else 0 end" for name, rule in RULES)} as failed from measured)
select doc_id, {", ".join(MEASURES)}, failed::bigint as failed, (failed & {BASE}) <> 0 as base_failed,
  (failed & {BASE}) = 0 and {_kept(CURRENT)} as kept from judged
"""
