"""Questions, proposals, evidence, groups and reviews around findings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.batches import bounded_udf


def propagated(answers: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Every question gets the latest answer that any question of the same keys (code, fingerprint) has."""
    last = answers.groupBy(*keys).agg(F.max_by("answer", F.struct("at", "question")).alias("answer"))
    return questions.join(last, keys, "left")


def request_parts(asked: DataFrame, segment: str, question: str, definition: str) -> DataFrame:
    """(segment, part, questions): one request for a segment with all its questions; where one id has several
    definitions, each further definition opens a further request."""
    rank = F.dense_rank().over(Window.partitionBy(segment, question).orderBy(definition))
    parts = asked.withColumn("part", rank.cast("long"))
    return parts.groupBy(segment, "part").agg(F.array_sort(F.collect_set(question)).alias("questions"))


def best_profile(pages: DataFrame, profiles: DataFrame, key: str, tokens: str, most: float = 0.1) -> DataFrame:
    """(key, profile, share): the profile that leaves the least share of a page's tokens unknown, if it is at most `most`.

    profiles (profile, known) is a small table; it is checked and goes to every task.
    """
    from .pricing import small

    both = pages.select(key, tokens).join(small(profiles))
    unknown = F.size(F.array_except(tokens, "known")) / F.greatest(F.size(F.array_distinct(tokens)), F.lit(1))
    best = both.withColumn("share", unknown).groupBy(key).agg(F.min(F.struct("share", "profile")).alias("b"))
    return best.select(key, F.when(F.col("b.share") <= most, F.col("b.profile")).alias("profile"), F.col("b.share").alias("share"))


def composed(text: Column, changes: Column) -> Column:
    """text after a fold of changes (array of old, new); a change whose old text is missing is left out."""
    return F.aggregate(changes, text, lambda t, c: F.when(c["old"] == "", t).otherwise(F.replace(t, c["old"], c["new"])))


def place(text: str, changes) -> tuple[str, list[int]]:
    """text with each change (old, new) at the first spot of its old words, whatever the white space between them, that
    no earlier change has taken; and the numbers, from 0, of the changes without such a spot."""
    taken: list[tuple[int, int, str]] = []
    missed = []
    for i, change in enumerate(changes):
        words = (change["old"] or "").split()
        spots = re.finditer(r"\s+".join(map(re.escape, words)), text) if words else ()
        spot = next((m.span() for m in spots if all(m.end() <= a or b <= m.start() for a, b, _ in taken)), None)
        if spot:
            taken.append((*spot, change["new"] or ""))
        else:
            missed.append(i)
    out, at = [], 0
    for a, b, new in sorted(taken):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), missed


@bounded_udf(StructType().add("text", StringType()).add("unplaced", ArrayType(IntegerType())))
def placed(text: pd.Series, changes: pd.Series) -> pd.DataFrame:
    """place() on columns; a null text stays null and takes no change, and a null list holds none."""
    rows = [(None, [*range(len(c))]) if t is None else place(t, c) for t, c in ((t, [] if c is None else c) for t, c in zip(text, changes, strict=True))]
    return pd.DataFrame(rows, columns=["text", "unplaced"])


def recheck(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, status) of findings after a rewrite: still_finding where the rule matches again, resolved where not, and
    waiting where nothing was evaluated."""
    now = after.select(key, F.col("outcome").alias("now"))
    status = F.when(F.col("now") == "match", "still_finding").when(F.col("now") == "no_match", "resolved").otherwise("waiting")
    return before.select(key).join(now, key, "left").select(key, status.alias("status"))


def summary(states: DataFrame, key: str) -> DataFrame:
    """(key, state, notices): the state of lowest priority number, and the others as notices in order."""
    rows = F.array_sort(F.collect_set(F.struct("priority", "state")))
    out = states.groupBy(key).agg(rows.alias("r"))
    return out.select(key, F.col("r")[0]["state"].alias("state"), F.array_join(F.transform(F.slice("r", 2, 100_000), lambda x: x["state"]), ",").alias("notices"))


def frontier(urls: DataFrame, site: str, limit: int) -> DataFrame:
    """The order in which a site's pages are fetched: legal pages first, then one product and one other page in turn."""
    queue = F.when(F.col("class") == "legal", 0).when(F.col("class") == "product", 1).otherwise(2)
    q = urls.withColumn("queue", queue)
    place = F.row_number().over(Window.partitionBy(site, "queue").orderBy("ord"))
    q = q.withColumn("turn", F.when(F.col("queue") == 0, F.lit(0)).otherwise(place)).withColumn("place", place)
    n = F.row_number().over(Window.partitionBy(site).orderBy("turn", "queue", "place"))
    return q.withColumn("n", n).filter(F.col("n") <= limit).drop("queue", "turn", "place")


def holding(sets: DataFrame, ids: str, found: DataFrame, key: str) -> DataFrame:
    """Rows of `found` with each row of `sets` whose array `ids` holds their key; an id repeated in one array counts once."""
    return sets.withColumn(key, F.explode(F.array_distinct(ids))).drop(ids).join(found, key)


def reach(questions: DataFrame, places: DataFrame, by: str, question: str, finding: str, own: str, page: str) -> DataFrame:
    """Distinct questions, findings and pages by answer: pages where a finding occurs, and its own page if it has one."""
    pages = questions.select(by, finding).distinct().join(places.select(finding, page).distinct(), finding).select(by, page)
    pages = pages.unionByName(questions.filter(F.col(own).isNotNull()).select(F.col(by), F.col(own).alias(page)))
    counted = pages.groupBy(by).agg(F.count_distinct(page).alias("pages"))
    asked = questions.groupBy(by).agg(F.count_distinct(question).alias("questions"), F.count_distinct(finding).alias("findings"))
    return asked.join(counted, by, "left").fillna(0, ["pages"])


def markdown(found: DataFrame, section: str, item: str, label: str) -> DataFrame:
    """(section, part, item, line): a heading for each section and a line for each item; the order of the report is that of the first three."""
    n = found.groupBy(section, item).agg(F.count("*").alias("n"))
    head = n.groupBy(section).agg(F.count("*").alias("items"), F.sum("n").alias("n"))
    title = F.concat(F.lit("## "), section, F.lit(": "), "items", F.lit(f" {label}s, "), "n", F.lit(" places"))
    line = F.concat(F.lit(f"- {label} "), item, F.lit(": "), "n", F.lit(" places"))
    top = head.select(F.col(section).alias("section"), F.lit(0).alias("part"), F.lit(None).cast(n.schema[item].dataType).alias("item"), title.alias("line"))
    return top.unionByName(n.select(F.col(section).alias("section"), F.lit(1).alias("part"), F.col(item).alias("item"), line.alias("line")))


def rewritten(df: DataFrame, text: str, rewrite=None, out: str = "rewritten") -> DataFrame:
    """Texts through a pluggable rewriter: a picklable function from a Series of texts to a Series of texts, batch by batch.

    By default the mock: trims and ends the text with a full stop. Null stays null, whatever the rewriter gives.
    """
    plug = rewrite or _mock_rewrite

    @bounded_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        asked = texts.dropna()
        return plug(asked).reindex(texts.index) if len(asked) else texts

    return df.withColumn(out, run(text))


def _mock_rewrite(texts: pd.Series) -> pd.Series:
    return texts.str.strip().str.rstrip(".") + "."
