"""Claim lists from a document of macros: one expression for each item and country, and the texts that they match.

A document has macros (an absence for each country, and a gap), categories (an expression for each country) and items. An
item gives its substance, optionally an adjective, an English name and something extra, or a whole expression of its own;
what it has for a country goes before what it has for all. Items are at most MOST_CLAIMS; faults are returned, not raised.
"""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CLAIMS = 2_000
#: What a hit asks for.
OUTCOMES = ("text", "verify", "none", "irrelevant")


def composed(absence: str, gap: str, subst: str, adj: str | None = None, en: str | None = None, extra: str | None = None) -> str:
    """The expression of a claim that something is absent: in words, as an adjective, in English, as a zero share."""
    # The forms of these alternatives.
    forms = [rf"\b{absence}\s+{gap}(?:{subst})"]
    forms += [rf"\bbez-?(?:{adj})"] if adj else []
    forms += [rf"\b(?:{en})\s*-?\s*free\b", rf"\bfree\s+(?:from|of)\s+(?:{en})"] if en else []
    return f"(?i)(?:{'|'.join([*forms, rf'\b0\s*%\s*(?:{subst})', *([extra] if extra else [])])})"


def claim_rows(document: str | dict) -> tuple[list[tuple], list[str]]:
    """(id, country, claim, category, exclude, outcome) of each item and country, and what is wrong with the document.

    An item with a fault of its own gives no rows; one that lacks something for a country gives none for that country.
    """
    given = yaml.safe_load(document) if isinstance(document, str) else document
    macros, categories, items = (given.get(k) or d for k, d in (("macros", {}), ("categories", {}), ("claims", [])))
    countries = sorted({c for own in categories.values() for c in own})
    faults = [f"macro {m} is missing" for m in (*(f"abs_{c}" for c in countries), "gap") if m not in macros]
    ids = [x.get("id") for x in items]
    faults += [f"{i}: listed twice" for i in sorted({str(i) for i in ids if ids.count(i) > 1})]
    if len(items) > MOST_CLAIMS:
        raise ValueError(f"a claim list holds at most {MOST_CLAIMS} items")
    rows: list[tuple] = []
    whole = not faults or all("macro" not in f for f in faults)
    for x in items:
        name = x.get("id")
        outcomes = [x[k] for k in x if k == "outcome" or k.startswith("outcome_")]
        if not name or "outcome" not in x or not set(outcomes) <= set(OUTCOMES):
            faults.append(f"{name}: id and outcome (of {', '.join(OUTCOMES)}) are needed")
            continue
        if x.get("category") not in categories:
            faults.append(f"{name}: no category {x.get('category')}")
            continue
        for country in countries if whole else ():
            own = lambda field, c=country: x.get(f"{field}_{c}", x.get(field))  # noqa: B023, E731
            claim, subst, category = own("claim"), own("subst"), categories[x["category"]].get(country)
            if category is None or claim is None and subst is None:
                faults.append(f"{name}: no {'claim or subst' if category else 'category expression'} for {country}")
                continue
            claim = claim or composed(macros[f"abs_{country}"], macros["gap"], subst, own("adj"), x.get("en"), own("extra"))
            try:
                for pattern in (claim, category, x.get("category_exclude") or ""):
                    re.compile(pattern)
            except re.error as fault:
                faults.append(f"{name} ({country}): {fault}")
                continue
            rows.append((name, country, claim, category, x.get("category_exclude"), own("outcome")))
    return rows, faults


def claim_hits(texts: DataFrame, keys: list[str], text: str, country: str, rows: list[tuple], subject: str | None = None) -> DataFrame:
    """(keys, claim, outcome): the claims of a text's country whose expression it matches, where its subject (the text
    itself unless another column is named) matches the category and not what the category excludes. All claims are
    columns over one scan; words and spaces are those of Unicode; a null text, subject or country meets none."""
    body, what = F.col(text), F.col(subject or text)
    tests = []
    for name, land, claim, category, exclude, outcome in rows:
        hit = (F.col(country) == land) & body.rlike(f"(?U){claim}") & what.rlike(f"(?U){category}")
        hit = hit & ~what.rlike(f"(?U){exclude}") if exclude else hit
        tests.append(F.when(hit, F.struct(F.lit(name).alias("claim"), F.lit(outcome).alias("outcome"))))
    none = F.array().cast("array<struct<claim:string,outcome:string>>")
    found = F.filter(F.array(*tests), lambda v: v.isNotNull()) if tests else none
    return texts.select(*keys, F.explode(found).alias("c")).select(*keys, "c.claim", "c.outcome")
