"""JSON documents: one canonical form, and a check that a notification carries no free text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.types import BooleanType, StringType

from .batches import bounded_udf

CODE = re.compile(r"[A-Za-z0-9_.:+\-]{0,100}")


def sorted_json(text: str | None) -> str | None:
    """Keys sorted at every depth, no white space; null where the text is null or no JSON."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def codes_only(text: str | None) -> bool | None:
    """Whether all strings among the values are codes: letters, digits and _.:+- up to 100. Null where the text is null or no JSON."""
    try:
        left = [] if text is None else [json.loads(text)]
    except (ValueError, RecursionError):
        return None
    while left:
        value = left.pop()
        if isinstance(value, dict):
            left += value.values()
        elif isinstance(value, list):
            left += value
        elif isinstance(value, str) and not CODE.fullmatch(value):
            return False
    return None if text is None else True


@bounded_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    return texts.map(sorted_json)


@bounded_udf(BooleanType())
def without_text(texts: pd.Series) -> pd.Series:
    return texts.map(codes_only)
