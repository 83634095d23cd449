"""Numbers, money and dates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(x: Column, places: int = 3) -> Column:
    """Half to even, as scores are stored."""
    return F.bround(x, places)


def money(x: Column) -> Column:
    """Half away from zero, two places."""
    return F.round(x.cast("decimal(18,6)"), 2).cast("decimal(18,2)")


def backoff(attempts: Column, base: float = 5.0, most: float = 3600.0) -> Column:
    """Seconds before a retry, without jitter: base * 2^(attempts - 1), at most `most`."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(most))


def fair_use(count: Column, factor: float) -> Column:
    return F.floor(F.lit(factor) * F.greatest(count, F.lit(1))).cast("long")


def vat(net: Column, rate: Column) -> tuple[Column, Column]:
    """VAT and gross of a net amount."""
    tax = money(net.cast("decimal(18,6)") * rate.cast("decimal(6,4)"))
    return tax, (money(net) + tax).cast("decimal(18,2)")


def vat_treatment(country: Column, home: str, has_number: Column, union: list[str]) -> Column:
    """domestic, reverse_charge (another member with a number), one_stop (without), or export."""
    return (
        F.when(country == home, "domestic")
        .when(country.isin(union) & has_number, "reverse_charge")
        .when(country.isin(union), "one_stop")
        .otherwise("export")
    )


def next_period(anchor: Column, step: int, floor: Column, most: int = 600) -> Column:
    """The first anchor + k * step months that isn't before floor; days clamp to the month's end, from the anchor."""
    ks = F.sequence(F.lit(0), F.lit(most), F.lit(step))
    return F.array_min(F.filter(F.transform(ks, lambda k: F.add_months(anchor, k)), lambda d: d >= floor))


def evidence_status(valid_until: Column, today: Column, soon: int = 30) -> Column:
    left = F.datediff(valid_until, today)
    return F.when(valid_until.isNull(), "valid").when(left < 0, "expired").when(left <= soon, "expiring").otherwise("valid")


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def token_cost(chars: Column, per_token: float = 2.6, usd_per_million: float = 0.042) -> tuple[Column, Column]:
    """Tokens and US dollars of so many characters."""
    tokens = F.ceil(chars / F.lit(per_token)).cast("long")
    return tokens, F.bround(tokens.cast("double") * usd_per_million / 1e6, 6)


def strictness(status: Column, group: Column, severity: Column, band: Column) -> Column:
    """0 (strictest) to 127: status * 64 + group * 16 + severity * 4 + band."""
    return status * 64 + group * 16 + severity * 4 + band


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trial_end(start: Column, days: int | None = None) -> Column:
    """The same day of the next month (its last day where it is shorter), or so many days later."""
    return F.add_months(start, 1) if days is None else F.date_add(start, days)
