"""Page templates: classification by URL, and greedy clustering by structure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded


def page_class(path: Column, legal: list[str], products: str = r"/(?:p|product|produkt|item)[-/]") -> Column:
    """home over product over legal over content."""
    return (
        F.when(path.isin("", "/"), "home")
        .when(path.rlike(products), "product")
        .when(F.exists(F.array(*map(F.lit, legal)), lambda s: F.contains(F.lower(path), s)), "legal")
        .otherwise("content")
    )


def clusters(df: DataFrame, site: str, order: str, tokens: str, least: float = 0.75) -> DataFrame:
    """(site, order, leader): a page joins the first leader of its site, in order, with a Jaccard of `least`; else it leads.

    Order decides, so a site's pages go through one task in order: distinct token sets only, each with its first page,
    batch by batch, so what a task holds is the leaders of one site. Pages without a site are left out.
    """
    key = F.xxhash64(tokens)
    shapes = df.groupBy(site, key.alias("shape")).agg(F.min(order).alias("first_at"), F.first(tokens).alias("tokens"))

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders: list[tuple[int, set]] = []
        last = None
        for batch in batches:
            out = []
            for own_site, first_at, shape, held in zip(batch[site], batch["first_at"], batch["shape"], batch["tokens"], strict=True):
                if own_site != last:
                    leaders, last = [], own_site
                own = set(held)
                hit = next((at for at, t in leaders if len(own & t) >= least * max(1, len(own | t))), None)
                if hit is None:
                    leaders.append((first_at, own))
                    hit = first_at
                out.append((own_site, shape, hit))
            yield pd.DataFrame(out, columns=[site, "shape", "leader"])

    kind = df.schema[site].dataType.simpleString()
    bounded(df.sparkSession)
    in_order = shapes.select(site, "first_at", "shape", "tokens").filter(F.col(site).isNotNull())
    in_order = in_order.repartition(site).sortWithinPartitions(site, "first_at", "shape")
    led = in_order.mapInPandas(lead, f"`{site}` {kind}, shape long, leader long")
    return df.select(site, order, key.alias("shape")).join(led, [site, "shape"]).select(site, order, "leader")


def signatures(df: DataFrame, facts: str, table: list[tuple[str, str, str]]) -> Column:
    """Platforms whose fixed signature (platform, kind, pattern) matches a text: one array of (platform, kind)."""
    return F.filter(F.array(*[F.when(F.col(facts).rlike(p), F.struct(F.lit(n).alias("platform"), F.lit(k).alias("kind"))) for n, k, p in table]), lambda x: x.isNotNull())


def platform(found: Column) -> Column:
    """unknown without or with several platforms, certain with two kinds of signature, else likely."""
    names = F.array_distinct(F.transform(found, lambda x: x["platform"]))
    kinds = F.array_distinct(F.transform(found, lambda x: x["kind"]))
    return F.when(F.size(names) != 1, "unknown").when(F.size(kinds) >= 2, "certain").otherwise("likely")
