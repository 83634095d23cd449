"""Which rule sets a run takes, and which modules ran for which jurisdictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of modules in reports, others follow by name.
MODULE_ORDER = ("eco", "dur", "lr", "ucp", "legal")


def selected(sets: DataFrame, modules: list[str] | None, jurisdictions: list[str]) -> DataFrame:
    """The rule sets (module, name, enabled, jurisdictions) that are enabled and hold for one of the jurisdictions."""
    some = sets if modules is None else sets.filter(F.col("module").isin(modules))
    return some.filter(F.col("enabled") & F.arrays_overlap("jurisdictions", F.array(*map(F.lit, jurisdictions)).cast("array<string>")))


def coverage(sets: DataFrame, modules: list[str] | None, jurisdictions: list[str]) -> DataFrame:
    """(place, module, jurisdiction, state, reason, warning, elsewhere, names) of every module and jurisdiction.

    sets: module, name, enabled, jurisdictions (array). Without `modules` those with an enabled set for a chosen
    jurisdiction count, and nothing warns. `state` is ran or not_run; `elsewhere` are the module's jurisdictions where a
    module has none here, `names` the sets that are disabled. The lattice is each module exploded by the chosen
    jurisdictions, no cross join; sets, of any number, are aggregated by both before they are joined to it. A null module
    or jurisdiction covers nothing; repeated sets count once; without sets each asked module is not run.
    """
    chosen = F.array(*map(F.lit, dict.fromkeys(jurisdictions))).cast("array<string>")
    sets = sets.filter("module is not null")
    if modules is None:
        asked = selected(sets, None, jurisdictions).select("module").distinct()
    else:
        asked = sets.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(modules)], "module string")
    each = sets.select("module", "name", F.coalesce("enabled", F.lit(False)).alias("enabled"), F.explode("jurisdictions").alias("jurisdiction"))
    each = each.filter("jurisdiction is not null")
    here = each.groupBy("module", "jurisdiction").agg(F.max("enabled").alias("on"), F.array_sort(F.collect_set("name")).alias("names"))
    where = each.groupBy("module").agg(F.array_sort(F.collect_set("jurisdiction")).alias("all"))
    known = sets.select("module").distinct().withColumn("known", F.lit(True))
    lattice = asked.select("module", F.explode(chosen).alias("jurisdiction"))
    cells = lattice.join(here, ["module", "jurisdiction"], "left").join(where, "module", "left").join(known, "module", "left")
    gap, off = F.col("on").isNull(), ~F.col("on")
    warning = F.when(F.col("known").isNull(), "module_no_rule_set").when(gap, "module_other_jurisdiction").when(off, "module_disabled")
    place = F.coalesce(F.expr(f"nullif(array_position(array({', '.join(repr(m) for m in MODULE_ORDER)}), module), 0)"), F.lit(len(MODULE_ORDER) + 1))
    return cells.select(
        place.cast("long").alias("place"),
        "module",
        "jurisdiction",
        F.when(F.col("on"), "ran").otherwise("not_run").alias("state"),
        F.when(gap, "no_rules_for_jurisdiction").when(off, "rule_set_disabled").alias("reason"),
        (F.lit(None).cast("string") if modules is None else warning).alias("warning"),
        F.when(gap, F.coalesce("all", F.array().cast("array<string>"))).alias("elsewhere"),
        F.when(off, F.col("names")).alias("names"),
    )
