"""python -m sievemark scan PAGES RULES OUT | check-text TEXTS RULES OUT | rules RULES"""

from __future__ import annotations

import datetime as dt
import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from . import scan as S
    from .operators import rules as R

    if len(args) == 2 and args[0] == "rules":
        with open(args[1], encoding="utf-8") as f:
            found = R.compiled(f.read())
        print(*(f"{r.id} {r.module} {r.severity} {','.join(r.jurisdictions)}" for r in found.rules), sep="\n")
        return 0
    if len(args) != 4 or args[0] not in ("scan", "check-text"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("sievemark").getOrCreate()
    with open(args[2], encoding="utf-8") as f:
        rules = f.read()
    df = spark.read.parquet(args[1])
    today = dt.date.today()
    report = S.scan(df, rules, today) if args[0] == "scan" else S.analyze_texts(df, rules, "doc_id", "text", "source", today)
    report.findings.write.mode("overwrite").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
