"""Command line of the batch runs (also for spark-submit).

    python -m turnout enrich  --event SLUG --registrants CSV --crm JSON --out FOLDER
    python -m turnout analyse --contacts PARQUET --engagement PARQUET --lifecycle PARQUET --mails PARQUET --out FOLDER
    python -m turnout check   --lines PARQUET --files PARQUET --assets PARQUET --roster PARQUET --out FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from turnout.functions.contact import Rules
from turnout.operators import quality as Q
from turnout.plans.analytics import analyse
from turnout.plans.content import check_assets
from turnout.plans.enrichment import enrich
from turnout.session import configure
from turnout.sources import readers, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="turnout", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    runs = parser.add_subparsers(dest="run", required=True)
    for run, inputs in (("enrich", ("event", "registrants", "crm")), ("analyse", ("contacts", "engagement", "lifecycle", "mails")),
                        ("check", ("lines", "files", "assets", "roster"))):
        sub = runs.add_parser(run)
        for name in (*inputs, "out"):
            sub.add_argument(f"--{name}", required=True)
        if run == "enrich":
            sub.add_argument("--limit-rows", type=int)
    a = parser.parse_args(argv)
    spark = configure(SparkSession.builder.appName("turnout").getOrCreate())
    if a.run == "enrich":
        rows = readers.registrants(spark, a.registrants, a.event)
        rows = readers.first_rows(rows, a.limit_rows) if a.limit_rows else rows
        from pyspark.sql.functions import lit
        out = enrich(rows, readers.crm_contacts(spark, a.crm).withColumn("event_slug", lit(a.event)), Rules())
        sinks.write_views(out["contacts"], out["companies"], a.out)
        for name in ("rejected", "review", "unresolved"):
            sinks.write_report(out[name], f"{a.out}/{name}")
        rates = Q.fill_rates(out["contacts"], tuple(dict.fromkeys(Q.fixed.COMPLETENESS_FIELDS + Q.fixed.COMPANY_SPEC)))
        sinks.write_report(rates, f"{a.out}/fill_rates")
        sinks.write_report(Q.completeness(rates), f"{a.out}/completeness")
        sinks.write_report(Q.review_counts(out["contacts"]), f"{a.out}/review_counts")
    elif a.run == "analyse":
        tables = [spark.read.parquet(getattr(a, n)) for n in ("contacts", "engagement", "lifecycle", "mails")]
        for name, df in analyse(*tables).items():
            sinks.write_events(df, f"{a.out}/{name}")
    else:
        tables = [spark.read.parquet(getattr(a, n)) for n in ("lines", "files", "assets", "roster")]
        for name, df in check_assets(*tables).items():
            sinks.write_events(df, f"{a.out}/{name}")


if __name__ == "__main__":
    main()
