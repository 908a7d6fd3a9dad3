"""Label a log from the command line: python -m tidelog.cli LOG OUT [options]."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog", description="Label the locations of an access log as bots, hubs or organic use.")
    p.add_argument("log", help="Parquet log")
    p.add_argument("out", help="folder for reports")
    p.add_argument("--method", choices=("rules", "deep"), default="rules")
    p.add_argument("--provider", default="default")
    p.add_argument("--providers-dir", help="folder of provider YAML files")
    p.add_argument("--output-strategy", choices=("new_file", "overwrite", "reports_only"), default="new_file")
    p.add_argument("--sample-size", type=int, help="label this many events only; the log is then not written back")
    p.add_argument("--min-location-downloads", type=int)
    p.add_argument("--min-year", type=int)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--iterations", type=int, default=200, help="boosting rounds of the deep method")
    p.add_argument("--html", action="store_true", help="write an HTML report too")
    p.add_argument("--csv", action="store_true", help="write the location table as CSV too")
    return p


def main(argv: list[str] | None = None) -> dict:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidelog.operators.reporting import html_report, text_report
    from tidelog.plans import pipeline
    from tidelog.schema import override
    from tidelog.sources import providers, readers
    from tidelog.storage import settled

    args = parser().parse_args(argv)
    if args.providers_dir:
        providers.discover(args.providers_dir)
    provider = providers.get(args.provider)
    changes = {k: v for k, v in (("min_location_downloads", args.min_location_downloads), ("min_year", args.min_year)) if v is not None}
    schema = override(provider.schema, **changes)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    events = readers.read_log(spark, args.log)
    if args.sample_size:
        events = readers.sample_exact(events, args.sample_size, [schema.location_field, schema.timestamp_field], args.seed)
    options = {"iterations": args.iterations} if args.method == "deep" else {}
    result = pipeline.run(events, schema, args.method, provider.taxonomy, **options)
    locations = settled(result["locations"])
    written = readers.write_annotated(result["annotated"], args.log, args.output_strategy, sampled=bool(args.sample_size))
    folder = Path(args.out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "report.txt").write_text(text_report(locations), encoding="utf-8")
    if args.html:
        (folder / "report.html").write_text(html_report(locations), encoding="utf-8")
    if args.csv:
        readers.write_csv(locations, str(folder / "location_analysis.csv"))
    counts = locations.agg(*[F.count_if(F.col(f"is_{k}")).alias(k) for k in ("bot", "hub", "organic")]).first().asDict()
    summary = {"output": written, "locations": counts}
    readers.write_json(summary, str(folder / "summary.json"))
    print(json.dumps(summary))
    return summary


if __name__ == "__main__":
    main()
