"""Command line: ``spark-submit wallscope/cli.py <job> ...`` or ``python -m wallscope.cli``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from wallscope.operators.enrich import MALICIOUS
from wallscope.plans import jobs, reports
from wallscope.session import build_session, materialize, scratch_scope
from wallscope.sources.feeds import DEFAULT_SOURCES, EXTRA_SOURCES


def _show(title: str, df: DataFrame) -> None:
    """Print every row; rows come to the driver one partition after another."""
    print(f"\n{title}")
    print(" | ".join(df.columns))
    for row in df.toLocalIterator():
        print(" | ".join("NULL" if value is None else str(value) for value in row))


def _parse(spark: SparkSession, args: argparse.Namespace) -> None:
    parsed = jobs.parse_logs(spark, args.input, args.output, partitions=args.partitions)
    if args.output:
        print(f"parsed logs saved to {args.output}")
        return
    with scratch_scope(spark):
        # Stored once: the lines are parsed a single time for all summaries.
        parsed = materialize(parsed, "parsed")
        _show("Total entries", reports.row_total(parsed))
        _show("Protocol distribution", reports.protocol_distribution(parsed))
        _show("Sample entries", reports.sample_parsed(parsed, args.sample))


def _enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    if getattr(args, "info", False):
        _show("Feeds", jobs.describe_feeds(spark, args.threats, time.time()))
        return
    if not args.input:
        raise ValueError("an input table is required")
    with scratch_scope(spark):
        enriched = jobs.enrich_logs(
            spark,
            args.input,
            args.column,
            geo_path=getattr(args, "geo", None),
            asn_path=getattr(args, "asn", None),
            feeds_path=getattr(args, "threats", None),
            output_path=args.output,
        )
        if not args.output:
            enriched = materialize(enriched, "enriched")
        if args.output:
            print(f"enriched logs saved to {args.output}")
        if MALICIOUS in enriched.columns:
            _show("Malicious connections", reports.threat_summary(enriched))
            if reports.threat_source_columns(enriched):
                _show("By source", reports.threat_by_source(enriched))
        if "geo_country_name" in enriched.columns:
            _show("Enrichment summary", reports.enrichment_summary(enriched))
            _show("Top countries", reports.leading_countries(enriched))
        if args.sample > 0:
            if args.job == "threat":
                sample = reports.sample_malicious(enriched, args.column, args.sample)
            else:
                shown = 3 if args.job == "enrich" else None
                sample = reports.sample_enriched(enriched, args.column, args.sample, per_kind=shown)
            _show("Sample entries", sample)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    with scratch_scope(spark):
        chosen = jobs.traffic_reports(
            jobs.read_table(spark, args.input),
            args.number,
            args.ports,
            args.protocol,
            args.hourly,
            args.source_ports,
            args.interfaces,
            args.asn,
            args.threat_intel,
            on_skip=lambda name, columns: print(f"skipped {name}: the table lacks {columns}", file=sys.stderr),
        )
        for name, report in chosen.items():
            if args.output:
                report.write.mode("overwrite").parquet(f"{args.output}/{name}")
            else:
                _show(name.replace("_", " ").capitalize(), report)


def _publish(spark: SparkSession, args: argparse.Namespace) -> None:
    # Asking for the extra feeds replaces the default list (D7).
    sources = args.source or list(EXTRA_SOURCES if args.add_sources else DEFAULT_SOURCES)
    now = time.time()
    _show("Feeds", jobs.publish_feeds(spark, args.landing, args.feeds, now, sources))
    outcome = jobs.publish_outcome(spark, args.feeds, now, sources)
    _show("Outcome", outcome)
    # One row per source asked for on the command line.
    failed = [row.source for row in outcome.where("outcome <> 'published'").collect()]
    if failed:
        raise ValueError(f"not published: {', '.join(failed)}")


def _networks(spark: SparkSession, args: argparse.Namespace) -> None:
    table = jobs.build_networks(spark, args.records, args.table, args.kind)
    _show("Networks", reports.row_total(table))


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Firewall log analytics on Spark")
    tasks = parser.add_subparsers(dest="job", required=True)

    parse = tasks.add_parser("parse", help="parse raw logs")
    parse.add_argument("input")
    parse.add_argument("-o", "--output")
    parse.add_argument("--sample", type=int, default=5)
    parse.add_argument("--partitions", type=int, help="spread lines of big gzip files")
    parse.set_defaults(run=_parse)

    for name, with_geo, with_threats in (
        ("geo", True, False),
        ("threat", False, True),
        ("enrich", True, True),
    ):
        task = tasks.add_parser(name, help=f"{name} enrichment of a parsed table")
        task.add_argument("input", nargs="?" if name == "threat" else None)
        task.add_argument("-c", "--column", default="src_ip")
        task.add_argument("-o", "--output")
        task.add_argument("--sample", type=int, default=5)
        if with_geo:
            task.add_argument("-g", "--geo", required=True, help="city network table")
            task.add_argument("-a", "--asn", help="owner network table")
        if with_threats:
            task.add_argument("-t", "--threats", required=name == "threat", help="published feeds")
        if name == "threat":
            task.add_argument("--info", action="store_true", help="describe the feeds only")
        task.set_defaults(run=_enrich)

    report = tasks.add_parser("report", help="reports over an enriched table")
    report.add_argument("input")
    report.add_argument("-n", "--number", type=int, default=reports.TOP_LOCATIONS)
    report.add_argument("-p", "--ports", type=int, default=reports.TOP_PORTS)
    for flag in ("protocol", "hourly", "source-ports", "interfaces", "asn", "threat-intel"):
        report.add_argument(f"--{flag}", action="store_true")
    report.add_argument("-o", "--output", help="write one table per report instead of printing")
    report.set_defaults(run=_report)

    publish = tasks.add_parser("publish", help="publish landed feed files")
    publish.add_argument("landing")
    publish.add_argument("feeds")
    publish.add_argument("--source", action="append", help="source to publish (repeatable)")
    publish.add_argument("--add-sources", action="store_true", help="publish the extra feeds")
    publish.set_defaults(run=_publish)

    networks = tasks.add_parser("networks", help="make a network table from city or owner records")
    networks.add_argument("kind", choices=["geo", "asn"])
    networks.add_argument("records", help="Parquet records with a CIDR column 'network'")
    networks.add_argument("table")
    networks.set_defaults(run=_networks)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = build_session(f"wallscope-{args.job}")
    try:
        args.run(spark, args)
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
