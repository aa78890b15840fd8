"""Command line: watch, combine, convert, clean."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession, functions as F

from .operators import publish
from .plans import jobs
from .sources import json_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkstream")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("combine", help="JSON files of folders as JSON lines, one output for each folder")
    c.add_argument("-d", "--directories", nargs="+", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--no-recursive", action="store_true")
    c.add_argument("--add-source", action="store_true")
    c.add_argument("--no-transform", action="store_true")
    v = sub.add_parser("convert", help="enriched documents as JSON lines")
    v.add_argument("-i", "--input", required=True)
    v.add_argument("-o", "--output", required=True)
    v.add_argument("-s", "--source", default="documents")
    v.add_argument("--no-transform", action="store_true")
    k = sub.add_parser("clean", help="clean the newest batch file into a keyed table")
    k.add_argument("input")
    k.add_argument("output")
    w = sub.add_parser("watch", help="new rows of a listing, with their pages, into the master table")
    w.add_argument("listing")
    w.add_argument("master")
    w.add_argument("--batch", help="new rows as JSON lines")
    w.add_argument("--daily", type=int, metavar="HOUR", help="once a day from this hour on, without end")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("inkstream").getOrCreate()
    today = datetime.date.today()
    if args.command == "combine":
        errors = 0
        for folder in args.directories:
            out = f"{args.output}/{publish.source_name(folder)}-{args.directories.index(folder)}" if len(args.directories) > 1 else args.output
            stats = jobs.combine(spark, folder, out, today.isoformat(), not args.no_recursive, args.add_source, not args.no_transform).first()
            print(folder, out, stats.asDict())
            errors += stats["errors"]
        return int(errors > 0)
    if args.command == "convert":
        print(jobs.convert(spark, args.input, args.output, args.source, str(today.year), not args.no_transform).first().asDict())
        return 0
    if args.command == "watch":
        run = lambda: jobs.watch(spark, args.listing, args.master, datetime.datetime.now().isoformat(" ", "seconds"), batch_path=args.batch)
        if args.daily is not None:
            jobs.daily(run, args.daily)
            return 0
        report = run()
        print(report)
        return int(report.mode == "empty")
    path = json_files.newest(spark, args.input)
    if path is None:
        print("no input")
        return 1
    cases = json_files.objects(json_files.files(spark, path)).where(~F.col("corrupt"))
    at = lambda k: F.try_element_at("obj", F.lit(k))
    rows = cases.select(at("RAG_ID").alias("rag_id"), at("text").alias("text"), F.map_filter("obj", lambda k, v: ~k.isin("text", "Scraped_At", "RAG_ID")).alias("fields"), F.col("obj_pos").alias("position"))
    print(jobs.split_and_clean(spark, rows, args.output).count(), "cases")
    return 0


if __name__ == "__main__":
    sys.exit(main())
