"""python -m quarry io|tree PATH... [--format text|json] [--output FILE] [--no-ignore] [--jobs N] [--cache PATH] [--refresh]"""

from __future__ import annotations

import argparse
import contextlib
import sys
from pathlib import Path


def _io(spark, args):
    from quarry.plans.cascade import Cascade, LabelCache, default_cache, provider
    from quarry.plans.io_report import scan_io

    found = provider()
    cascade = None
    if found is not None:
        cascade = Cascade(LabelCache(spark, args.cache or default_cache()), *found, refresh=args.refresh)
    return scan_io(spark, *args.path, ignore=not args.no_ignore, classifier=cascade)


def _tree(spark, args):
    from quarry.plans.tree_report import scan_tree

    return scan_tree(spark, *args.path, ignore=not args.no_ignore)


REPORTS = {"io": _io, "tree": _tree}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quarry", description="Which files do I/O (io), or what a tree looks like (tree).")
    add = parser.add_argument
    add("report", choices=tuple(REPORTS))
    add("path", nargs="+", help="roots to read")
    add("--format", choices=("text", "json"), default="text")
    add("--output", type=Path, metavar="FILE", help="where the report goes instead of standard output")
    add("--no-ignore", action="store_true", help="also read ignored and dependency directories")
    add("--jobs", type=int, help="cores of a session of our own (default: all)")
    add("--cache", metavar="PATH", help="folder of the model's labels; any store that Spark writes to")
    add("--refresh", action="store_true", help="ask the model again for names that the cache has")
    args = parser.parse_args(argv)
    wrong = next((f"not a directory: {p}" for p in args.path if not Path(p).is_dir()), None)
    if args.jobs is not None and args.jobs < 1:
        wrong = "--jobs must be 1 or more"
    if wrong:
        parser.error(wrong)
    return args


def _session(jobs: int | None):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("quarry")
    spark = (builder.master(f"local[{jobs}]") if jobs else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _arguments(argv)
    report = REPORTS[args.report](spark or _session(args.jobs), args)
    with contextlib.ExitStack() as stack:
        out = stack.enter_context(args.output.open("w", encoding="utf-8")) if args.output else sys.stdout
        print({"text": report.to_text, "json": report.to_json}[args.format](), end="", file=out)
    return 0
