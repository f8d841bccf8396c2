"""Command line: merge, split, templates."""

from __future__ import annotations

import argparse
import sys

from braidlog.operators.reports import check_lines, printed
from braidlog.plans.days import merge, split
from braidlog.plans.templates import per_node, templates
from braidlog.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidlog")
    commands = p.add_subparsers(dest="command", required=True)
    m = commands.add_parser("merge", help="interleave node files into one file a day")
    m.add_argument("input_dir")
    m.add_argument("-o", "--output-dir")
    m.add_argument("-l", "--level", type=int, default=19)
    m.add_argument("-j", "--jobs", type=int, default=1, help="tasks that compress a day, 0 for one on each core")
    m.add_argument("-D", "--days", type=int, default=1, help="days at once, 0 for as many as there are cores")
    m.add_argument("--before")
    m.add_argument("--check", action="store_true")
    s = commands.add_parser("split", help="one file for each node of a merged log")
    s.add_argument("input")
    s.add_argument("-o", "--output-dir", required=True)
    t = commands.add_parser("templates", help="the templates of a log's lines")
    t.add_argument("input", nargs="?")
    t.add_argument("--depth", type=int, default=4)
    t.add_argument("--threshold", type=float, default=0.5)
    t.add_argument("--min-count", type=int, default=1)
    t.add_argument("--category", action="append", default=[])
    t.add_argument("--top", type=int)
    t.add_argument("--load-state")
    t.add_argument("--save-state")
    t.add_argument("--json", action="store_true")
    t.add_argument("--per-node")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 on success; else 1, with `<command>: <error>` on stderr."""
    args = _parser().parse_args(argv)
    try:
        spark = spark or session()
        if args.command == "merge":
            report = merge(spark, args.input_dir, args.output_dir, level=args.level, days_at_once=args.days, before=args.before, check=args.check, jobs=args.jobs)
            if args.before and not report.days and not report.files:
                print(f"merge: nothing dated before {args.before}")
            if args.check and report.files:
                print("merge --check: " + ("each day was written, read again and split" if args.output_dir else "the merged lines were split, nothing was written"))
                rows = spark.createDataFrame(report.files, "date string, node string, ok boolean, lines bigint")
                for line in check_lines(rows):
                    print(line)
            if not report.ok:
                raise ValueError("some files do not round-trip")
        elif args.command == "split":
            split(spark, args.input, args.output_dir)
        elif args.per_node:
            if args.load_state or args.save_state:
                raise ValueError("--per-node can't be combined with --load-state or --save-state")
            if not args.input:
                raise ValueError("--per-node needs an input")
            per_node(spark, args.input, args.per_node, depth=args.depth, threshold=args.threshold, min_count=args.min_count, categories=args.category, top=args.top, json=args.json)
        else:
            report = templates(
                spark, args.input, depth=args.depth, threshold=args.threshold, min_count=args.min_count, categories=args.category, top=args.top, load_state=args.load_state, save_state=args.save_state
            )
            for line in printed(report, args.json):
                print(line)
    except Exception as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
