"""Commands: link and validate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.validate import validate
from ..sources.records import Settings
from .pipeline import run_pipeline


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kindred")
    commands = parser.add_subparsers(dest="command", required=True)
    link = commands.add_parser("link", help="train, link the test split and write the lists")
    link.add_argument("--data-dir", default="dataset")
    link.add_argument("--out-dir", default="output")
    link.add_argument("--threshold", type=float, help="holds as given; without it the threshold is tuned")
    link.add_argument("--max-candidates", type=int, default=Settings.max_candidates)
    link.add_argument("--backend", choices=("gbt", "logreg", "weights"), default="gbt")
    link.add_argument("--train-only", action="store_true")
    check = commands.add_parser("validate", help="check a submission; exit 1 if it has errors")
    check.add_argument("--matching", required=True)
    check.add_argument("--candidate", required=True)
    check.add_argument("--test-dir", required=True)
    check.add_argument("--check-ids", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    if args.command == "link":
        settings = Settings(threshold=args.threshold if args.threshold is not None else Settings.threshold, max_candidates=args.max_candidates)
        print(run_pipeline(spark, args.data_dir, args.out_dir, args.train_only, settings, args.backend, tune=args.threshold is None))
        return 0
    found = validate(spark, args.matching, args.candidate, args.test_dir, args.check_ids)
    for path, n in found.counts.items():
        print(f"{path}: {n['rows']} rows, {n['empty']} empty, {n['filled']} filled")
    for kind, rows in (("warning", found.warnings), ("error", found.errors)):
        for check_id, message in rows:
            print(f"{kind} {check_id}: {message}")
    print("PASS" if found.ok else "FAIL")
    return int(not found.ok)


if __name__ == "__main__":
    raise SystemExit(main())
