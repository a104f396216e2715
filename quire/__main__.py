"""python -m quire build INPUT OUTPUT: one package; python -m quire batch INPUT OUTPUT: a package for each folder below INPUT.

Exit code 0: all checks passed; 1: some failed; 2: the input was refused.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from quire.config import Config, from_toml
from quire.plans.run import build_folder, written
from quire.sources.inventory import InputTooLarge, NotEnoughSpace


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("build", "batch"):
        one = commands.add_parser(name)
        one.add_argument("input")
        one.add_argument("output", help="must not exist")
        one.add_argument("--config", help="a TOML file")
        one.add_argument("--max-pages", type=int)
        one.add_argument("--max-mb", type=int)
        one.add_argument("--exact-only", action="store_true", help="leave out content, containment and families")
        one.add_argument("--allow-large-input", action="store_true")
        if name == "build":
            one.add_argument("--package", default="package", help="the package's id")
    return top


def settings(args: argparse.Namespace) -> Config:
    config = Config()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            config = from_toml(f.read())
    given = {"max_pages_per_part": args.max_pages, "max_size_mb_per_part": args.max_mb, "content_aware": False if args.exact_only else None}
    return replace(config, **{k: v for k, v in given.items() if v is not None})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    try:
        run = build_folder(spark, args.input, settings(args), getattr(args, "package", None), args.allow_large_input)
    except (InputTooLarge, NotEnoughSpace) as refused:
        print(refused, file=sys.stderr)
        return 2
    paths = written(run, args.output)
    return 1 if spark.read.parquet(paths["summary"]).filter("not success").head(1) else 0


if __name__ == "__main__":
    sys.exit(main())
