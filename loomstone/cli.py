"""Command line: index a repository and ask its history."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import extractions as X
from .operators import metrics as M
from .operators.filters import Filters
from .sinks.render import FORMATS, default_format, export, show
from .sources import git, warehouse


def session(memory: str | None = None) -> SparkSession:
    """A session whose driver (and, on one machine, all tasks) keeps to `memory`; larger inputs spill."""
    builder = SparkSession.builder.appName("loomstone").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    spark = (builder.config("spark.driver.memory", memory) if memory else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomstone")
    top.add_argument("--repo", default=".")
    top.add_argument("--warehouse", help="folder of the tables (by default one per repository)")
    top.add_argument("--bucket", help="commit, day, week, month or tag; taken when indexing")
    top.add_argument("--memory", help="the session's memory, as in 2g")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *, filtered: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        sub.add_argument("--format", choices=FORMATS)
        if filtered:
            for flag in ("--from", "--to", "--author", "--path", "--lang"):
                sub.add_argument(flag, dest=flag[2:].replace("from", "since").replace("to", "until") if flag in ("--from", "--to") else flag[2:])
        return sub

    command("index", filtered=False)
    command("reindex", filtered=False)
    command("export", filtered=False).add_argument("--out", required=True)
    commands.choices["export"].add_argument("--as", dest="kind", choices=("parquet", "csv", "json"), default="parquet")
    command("sql", filtered=False).add_argument("query")
    command("classify")
    command("age").add_argument("--as-of", type=int, help="unix seconds (default: now)")
    command("churn").add_argument("--by", default="module")
    commands.choices["churn"].add_argument("--depth", type=int, default=1)
    command("burndown").add_argument("--by", default="language")
    command("coupling").add_argument("--top", type=int, default=50)
    commands.choices["coupling"].add_argument("--max-files-per-commit", type=int, default=50)
    command("hotspot").add_argument("--top", type=int, default=30)
    command("cohort")
    command("survival").add_argument("--fit", type=str.lower, choices=("exp",))
    command("summary", filtered=False)
    command("authors", filtered=False)
    return top


def ask(args: argparse.Namespace, views: dict[str, DataFrame]) -> DataFrame:
    """The metric that the arguments name."""
    picked = {k: getattr(args, k, None) for k in ("since", "until", "author", "path")}
    filters = Filters(**picked, languages=getattr(args, "lang", None))
    now = int(time.time())
    return {
        "classify": lambda: M.classify(views, filters),
        "age": lambda: M.age(views, args.as_of or now, filters),
        "churn": lambda: M.churn(views, args.by, args.depth, filters),
        "burndown": lambda: M.burndown(views, args.by, filters),
        "coupling": lambda: M.coupling(views, args.top, args.max_files_per_commit, filters),
        "hotspot": lambda: M.hotspot(views, args.lang or "", args.top, filters),
        "cohort": lambda: M.cohort(views, filters),
        "survival": lambda: M.survival_fit(views, filters) if args.fit else M.survival(views, filters),
        "summary": lambda: X.summary(views),
        "authors": lambda: X.author_tenure(views, now),
    }[args.command]()


def bring_up_to_date(spark: SparkSession, repo: str, folder: str, bucket: str | None, anew: bool) -> None:
    """Index what the tables at `folder` lack, or all of it where there are none, where that won't do, and where `anew` asks for it."""
    if os.path.isdir(f"{folder}/commits") and not anew:
        known = warehouse.load(spark, folder)
        if git.can_update(spark, repo, known, bucket):
            warehouse.update(*git.index(spark, repo, bucket, known=known), folder)
            return
    warehouse.save(git.index(spark, repo, bucket)[0], folder)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        repo = git.open_repository(args.repo)
        if git.is_shallow(repo):
            print("warning: a shallow clone has only part of the history", file=sys.stderr)
        folder = args.warehouse or warehouse.warehouse_path(repo)
        spark = spark or session(args.memory)
        if args.command in ("index", "reindex") or not os.path.isdir(f"{folder}/commits"):
            bring_up_to_date(spark, repo, folder, args.bucket, args.command == "reindex")
        if args.command in ("index", "reindex"):
            return 0
        views = warehouse.load(spark, folder)
        if args.command == "export":
            export(views, args.out, args.kind)
            return 0
        if args.command == "sql":
            warehouse.register(views)
            found = spark.sql(args.query)
        else:
            found = ask(args, views)
        for line in show(found, default_format(args.format)):
            print(line)
        return 0
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
