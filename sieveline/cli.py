"""python -m sieveline.cli scan PATH... | staged [REPOSITORY] | history [REPOSITORY]; exit status 1 if anything is found."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions import paths
from sieveline.operators import report, resolve
from sieveline.plans import scan as plan
from sieveline.sources import git
from sieveline.sources.files import read_files


def findings_of(spark: SparkSession, args, config: C.Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned files, findings, and files left out."""
    if args.command == "history":
        files = git.chunks(git.log_lines(read_files(spark, args.paths[0], "history")), config.max_file_size_bytes)
        # rules on paths hold for the path, findings show the commit too
        kept = plan.prune(files, config, path="path").select("file_path", "path", "content")
        out = files.select("file_path").limit(0).selectExpr("file_path", "'' AS reason")
    else:
        every = read_files(spark, os.pathsep.join(args.paths), "staged" if args.command == "staged" else "folder", recursive=str(args.recursive), max_file_size_bytes=str(config.max_file_size_bytes))
        if args.command == "scan" and len(args.paths) == 1 and os.path.isdir(args.paths[0]):
            every = every.withColumn("file_path", paths.relative(F.col("file_path"), F.lit(args.paths[0])))  # what is above the folder says nothing of a file
        kept = plan.prune(every.where("content is not null"), config)
        out = every.where("skipped is not null").selectExpr("file_path", "skipped AS reason").unionByName(plan.skipped(every.where("content is not null"), config))
    found = plan.scan(kept.select("file_path", "content"), config, pruned=True)
    if args.command != "staged":
        found = resolve.first_seen(found)
    return kept, plan.stop_at_first(found) if config.fail_fast else found, out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["scan", "staged", "history"])
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("--config")
    p.add_argument("--format", default="pretty")
    p.add_argument("--output", help="write the report to a file and show a pretty one")
    p.add_argument("--no-recursive", dest="recursive", action="store_false")
    p.add_argument("--fail-fast", action="store_true")
    p.add_argument("--show-secrets", action="store_true")
    args = p.parse_args(argv)
    options = C.load(args.config)
    if args.fail_fast:
        options = C.from_mapping({"fail_fast": True}, options)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    began = time.time()
    files, found, out = findings_of(spark, args, options)
    found = found.persist()
    n, some = files.count(), found.count()
    took = int((time.time() - began) * 1000)
    makers = {
        "json": lambda: report.json_report(found, n, took, not args.show_secrets),
        "sarif": lambda: report.sarif_report(found),
        "plain": lambda: report.text_report(found, n, took),
        "pretty": lambda: report.text_report(found, n, took, True, out),
    }
    text = makers[report.parse_format(args.format)]()
    if args.output:
        with open(args.output, "w") as f:
            f.write(text + "\n")
        text = makers["pretty"]()
    print(text)
    return 1 if some else 0


if __name__ == "__main__":
    sys.exit(main())
