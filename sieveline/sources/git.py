"""Texts that git prints, to tables: listings of staged files, diffs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """status and path of `git diff --name-status` lines; of a rename the new path. Lines without a tab are left out."""
    parts = F.split(F.col(line), "\t", 3)
    return lines.where(F.size(parts) > 1).select(F.get(parts, 0).alias("status"), F.element_at(parts, -1).alias("path"))


def is_added(line: Column) -> Column:
    return F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))


def added(line: Column) -> Column:
    """The text that a line of a diff adds, or null."""
    return F.when(is_added(line), line.substr(F.lit(2), F.length(line)))


def chunks(lines: DataFrame, most: int, log: str = "log", at: str = "pos", line: str = "line") -> DataFrame:
    """file_path (commit:path), commit, path and content, the added lines, of each file of each commit of logs.

    lines: one row for each line of `git log -p`, numbered within its log; the logs are processed independently, so a history
    is best read as many. Files of more than `most` added bytes are left out. Line numbers in findings are those of the chunk.
    """
    order = W.partitionBy(log).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    x = F.col(line)
    commit = F.when(F.startswith(x, F.lit("commit ")), F.substring(x, 8, 7))
    path = F.when(F.startswith(x, F.lit("+++ b/")), x.substr(F.lit(7), F.length(x)))
    starts = F.startswith(x, F.lit("diff --git")) | F.startswith(x, F.lit("commit "))
    rows = lines.select(log, at, added(x).alias("text"), F.last(commit, True).over(order).alias("commit"), F.last(path, True).over(order).alias("path"), F.sum(starts.cast("int")).over(order).alias("part"))
    rows = rows.where("text is not null and path is not null")
    out = rows.groupBy(log, "part", "commit", "path").agg(F.sum(F.octet_length("text") + 1).alias("size"), F.array_sort(F.collect_list(F.struct(at, "text"))).alias("all"))
    content = F.concat(F.array_join(F.transform("all", lambda r: r["text"]), "\n"), F.lit("\n"))
    return out.where(F.col("size") <= most).select(F.concat_ws(":", "commit", "path").alias("file_path"), "commit", "path", content.alias("content"))


def log_lines(logs: DataFrame, log: str = "file_path", content: str = "content") -> DataFrame:
    """Rows of read_files(kind="history") to numbered lines."""
    return logs.select(F.col(log).alias("log"), F.posexplode(F.split(content, "\n")).alias("pos", "line"))
