"""Scans of streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.config import Config
from sieveline.plans.scan import scan


def each_batch(config: Config, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a file is a row, so the scan of a batch is the scan of its files."""

    def run(batch: DataFrame, n: int) -> None:
        sink(scan(batch.select("file_path", "content"), config).withColumn("batch", F.lit(n)), n)

    return run


def first_seen(findings: DataFrame, delay: str = "7 days", time: str = "found_at") -> DataFrame:
    """Of findings on a stream those whose token was not seen before, within the time that late ones may take."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["token"])


def by_severity(findings: DataFrame, every: str = "1 hour", delay: str = "1 hour", time: str = "found_at") -> DataFrame:
    """Findings by severity in tumbling windows; late ones count up to the delay."""
    return findings.withWatermark(time, delay).groupBy(F.window(time, every), "severity").agg(F.count(F.lit(1)).alias("n"))
