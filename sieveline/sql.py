"""The scanner in SQL: a view of the signatures and functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sieveline.config import Config
from sieveline.operators import match


def register(spark: SparkSession, config: Config = Config()) -> None:  # noqa: B008
    """The view signatures, and SQL functions of native expressions: no Python runs for them."""
    match.table(spark, config.all_signatures()).createOrReplaceTempView("signatures")
    stars = "repeat('*', {})"
    bodies = {
        "mask_token(t STRING)": ("STRING", f"CASE WHEN length(t) <= 10 THEN {stars.format('length(t)')} ELSE concat(substr(t, 1, 6), {stars.format('length(t) - 10')}, right(t, 4)) END"),
        "shannon(t STRING)": ("DOUBLE", "CASE WHEN length(t) > 0 THEN aggregate(transform(array_distinct(filter(split(t, ''), c -> c != '')), c -> (length(t) - length(replace(t, c, ''))) / length(t)), 0D, (a, p) -> a - p * log2(p)) ELSE 0D END"),
        "severity_weight(s STRING)": ("INT", "CASE upper(s) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"),
        "entropy_severity(e DOUBLE)": ("STRING", "CASE WHEN e >= 7 THEN 'CRITICAL' WHEN e >= 6 THEN 'HIGH' WHEN e >= 5 THEN 'MEDIUM' ELSE 'LOW' END"),
    }
    for head, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
