"""Checks that need no other rows, on a stream.

The masks of these checks are plain column expressions, so they run on a streaming DataFrame unchanged;
counts per window and check come from a watermarked aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.operators.checks import Facts, mask_of
from cleargrain.operators.profile import ColumnProfile

STATELESS = ("missing_values", "blank_strings", "whitespace", "unicode_issues", "invalid_email", "invalid_phone", "invalid_url", "invalid_date", "negative_values")


def flag_stream(stream: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """The stream with failed_checks, an array of check:column. checks: pairs (key, column) of STATELESS keys."""
    facts = Facts([ColumnProfile(f.name, k, f.dataType.simpleString(), "text", 0, 0.0, 0, 0.0) for k, f in enumerate(stream.schema.fields)])
    bad = [k for k, _ in checks if k not in STATELESS]
    if bad:
        raise ValueError(f"not stateless: {', '.join(bad)}")
    marks = [F.when(mask_of(stream, facts, k, c), F.lit(f"{k}:{c}")) for k, c in checks]
    return stream.withColumn("failed_checks", F.array_compact(F.array(*marks)))


def finding_counts(flagged: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """window_start, finding, n: findings per window of event time, late rows beyond the delay left out."""
    found = flagged.withWatermark(time, delay).select(time, F.explode("failed_checks").alias("finding"))
    counts = found.groupBy(F.window(time, window), "finding").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "finding", "n")
