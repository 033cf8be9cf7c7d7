"""Scores of readings against expected values, and of latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(hits: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * hits / total).otherwise(0.0)


def score_by_field(df: DataFrame, keys: list[str], raw: str, corrected: str, expected: str, valid: str) -> DataFrame:
    """keys, total, raw_hits, corrected_hits, valid, corrected_rate."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(raw) == F.col(expected)).alias("raw_hits"),
        F.count_if(F.col(corrected) == F.col(expected)).alias("corrected_hits"),
        F.count_if(F.col(valid)).alias("valid"),
    )
    return out.withColumn("corrected_rate", percent(F.col("corrected_hits"), F.col("total")))


def latencies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, p50 (interpolated), p95 (the value at place floor(0.95 n), the last at most).

    Values are counted before they are ordered, and p95 is found from running counts, so no group is collected whole.
    """
    from pyspark.sql import Window

    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("p50"), at(place).alias("p95"))


def segmentation_score(df: DataFrame, keys: list[str], expected: str, found: str, side: str, side_found: str) -> DataFrame:
    """keys, pages, side_hits, exact, within_two, mean_error of row counts."""
    error = F.abs(F.col(found) - F.col(expected))
    return df.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col(side) == F.col(side_found)).alias("side_hits"),
        F.count_if(error == 0).alias("exact"),
        F.count_if(error <= 2).alias("within_two"),
        F.avg(error).alias("mean_error"),
    )
