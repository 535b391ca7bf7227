"""Profiles of token counts, and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0]


def percentiles(df: DataFrame, value: str, points: list[float] = POINTS, exact: bool = True) -> DataFrame:
    """One row: n, least, most and an exact (or, for very large data, approximate) percentile for each point."""
    each = F.percentile(value, F.array(*map(F.lit, points))) if exact else F.percentile_approx(value, F.array(*map(F.lit, points)), 10_000)
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), each.alias("p"))
    return out.select("n", "least", "most", *(F.round(F.get("p", F.lit(k)).cast("double"), 6).alias(f"p{round(100 * x)}") for k, x in enumerate(points)))


def longest(df: DataFrame, value: str, order: str) -> DataFrame:
    """The first of the longest rows."""
    return df.agg(F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(F.col(value), -F.col(order))).alias("r")).select("r.*")


def split_by_limit(df: DataFrame, value: str, limit: int = 8192) -> DataFrame:
    """Add `verdict`: kept, or long."""
    return df.withColumn("verdict", F.when(F.coalesce(F.col(value), F.lit(0)) <= limit, "kept").otherwise("long"))


def counters(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
