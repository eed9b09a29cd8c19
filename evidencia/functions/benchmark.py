"""Pay benchmarks: the exact median of comparable pays, and what lies far above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: an outlier is above so many medians, given so many pays
FACTOR, LEAST = 2.0, 3


def benchmark(df: DataFrame, keys: list[str], pay: str) -> DataFrame:
    """(keys, listings, found, median_pay): null pays count as listings, not as pays; null keys are a group.

    The median is exact: Spark keeps counts of distinct values per group, so repeated pays of a hot group stay small.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("listings"), F.count(pay).alias("found"), F.median(pay).alias("median_pay"))


def coverage(found: Column, listings: Column) -> Column:
    return F.format_string("pay found in %d of %d listings", found, listings)


def is_outlier(pay: Column, found: Column, median: Column) -> Column:
    return (found >= LEAST) & (pay > FACTOR * median)
