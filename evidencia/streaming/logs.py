"""Audit logs as streams: windows with late data, and copies seen again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, at: str) -> DataFrame:
    """A stream's event time must be a point in time; a table keeps its type."""
    return rows.withColumn(at, F.col(at).cast("timestamp")) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n): events per tumbling window; later events than ``late`` are dropped by the watermark.

    Works on a stream and, where the watermark has no effect, on a table.
    """
    return _timed(events, at).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def without_copies(rows: DataFrame, at: str, print_: str, within: str = "1 day") -> DataFrame:
    """A stream without rows whose fingerprint was seen ``within`` that time; the state is dropped behind the watermark."""
    return _timed(rows, at).withWatermark(at, within).dropDuplicatesWithinWatermark([print_])


def settled(calls: DataFrame, results: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Calls of an append-only log with the last result that came for each; null columns while none has."""
    last = results.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(at)).alias("_r"))
    return calls.join(last, key, "left").select(calls["*"], *[F.col("_r")[c].alias(c) for c in columns])
