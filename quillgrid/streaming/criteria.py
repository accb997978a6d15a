"""Criteria aggregates kept up to date on a stream: an extension, since formulas know no streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_ifs(stream: DataFrame, time: str, width: str, by: list[str], late: str, **aggregates: Column) -> DataFrame:
    """SUMIFS and the like by key and tumbling window; rows later than ``late`` are dropped by the watermark, so state is
    bounded.  Works on a batch DataFrame too, with the same result.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    marked = timed.withWatermark(time, late) if stream.isStreaming else timed
    grouped = marked.groupBy(F.window(time, width).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("w.start").alias("window_start"), *by, *aggregates)
