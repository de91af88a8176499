"""Counts over event streams: the sums behind detection and size factors kept up to date, late events within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, gene_id, n, total) by window and kind of event; works on a stream and on a table."""
    ev = events.withWatermark("ts", late) if events.isStreaming else events
    g = ev.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("gene_id"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "gene_id", "n", "total")
