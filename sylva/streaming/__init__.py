"""Streams: dictionary annotation and windowed counts of arriving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.matching import phrase_hits


def annotate(stream: DataFrame, key: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """Phrase hits of each arriving text: a stateless join of the stream with the static dictionary."""
    return phrase_hits(stream, key, text, phrases)


def windowed_counts(stream: DataFrame, time: str, by: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows per ``by`` and time window, closed when the watermark passes."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), by, "n")


def first_arrivals(stream: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
