"""Detection on streams (an extension): the same expressions, which keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.detect import findings


def stream_findings(source: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Findings of a streaming table; caps hold for each row, as in a batch."""
    return findings(source, keys, text).drop("value")


def windowed_counts(source: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings by rule in windows of event time; rows later than the watermark are left out."""
    found = findings(source.withWatermark(time, late), [time], text)
    return found.groupBy(F.window(time, width), "rule_id").agg(F.count("*").alias("n"))
