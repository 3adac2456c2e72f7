"""Composition of a stream of texts: the same expressions, with a watermark where windows need one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import composition


def running(docs: DataFrame) -> DataFrame:
    """(species, n, gc): running means over all texts so far; for update or complete output."""
    m = composition.metrics(composition.sequences(docs))
    return m.groupBy("species").agg(F.count("*").alias("n"), F.avg("gc").alias("gc"))


def windowed(events: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, by, n, mean) of events; state of a window goes when the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
