"""Rates and streaks over a stream of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import monitor


def windowed_rates(probes: DataFrame, moment: str = "ts", site: str = "site", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(site, window, link_num, rate, status) of a stream of probes (site, ts, alive), by tumbling windows; later arrivals than ``late`` are dropped.

    The same expression serves a batch: without a stream the watermark has no effect.
    """
    x = probes.withWatermark(moment, late).groupBy(F.col(site).alias("site"), F.window(moment, window).alias("window"))
    x = x.agg(F.count(F.lit(1)).alias("link_num"), F.bround(F.avg(F.col("alive").cast("int")), 4).alias("rate"))
    return x.withColumn("status", monitor.verdict(F.col("rate")))
