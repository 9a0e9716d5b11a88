"""The dedup and burst operators on streams: an extension, as the batch plans need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicate(transfers: DataFrame, within: str = "1 minute") -> DataFrame:
    """Drop a transfer when one with the same ends and cents arrived within the watermark's delay.

    ``transfers``: src, dst, amount, ts (a timestamp with zone, as watermarks need one).
    """
    keyed = transfers.withColumn("cents", F.abs("amount").cast("decimal(18,2)")).withWatermark("ts", within)
    return keyed.dropDuplicatesWithinWatermark(["src", "dst", "cents"]).drop("cents")


def bursts(rows: DataFrame, node: str, window: str = "60 minutes", slide: str = "10 minutes", late: str = "1 hour", least: int = 4) -> DataFrame:
    """Sliding windows in which a node has at least ``least`` rows."""
    w = F.window("ts", window, slide)
    return rows.withWatermark("ts", late).groupBy(w, F.col(node).alias("node")).agg(F.count("*").alias("burst")).filter(F.col("burst") >= least)


def sessions(rows: DataFrame, node: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a node, ended by a pause."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), F.col(node).alias("node")).agg(F.count("*").alias("rows"))
