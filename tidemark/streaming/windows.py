"""Windows of a stream by event time, with a watermark: tumbling, sliding, and bursts between gaps.  Times are of microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import safe_div


def _timed(ticks: DataFrame, late: str) -> DataFrame:
    return ticks.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", late)


def windowed_bars(ticks: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """product, start_ns, open, high, low, close, trades, volume, vwap of each window; with `slide` windows overlap.  A tick more than `late` behind the newest
    is dropped; a window is final when the watermark has passed its end (append mode), and is told as it grows in update mode."""
    order = F.struct("ts_ns", "trade_id")
    out = _timed(ticks, late).groupBy("product", F.window("at", width, slide or width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("trades"),
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("pv"),
    )
    return out.select("product", (F.unix_micros("w.start") * 1000).alias("start_ns"), "open", "high", "low", "close", "trades", "volume", safe_div("pv", "volume").alias("vwap"))


def trade_bursts(ticks: DataFrame, gap_ns: int, late: str = "10 minutes") -> DataFrame:
    """product, start_ns, last_ns, trades, volume, vwap of each run of ticks that follow one another within less than gap_ns, in append mode, once the
    watermark has passed its end."""
    if gap_ns < 2000 or gap_ns % 1000:
        raise ValueError("gap_ns must be whole microseconds, two or more")
    # Spark joins what is just the gap apart
    out = _timed(ticks, late).groupBy("product", F.session_window("at", f"{gap_ns // 1000 - 1} microseconds").alias("w")).agg(
        F.max("ts_ns").alias("last_ns"), F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("pv")
    )
    return out.select("product", (F.unix_micros("w.start") * 1000).alias("start_ns"), "last_ns", "trades", "volume", safe_div("pv", "volume").alias("vwap"))
