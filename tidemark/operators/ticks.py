"""Bars, VWAP, TWAP, order flow and their summary.

`keys` are columns that part a table into sessions; none means that the table is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_of, r8, require, safe_div

#: Ticks are averaged over time within stretches of this length, then stitched: no task gets a whole session.
STRETCH_NS = 3_600_000_000_000


def bars(ticks: DataFrame, bucket_ns: int, keys: list[str] = []) -> DataFrame:
    """Open, high, low, close, volume and VWAP of each time bucket that has ticks; one shuffle of partial aggregates."""
    if bucket_ns < 1:
        raise ValueError("bucket_ns must be >= 1")
    order = F.struct("ts_ns", "trade_id")
    out = ticks.groupBy(*keys, bucket_of("ts_ns", bucket_ns).alias("bucket_ns")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("pv"),
    )
    return out.select(*keys, "bucket_ns", "open", "high", "low", "close", "volume", safe_div("pv", "volume").alias("vwap"))


def session_vwap(ticks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Size-weighted mean price; an empty table is an error, as is a session of no size (null vwap with keys)."""
    if not keys:
        row = ticks.agg(F.count(F.lit(1)), F.sum("size")).first()
        if not row[0]:
            raise ValueError("no ticks")
        if not row[1]:
            raise ValueError("zero total size")
    sums = ticks.groupBy(*keys).agg(F.sum(F.col("price") * F.col("size")).alias("pv"), F.sum("size").alias("v"))
    return sums.select(*keys, r8(safe_div("pv", "v")).alias("vwap"))


def _elapsed(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, num, den: sums of price times time to the next tick, and of that time."""
    inner = Window.partitionBy(*keys, "stretch").orderBy("ts_ns", "trade_id")
    order = F.struct("ts_ns", "trade_id")
    rows = ticks.withColumn("stretch", bucket_of("ts_ns", STRETCH_NS)).withColumn("dt", (F.lead("ts_ns").over(inner) - F.col("ts_ns")).cast("double"))
    parts = rows.groupBy(*keys, "stretch").agg(
        F.sum(F.col("price") * F.col("dt")).alias("num"), F.sum("dt").alias("den"), F.count(F.lit(1)).alias("n"),
        F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.max_by("price", order).alias("last_price"),
    )
    outer = Window.partitionBy(*keys).orderBy("stretch")
    gap = (F.lead("first_ts").over(outer) - F.col("last_ts")).cast("double")
    parts = parts.withColumn("gap", gap)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return parts.groupBy(*keys).agg(
        F.sum(zero(F.col("num")) + zero(F.col("last_price") * F.col("gap"))).alias("num"), F.sum(zero(F.col("den")) + zero(F.col("gap"))).alias("den"), F.sum("n").alias("n")
    )


def session_twap(ticks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Mean price by time in force; the last tick has no weight.  Fewer than two ticks, or no time between, is an error (null with keys)."""
    out = _elapsed(ticks, keys)
    if not keys:
        row = out.first()
        if (row["n"] or 0) < 2:
            raise ValueError("need >= 2 ticks for twap")
        if not row["den"]:
            raise ValueError("zero elapsed time")
    return out.select(*keys, r8(safe_div("num", "den")).alias("twap"))


def order_flow(ticks: DataFrame, keys: list[str] = []) -> DataFrame:
    """Bought and sold size, and (b - s) / (b + s), 0 where nothing traded."""
    if not keys:
        require(ticks.limit(1).groupBy().count(), {"no ticks": F.col("count") == 0})
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0.0))
    sums = ticks.groupBy(*keys).agg(side("buy").alias("b"), side("sell").alias("s"))
    balance = F.coalesce(safe_div(F.col("b") - F.col("s"), F.col("b") + F.col("s")), F.lit(0.0))
    return sums.select(*keys, r8("b").alias("buy_volume"), r8("s").alias("sell_volume"), r8(balance).alias("imbalance"))


def summary(ticks: DataFrame, bucket_ns: int, keys: list[str] = []) -> DataFrame:
    """One row per session: ticks, vwap, twap, order flow, and its bars as an array in time order.  Everything but the TWAP comes from one aggregate by bar."""
    if bucket_ns < 1:
        raise ValueError("bucket_ns must be >= 1")
    if not keys:
        session_vwap(ticks)  # refusals
    order = F.struct("ts_ns", "trade_id")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0)).alias(s)
    made = ticks.groupBy(*keys, bucket_of("ts_ns", bucket_ns).alias("bucket_ns")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
        F.sum(F.col("price") * F.col("size")).alias("pv"), F.count(F.lit(1)).alias("n"), side("buy"), side("sell"), F.min_by("product", order).alias("product"),
    )
    bar = F.struct("bucket_ns", *[r8(c).alias(c) for c in ("open", "high", "low", "close", "volume")], r8(safe_div("pv", "volume")).alias("vwap"))
    out = made.groupBy(*keys).agg(
        F.min_by("product", "bucket_ns").alias("product"), F.sum("n").alias("ticks"), r8(safe_div(F.sum("pv"), F.sum("volume"))).alias("vwap"), F.sum("buy").alias("b"), F.sum("sell").alias("s"),
        F.array_sort(F.collect_list(bar)).alias("bars"),
    )
    mean = session_twap(ticks, keys)
    out = out.join(mean, keys) if keys else out.crossJoin(mean)
    balance = F.coalesce(safe_div(F.col("b") - F.col("s"), F.col("b") + F.col("s")), F.lit(0.0))
    return out.select(*keys, "product", F.lit(bucket_ns).cast("long").alias("bucket_ns"), "ticks", "vwap", "twap", r8("b").alias("buy_volume"), r8("s").alias("sell_volume"), r8(balance).alias("imbalance"), "bars")


def profile(ticks: DataFrame, bucket_ns: int, keys: list[str]) -> DataFrame:
    """keys, slot (0 at the session's first traded bucket), bucket_ns, volume, vwap, share, total, slots."""
    made = bars(ticks, bucket_ns, keys).select(*keys, "bucket_ns", "volume", "vwap")
    w = Window.partitionBy(*keys)
    slot = F.expr(f"(bucket_ns - first) div {bucket_ns}")
    made = made.withColumn("first", F.min("bucket_ns").over(w)).withColumn("total", F.sum("volume").over(w)).withColumn("slots", F.count(F.lit(1)).over(w))
    return made.select(*keys, slot.alias("slot"), "bucket_ns", "volume", "vwap", safe_div("volume", "total").alias("share"), "total", "slots")
