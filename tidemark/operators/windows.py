"""Windows that slide over time, and bursts of trades between gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_of, safe_div

#: Gaps are looked for within stretches of this length; from stretch to stretch only the last time and the number of bursts are carried.
STRETCH_NS = 3_600_000_000_000


def rolling_vwap(ticks: DataFrame, width_ns: int, slide_ns: int, keys: list[str] = []) -> DataFrame:
    """keys, start_ns, trades, volume, vwap of the windows of width_ns that begin at each multiple of slide_ns and hold a tick.

    Ticks are summed by steps of slide_ns first; a window adds up its steps.
    """
    if slide_ns < 1 or width_ns < slide_ns or width_ns % slide_ns:
        raise ValueError("width_ns must be a multiple of slide_ns")
    steps = ticks.groupBy(*keys, bucket_of("ts_ns", slide_ns).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("v"), F.sum(F.col("price") * F.col("size")).alias("pv"))
    starts = F.explode(F.sequence(F.col("step") - (width_ns - slide_ns), "step", F.lit(slide_ns).cast("long")))
    out = steps.select(*keys, starts.alias("start_ns"), "n", "v", "pv").groupBy(*keys, "start_ns").agg(F.sum("n").alias("trades"), F.sum("v").alias("volume"), F.sum("pv").alias("pv"))
    return out.select(*keys, "start_ns", "trades", "volume", safe_div("pv", "volume").alias("vwap"))


def trade_bursts(ticks: DataFrame, gap_ns: int, keys: list[str] = []) -> DataFrame:
    """keys, start_ns, last_ns, trades, volume, vwap of each run of ticks that follow one another within less than gap_ns.

    Runs are numbered within stretches of time, and go on from one stretch to the next, so a busy key is many tasks.
    """
    if gap_ns < 1:
        raise ValueError("gap_ns must be >= 1")
    rows = ticks.select(*keys, "ts_ns", "price", "size", bucket_of("ts_ns", STRETCH_NS).alias("stretch"))
    inside = Window.partitionBy(*keys, "stretch").orderBy("ts_ns")
    rows = rows.withColumn("gap", F.col("ts_ns") - F.lag("ts_ns").over(inside))
    ends = rows.groupBy(*keys, "stretch").agg(F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"), F.count(F.when(F.col("gap") >= gap_ns, 1)).alias("begun"))
    w = Window.partitionBy(*keys).orderBy("stretch")  # a row per stretch
    opens = F.coalesce(F.col("first") - F.lag("last").over(w) >= gap_ns, F.lit(True)).cast("long")
    ends = ends.withColumn("opens", opens).withColumn("bursts", F.sum(F.col("begun") + F.col("opens")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.col("bursts") - F.col("begun") + F.count(F.when(F.col("gap") >= gap_ns, 1)).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    met = rows.join(ends.select(*keys, "stretch", "bursts", "begun"), [*keys, "stretch"]).withColumn("burst", number)
    out = met.groupBy(*keys, "burst").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("last_ns"), F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("pv"))
    return out.select(*keys, "start_ns", "last_ns", "trades", "volume", safe_div("pv", "volume").alias("vwap"))
