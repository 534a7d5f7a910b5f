"""Seeded synthetic captures: the same properties each time, made by executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_NS = 1_719_792_000_000_000_000


def _clock(spark: SparkSession, n: int, seed: int, start_ns: int) -> DataFrame:
    """n rows in one partition (a walk is sequential): id, ts_ns 0.05 to 0.6 s apart, and a price walk of steps within 15."""
    rows = spark.range(0, n, 1, 1).withColumn("dt", F.lit(50_000_000) + (F.rand(seed) * 550_000_000).cast("long"))
    past = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("step", F.rand(seed + 1) * 30 - 15)
    return rows.select("id", (F.lit(start_ns) + F.sum("dt").over(past)).alias("ts_ns"), F.greatest(F.lit(1.0), 60000 + F.sum("step").over(past)).alias("mid"))


def synthetic_ticks(spark: SparkSession, n: int = 200, seed: int = 7, product: str = "BTC-USD", start_ns: int = START_NS) -> DataFrame:
    rows = _clock(spark, n, seed, start_ns)
    return rows.select(
        "ts_ns", F.lit(product).alias("product"), F.round("mid", 2).alias("price"), F.round(0.01 + F.rand(seed + 2) * 0.49, 8).alias("size"),
        F.when(F.rand(seed + 3) < 0.5, "buy").otherwise("sell").alias("side"), (F.col("id") + 1).alias("trade_id"),
    )


def synthetic_quotes(spark: SparkSession, n: int = 200, seed: int = 7, product: str = "BTC-USD", start_ns: int = START_NS) -> DataFrame:
    rows = _clock(spark, n, seed, start_ns).withColumn("half", 0.25 + F.rand(seed + 2))
    return rows.select(
        "ts_ns", F.lit(product).alias("product"), F.round(F.col("mid") - F.col("half"), 2).alias("bid"), F.round(0.01 + F.rand(seed + 3), 8).alias("bid_size"),
        F.round(F.col("mid") + F.col("half"), 2).alias("ask"), F.round(0.01 + F.rand(seed + 4), 8).alias("ask_size"),
    )


def synthetic_book(spark: SparkSession, n: int = 100, levels: int = 5, seed: int = 7, product: str = "BTC-USD", start_ns: int = START_NS) -> DataFrame:
    rows = _clock(spark, n, seed, start_ns).withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(levels - 1).cast("long"))))
    rows = rows.withColumn("side", F.explode(F.array(F.lit("bid"), F.lit("ask"))))
    sign = F.when(F.col("side") == "bid", -1).otherwise(1)
    return rows.select("ts_ns", F.lit(product).alias("product"), "side", "level", F.round(F.col("mid") + sign * 0.5 * (F.col("level") + 1), 2).alias("price"), F.round(0.05 + F.rand(seed + 2), 8).alias("size"))


def synthetic_calibration(
    spark: SparkSession, n: int = 200, coef_bps: float = 10.0, perm_coef_bps: float = 20.0, noise_bps: float = 0.0, outlier_frac: float = 0.0,
    outlier_bps: float = 0.0, seed: int = 7, product: str = "BTC-USD", start_ns: int = START_NS,
) -> DataFrame:
    """Cost coef * sqrt(p) + perm * p, with Gaussian noise and shocked outliers."""
    rows = spark.range(n).withColumn("p", 0.01 + F.rand(seed) * 0.49)
    shock = F.when(F.rand(seed + 2) < outlier_frac, outlier_bps).otherwise(0.0)
    cost = coef_bps * F.sqrt("p") + perm_coef_bps * F.col("p") + noise_bps * F.randn(seed + 1) + shock
    return rows.select((F.lit(start_ns) + F.col("id") * 1_000_000_000).alias("ts_ns"), F.lit(product).alias("product"), F.col("p").alias("participation"), cost.alias("realised_bps"))


def large_ticks(spark: SparkSession, rows: int = 400_000, seed: int = 7, product: str = "BTC-USD", start_ns: int = START_NS) -> DataFrame:
    """A large capture whose every row is a hash of its number: any partition can be made on its own."""
    h = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    return spark.range(rows).select(
        (F.lit(start_ns) + F.col("id") * 250_000_000).alias("ts_ns"), F.lit(product).alias("product"), (60000 + h(1, 30_001) / 100.0 - 150).alias("price"),
        (0.01 + h(2, 49_001) / 100_000.0).alias("size"), F.when(h(3, 2) == 0, "buy").otherwise("sell").alias("side"), (F.col("id") + 1).alias("trade_id"),
    )
