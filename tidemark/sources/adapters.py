"""Captures derived from the driver's tables, by projections that SQL engines evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of bars and fills, and slots of plans (each day of the test tables trades in every hour, not in every five minutes).
BAR_NS = 300_000_000_000
SLOT_NS = 3_600_000_000_000
DAY_NS = 86_400_000_000_000


def _events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a stream reads whatever matches: the table is a file here, a folder there
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet") if stream else spark.read.parquet(path)
    events = source.select("event_id", "user_id", "value", "ts")
    # the column has no zone: read as UTC whatever the session's zone is
    micros = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) if spark.conf.get("spark.sql.session.timeZone") != "UTC" else F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("ts_ns", micros * 1000)


def ticks(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Tick rows of `events`, with session_id: the day."""
    return _events(spark, sf_dir, stream).selectExpr(
        "ts_ns", "'EVT' as product", "100 + value as price", "1 + (user_id % 10) / 10e0 as size", "if(event_id % 2 = 0, 'buy', 'sell') as side", "event_id as trade_id", f"ts_ns div {DAY_NS} as session_id"
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = "5e-2 * (1 + event_id % 5)"
    return _events(spark, sf_dir).selectExpr(
        "ts_ns", "'EVT' as product", f"100 + value - {half} as bid", "1e0 + event_id % 7 as bid_size", f"100 + value + {half} as ask", "1e0 + event_id % 11 as ask_size", f"ts_ns div {DAY_NS} as session_id"
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels on both sides of each quote, with session_id."""
    rows = _events(spark, sf_dir).selectExpr("ts_ns", "event_id", "value", "explode(sequence(0L, 4L)) as level", f"ts_ns div {DAY_NS} as session_id")
    rows = rows.selectExpr("*", "explode(array(0, 1)) as s")
    return rows.selectExpr(
        "ts_ns", "'EVT' as product", "if(s = 0, 'bid', 'ask') as side", "level", "100 + value + (2 * s - 1) * (5e-2 * (1 + event_id % 5) + 1e-1 * level) as price",
        "1e-1 + ((event_id * 31 + level * 17 + s * 7) % 29) / 10e0 as size", "session_id",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration samples of `orders`; their participation also makes impact slices."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "1e-2 + (o_custkey % 50) / 100e0 as p")
    return rows.selectExpr("o_orderkey * 1000000000 as ts_ns", "'EVT' as product", "p as participation", "10e0 * sqrt(p) + 20e0 * p + ((o_orderkey % 7) - 3) * 1e-1 as realised_bps")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buy for every order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "1e0 + o_custkey % 5 as qty")
    return rows.selectExpr("o_orderkey * 1000000000 as ts_ns", "'EVT' as product", "'buy' as side", "qty", "100e0 + (o_orderkey % 13) * 1e-2 as price", "qty * (4 + o_orderkey % 9) as interval_volume")
