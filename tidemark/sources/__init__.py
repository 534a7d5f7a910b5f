"""Schemas, readers and writers of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "ts_ns long, product string, price double, size double, side string, trade_id long"
QUOTE = "ts_ns long, product string, bid double, bid_size double, ask double, ask_size double"
BOOK = "ts_ns long, product string, side string, level long, price double, size double"
IMPACT = "ts_ns long, product string, participation double"
CALIBRATION = "ts_ns long, product string, participation double, realised_bps double"
FILL = "ts_ns long, product string, side string, qty double, price double, interval_volume double"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """NDJSON (.ndjson, .jsonl) or Parquet, by a strict schema; a missing or null field is an error when the rows are read."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{path}: a row has no {c}")).cast(df.schema[c].dataType))
    return df.select(*[whole(c).alias(c) for c in df.columns])


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TICK)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QUOTE)


def read_book(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, BOOK)


def read_impact(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, IMPACT)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CALIBRATION)


def read_fills(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FILL)


def write_ticks(df: DataFrame, path: str) -> int:
    """Write ticks, or rows of any other schema, as Parquet or NDJSON by extension, in time order within and across files; the number of rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    ordered = df.repartitionByRange("ts_ns").sortWithinPartitions(*[c for c in ("ts_ns", "trade_id", "side", "level") if c in df.columns])
    # counted after the exchange: below it, sampling its bounds would count the rows once more
    ordered = ordered.observe(seen, F.count(F.lit(1)).alias("rows"))
    if path.rstrip("/").endswith(".parquet"):
        ordered.write.mode("overwrite").parquet(path)
    else:
        ordered.write.mode("overwrite").json(path)
    return int(seen.get["rows"])


def convert(spark: SparkSession, source: str, target: str) -> int:
    """NDJSON to Parquet or back."""
    return write_ticks(read_ticks(spark, source), target)
