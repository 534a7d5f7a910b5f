"""Top-of-book averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import product_of, r8, safe_div


def quote_metrics(quotes: DataFrame, keys: list[str] = []) -> DataFrame:
    """Unweighted means over quotes of spread, mid, microprice and size imbalance."""
    if not keys and quotes.isEmpty():
        raise ValueError("no quotes")
    depth = F.col("bid_size") + F.col("ask_size")
    out = quotes.groupBy(*keys).agg(
        *product_of(quotes), F.count(F.lit(1)).alias("quotes"),
        r8(F.avg(F.col("ask") - F.col("bid"))).alias("avg_spread"),
        r8(F.avg((F.col("bid") + F.col("ask")) / 2)).alias("avg_mid"),
        r8(F.avg(safe_div(F.col("bid") * F.col("ask_size") + F.col("ask") * F.col("bid_size"), depth))).alias("avg_microprice"),
        r8(F.avg(safe_div(F.col("bid_size") - F.col("ask_size"), depth))).alias("avg_book_imbalance"),
    )
    return out
