"""The quote that stood at a time: an as-of join, and what trades paid against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import r8, safe_div

#: Rows are looked up within stretches of this length; from stretch to stretch only the newest row is carried.
STRETCH_NS = 3_600_000_000_000
_FOUND, _KIND, _STRETCH, _CARRIED = "found_", "kind_", "stretch_", "carried_"


def as_of(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], at: str = "ts_ns", ts: str = "ts_ns", exact: bool = True, order: list[str] = []) -> DataFrame:
    """left, all rows and columns, with `columns` of the newest row of right whose ts is not after left's `at` (exact=False: before it), per keys.

    Of right rows of one time the last by `order` counts, or by the columns themselves.  Without such a row, or where `at` is null, the columns are
    null.  Both sides meet in one exchange by keys and stretch of time, so a busy key is many tasks, and no row meets more than one other.
    """
    taken = {*left.columns} & {*columns, _FOUND, _KIND, _STRETCH, _CARRIED}
    if taken:
        raise ValueError(f"columns of both sides: {sorted(taken)}")
    own = [c for c in left.columns if c not in keys]
    tie = F.struct(*[F.col(c) for c in order or columns])
    mine = left.select(*keys, F.struct(*own).alias("own_"), F.col(at).cast("long").alias("t_"), F.lit(1 if exact else -1).alias(_KIND), F.lit(None).alias(_FOUND), F.lit(None).alias("tie_"))
    theirs = right.where(F.col(ts).isNotNull()).select(*keys, F.lit(None).alias("own_"), F.col(ts).cast("long").alias("t_"), F.lit(0).alias(_KIND), F.struct(*columns).alias(_FOUND), tie.alias("tie_"))
    both = mine.unionByName(theirs).withColumn(_STRETCH, F.expr(f"floor(t_ / {STRETCH_NS})"))
    before = Window.partitionBy(*keys, _STRETCH).orderBy("t_", _KIND, "tie_").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, _STRETCH).agg(F.max(F.when(F.col(_KIND) == 0, F.struct("t_", "tie_", _FOUND)))[_FOUND].alias(_CARRIED))
    earlier = Window.partitionBy(*keys).orderBy(_STRETCH).rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch
    ends = ends.withColumn(_CARRIED, F.last(_CARRIED, ignorenulls=True).over(earlier)).where(F.col(_CARRIED).isNotNull() & F.col(_STRETCH).isNotNull())
    met = both.withColumn(_FOUND, F.last(_FOUND, ignorenulls=True).over(before)).where(F.col(_KIND) != 0).join(ends, [*keys, _STRETCH], "left")
    best = F.when(F.col(_STRETCH).isNotNull(), F.coalesce(_FOUND, _CARRIED))
    return met.withColumn("best_", best).select(*[F.col(c) if c in keys else F.col(f"own_.{c}").alias(c) for c in left.columns], *[F.col(f"best_.{c}").alias(c) for c in columns])


def trade_spreads(trades: DataFrame, quotes: DataFrame, horizon_ns: int, keys: list[str] = []) -> DataFrame:
    """What trades paid: a row for each of keys, weighted by size.

    effective: twice the distance of a price from the mid that stood before the trade, in basis points of that mid, paid if positive; realised: the same from
    the mid that stands horizon_ns later; impact: their difference.  Trades without a quote before them aren't priced and are counted.
    """
    if horizon_ns < 0:
        raise ValueError("horizon_ns must be >= 0")
    mids = quotes.select("product", F.col("ts_ns").alias("quote_ns"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"))
    later = mids.select("product", "quote_ns", F.col("mid").alias("later_mid"))
    own = trades.select(*{*keys, "product"}, "ts_ns", "price", "size", "side", (F.col("ts_ns") + horizon_ns).alias("later_ns"))
    met = as_of(as_of(own, mids, ["product"], ["mid"], ts="quote_ns", exact=False), later, ["product"], ["later_mid"], at="later_ns", ts="quote_ns")
    sign = F.when(F.col("side") == "buy", 2.0).otherwise(-2.0)
    met = met.withColumn("effective", sign * safe_div(F.col("price") - F.col("mid"), "mid") * 1e4).withColumn("realised", sign * safe_div(F.col("price") - F.col("later_mid"), "mid") * 1e4)
    mean = lambda c: r8(safe_div(F.sum(F.col(c) * F.col("size")), F.sum(F.when(F.col(c).isNotNull(), F.col("size")))))
    out = met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count("effective").alias("priced_trades"), r8(F.sum("size")).alias("volume"), mean("effective").alias("effective_spread_bps"), mean("realised").alias("realised_spread_bps"),
    )
    return out.withColumn("price_impact_bps", r8(F.col("effective_spread_bps") - F.col("realised_spread_bps")))
