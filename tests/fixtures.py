"""Small captures with known answers, inline."""

SECOND = 1_000_000_000
HOUR = 3600 * SECOND
START = 1_719_792_000_000_000_000
TICK = "ts_ns long, product string, price double, size double, side string, trade_id long"
BOOK = "ts_ns long, product string, side string, level long, price double, size double"
FILL = "ts_ns long, product string, side string, qty double, price double, interval_volume double"
SAMPLE = "ts_ns long, product string, participation double, realised_bps double"


def rising_day(spark):
    """Volumes of 2, 5 and 3 in three one-second buckets, at rising prices; VWAP 52.7."""
    rows = [(0, 50.0, 2.0), (SECOND, 51.0, 3.0), (SECOND + SECOND // 4, 53.0, 2.0), (2 * SECOND, 56.0, 3.0)]
    return spark.createDataFrame([(t, "P", p, s, "buy", i) for i, (t, p, s) in enumerate(rows)], TICK)


def day_after(spark):
    """Volumes of 5, 2 and 3; VWAP 81."""
    rows = [(0, 80.0, 5.0), (SECOND, 70.0, 2.0), (2 * SECOND, 90.0, 3.0)]
    return spark.createDataFrame([(HOUR + t, "P", p, s, "buy", i) for i, (t, p, s) in enumerate(rows)], TICK)


#: Volumes of three one-second buckets.
VOLUMES = {"middle": (2.0, 7.0, 4.0), "level": (4.5, 4.5, 4.0), "early": (9.0, 2.0, 0.8), "dry": (1.4, 1.3, 0.06)}


def sessions(spark, names):
    """One tick per bucket at 100, 101, 102; session k starts after k hours."""
    rows = [(k * HOUR + j * SECOND, "P", 100.0 + j, v, "buy", j, k) for k, name in enumerate(names) for j, v in enumerate(VOLUMES[name])]
    return spark.createDataFrame(rows, TICK + ", session int")


def heavy_book(spark):
    """Five one-level snapshots a second apart: ask-heavy at 0 and 2 s, else bid-heavy."""
    rows = []
    for k in range(5):
        bid, ask = ((100.9, 1.0), (101.0, 3.0)) if k in (0, 2) else ((100.0, 3.0), (101.0, 1.0))
        rows += [(k * SECOND, "P", "bid", 0, *bid), (k * SECOND, "P", "ask", 0, *ask)]
    return spark.createDataFrame(rows, BOOK)


def steady_book(spark):
    rows = [(k * SECOND, "P", side, 0, price, size) for k in range(5) for side, price, size in (("bid", 100.0, 3.0), ("ask", 101.0, 1.0))]
    return spark.createDataFrame(rows, BOOK)


def crossing_fills(spark):
    """2 at 30,000 of a volume of 4, then 0.1 at 30,060 of 100."""
    return spark.createDataFrame([(1, "P", "buy", 2.0, 30000.0, 4.0), (2, "P", "buy", 0.1, 30060.0, 100.0)], FILL)
