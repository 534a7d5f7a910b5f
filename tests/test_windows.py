"""As-of joins, sliding windows and bursts against plain Python."""

import bisect
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from tidemark.operators import asof, windows
from tidemark.streaming import windows as live
from tidemark.streaming.state import to_table

HOUR = X.HOUR


@pytest.mark.parametrize("exact", [True, False])
def test_as_of_against_a_search(spark, exact):
    rng = random.Random(exact)
    steps = [0, 1, HOUR // 3, 5 * HOUR, 40 * HOUR]
    right, left, t = [], [], -3 * HOUR
    for k in range(120):
        t += rng.choice(steps)
        right.append((rng.choice("pq"), t, float(k), k if k % 9 else None))
    for k in range(150):
        left.append((rng.choice("pqr"), rng.choice([rng.randint(-5 * HOUR, t + HOUR), rng.choice(right)[1]]), k))
    left += [("p", None, 1000), (None, 5, 1001), left[0]]
    a = spark.createDataFrame(left, "product string, ts_ns long, id int")
    b = spark.createDataFrame([*right, ("p", None, 9.0, 1)], "product string, quote_ns long, mid double, seq int")
    got = asof.as_of(a, b, ["product"], ["mid", "seq"], ts="quote_ns", exact=exact, order=["mid"])
    assert got.columns == ["product", "ts_ns", "id", "mid", "seq"]
    want = []
    for product, at, k in left:
        own = sorted((q[1], q[2], q[3]) for q in right if q[0] == product)
        place = 0 if at is None else (bisect.bisect_right if exact else bisect.bisect_left)([q[0] for q in own], at)
        want.append((product, at, k, *(own[place - 1][1:] if place else (None, None))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError, match="both sides"):
        asof.as_of(a, a, ["product"], ["id"])


def test_spreads_of_a_hand_made_day(spark):
    quotes = spark.createDataFrame([(0, "P", 99.0, 1.0, 101.0, 1.0), (10, "P", 109.0, 1.0, 111.0, 1.0)], "ts_ns long, product string, bid double, bid_size double, ask double, ask_size double")
    ticks = spark.createDataFrame([(0, "P", 50.0, 1.0, "buy", 1), (5, "P", 101.0, 2.0, "buy", 2), (6, "P", 99.0, 2.0, "sell", 3)], X.TICK)
    r = asof.trade_spreads(ticks, quotes, 5).first()
    assert (r.trades, r.priced_trades, r.volume) == (3, 2, 5.0)
    assert r.effective_spread_bps == pytest.approx(200.0) and r.realised_spread_bps == pytest.approx((2 * (101 - 110) - 2 * (99 - 110)) / 100 * 1e4 / 2)
    assert r.price_impact_bps == pytest.approx(r.effective_spread_bps - r.realised_spread_bps)
    with pytest.raises(ValueError, match="horizon"):
        asof.trade_spreads(ticks, quotes, -1)


def ticks(seed=5, n=200):
    rng, t, out = random.Random(seed), -2 * HOUR, []
    for k in range(n):
        t += rng.choice([0, X.SECOND, 100 * X.SECOND, 60 * X.SECOND, HOUR, 3 * HOUR])
        out.append((t, rng.choice("PQ"), 100 + rng.random(), 1 + rng.random(), "buy", k))
    return out


def sums(rows):
    volume = sum(r[3] for r in rows)
    return len(rows), pytest.approx(volume), pytest.approx(sum(r[2] * r[3] for r in rows) / volume)


def test_rolling_vwap(spark):
    rows, step = ticks(), 600 * X.SECOND
    got = {(r.product, r.start_ns): (r.trades, r.volume, r.vwap) for r in windows.rolling_vwap(spark.createDataFrame(rows, X.TICK), 3 * step, step, ["product"]).collect()}
    held = {}
    for r in rows:
        for k in range(3):
            held.setdefault((r[1], (r[0] // step - k) * step), []).append(r)
    assert {k: sums(v) for k, v in held.items()} == got
    with pytest.raises(ValueError, match="multiple"):
        windows.rolling_vwap(spark.createDataFrame(rows, X.TICK), 5, 2)


def runs(rows, gap):
    out = []
    for product in sorted({r[1] for r in rows}):
        last = None
        for r in sorted(r for r in rows if r[1] == product):
            if last is None or r[0] - last >= gap:
                out.append([])
            out[-1].append(r)
            last = r[0]
    return {(run[0][1], run[0][0], run[-1][0]): sums(run) for run in out}


@pytest.mark.parametrize("gap", [1, 61 * X.SECOND, HOUR, HOUR + 1, 4 * HOUR])
def test_bursts(spark, gap):
    rows = ticks()
    got = {(r.product, r.start_ns, r.last_ns): (r.trades, r.volume, r.vwap) for r in windows.trade_bursts(spark.createDataFrame(rows, X.TICK), gap, ["product"]).collect()}
    assert got == runs(rows, gap)


def test_windows_of_a_stream_end_with_the_watermark(spark, tmp_path):
    rows = [r for r in ticks(9, 120) if r[0] >= 0]
    last = max(r[0] for r in rows)
    parts = [rows[:40], rows[40:80], rows[80:], [(last + 100 * HOUR, "Z", 1.0, 1.0, "buy", 9999)], [(5, "P", 1.0, 1.0, "buy", 10_000)]]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("ts_ns", "product", "price", "size", "side", "trade_id"), r))) + "\n" for r in part))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(X.TICK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = to_table(live.trade_bursts(stream, HOUR, "1 hour"), mode="append").where("product <> 'Z'").collect()
    assert {(r.product, r.start_ns, r.last_ns): (r.trades, r.volume, r.vwap) for r in got} == runs(rows, HOUR)
    bars = to_table(live.windowed_bars(stream, "2 hours", "1 hour", "1 hour"), mode="append").where("product <> 'Z'")
    assert bars.agg(F.sum("trades")).first()[0] == 2 * len(rows) and bars.where("high < low or open > high or close < low").count() == 0
