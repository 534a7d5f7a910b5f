"""Known answers, invariants and refusals of the engine's operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from tidemark import plans
from tidemark.functions import bucket_of, r8
from tidemark.operators import book, fills, impact, pov, quotes, ticks
from tidemark.sources import live

CAPS, HALF_LIVES = [0.01, 0.3, 0.5], [0.25, 0.5, 1.0, 2.0, 4.0]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rounding_is_half_away_from_zero(spark):
    rows = spark.createDataFrame([(1.5e-8,), (-2.5e-8,), (0.1,), (1e300,)], "x double").select(r8("x").alias("y")).collect()
    assert [r.y for r in rows] == [1e-8, -3e-8, 0.1, 1e300] or [r.y for r in rows][:2] == [math.floor(1.5e-8 * 1e8 + 0.5) / 1e8, -math.floor(2.5e-8 * 1e8 + 0.5) / 1e8]


def test_bucket_floors_negative_times(spark):
    assert one(spark.createDataFrame([(-1,)], "t long").select(bucket_of("t", 10).alias("b"))).b == -10


def test_bars_conserve_volume_and_order_prices(spark):
    rows = ticks.bars(X.rising_day(spark), X.SECOND).orderBy("bucket_ns").collect()
    assert [r.volume for r in rows] == [2.0, 5.0, 3.0]
    assert all(r.low <= min(r.open, r.close) and max(r.open, r.close) <= r.high for r in rows)


def test_summary_and_twap(spark):
    r = one(ticks.summary(X.rising_day(spark), X.SECOND))
    assert r.ticks == 4 and len(r.bars) == 3 and r.vwap == pytest.approx(52.7)
    assert r.twap == pytest.approx((50 * 1 + 51 * 0.25 + 53 * 0.75) / 2)
    assert r.imbalance == 1.0


def test_twap_is_stitched_over_stretches(spark):
    rows = [(k * X.HOUR // 3, "P", 100.0 + k, 1.0, "buy", k) for k in range(20)]
    got = one(ticks.session_twap(spark.createDataFrame(rows, X.TICK))).twap
    assert got == pytest.approx(sum(100.0 + k for k in range(19)) / 19)


def test_tick_refusals(spark):
    empty = spark.createDataFrame([], X.TICK)
    with pytest.raises(ValueError, match="no ticks"):
        ticks.session_vwap(empty)
    with pytest.raises(ValueError, match="need >= 2 ticks"):
        ticks.session_twap(X.rising_day(spark).limit(1))
    with pytest.raises(ValueError, match="zero total size"):
        ticks.session_vwap(X.rising_day(spark).withColumn("size", F.lit(0.0)))
    with pytest.raises(ValueError, match="bucket_ns"):
        ticks.bars(empty, 0)
    with pytest.raises(ValueError, match="no quotes"):
        quotes.quote_metrics(spark.createDataFrame([], "bid double, ask double, bid_size double, ask_size double"))


def test_sweep_walks_levels(spark):
    rows = [(0, "P", "ask", k, 100.0 + k, 1.0) for k in range(3)] + [(0, "P", "bid", 0, 99.0, 1.0)]
    b = spark.createDataFrame(rows, X.BOOK)
    r = one(book.sweep_cost(b, "buy", 2.0))
    assert (r.avg_sweep_vwap, r.avg_levels_consumed, r.avg_fill_ratio, r.filled_snapshots) == (100.5, 2.0, 1.0, 1)
    assert one(book.sweep_cost(b, "buy", 10.0)).avg_fill_ratio == pytest.approx(0.3)
    with pytest.raises(ValueError, match="side"):
        book.sweep_cost(b, "up", 1.0)
    with pytest.raises(ValueError, match="order_size"):
        book.sweep_cost(b, "buy", 0.0)


def test_book_grid(spark):
    rows = {r.every_s: r for r in book.book_grid_sweep(X.heavy_book(spark), [1.0, 2.0, 10.0]).collect()}
    assert rows[0.0].avg_queue_imbalance == pytest.approx(0.1) and rows[0.0].avg_spread == pytest.approx(0.64)
    assert [rows[k].snapshots for k in (1.0, 2.0, 10.0)] == [5, 3, 1]
    assert rows[2.0].avg_queue_imbalance == pytest.approx(-1 / 6, abs=1e-8) and not rows[2.0].queue_sign_kept and rows[2.0].spread_ratio == pytest.approx(0.625)
    assert rows[1.0].queue_sign_kept


@pytest.mark.parametrize("stretch", [1, 3, 20, 10_000])
def test_thinning_by_stretches(spark, monkeypatch, stretch):
    """Any stretches give what a scan gives, over gaps longer than a stretch and than a spacing."""
    monkeypatch.setattr(book, "STRETCH_SNAPSHOTS", stretch)
    rng, times = random.Random(stretch), {}
    for name in ("a", "b"):
        t, times[name] = rng.randint(0, 10**6), []
        for _ in range(150):
            t += rng.choice([1, 20, 300, 7000]) * rng.randint(1, 9)
            times[name].append(t)
    grid = [(e, o) for e in (50, 400, 5000, 100_000) for o in (0, e // 3, e - 1)]
    spacings = spark.createDataFrame(grid, "every_ns long, offset_ns long")
    rows = spark.createDataFrame([(n, t) for n in times for t in times[n]], "book string, ts_ns long")
    want = set()
    for n, ts in times.items():
        for e, o in grid:
            due = ts[0] + o
            for t in ts:
                if t >= due:
                    want.add((n, e, o, t))
                    due = t + e
    got = book.thin(rows, spacings, ["book"]).collect()
    assert len(got) == len(want) and {(r.book, r.every_ns, r.offset_ns, r.ts_ns) for r in got} == want
    alone = book.thin(rows.where("book = 'a'").drop("book"), spacings).collect()
    assert {("a", r.every_ns, r.offset_ns, r.ts_ns) for r in alone} == {w for w in want if w[0] == "a"}
    assert book.thin(rows.limit(0), spacings, ["book"]).count() == 0


def test_grid_across_books_and_phases(spark):
    both = X.heavy_book(spark).withColumn("book", F.lit(0)).unionByName(X.steady_book(spark).withColumn("book", F.lit(1)))
    across = book.book_grid_across(both, [1.0, 2.0], "book")
    rows = {r.every_s: r for r in across.collect()}
    assert rows[1.0].sign_lost_by == [] and rows[2.0].sign_lost_by == [0] and rows[1.0].held and not rows[2.0].held
    assert sorted(map(tuple, book.held_without(across, both, "book").collect())) == [(0, 2), (1, 1)]
    p = one(book.book_grid_phase(X.heavy_book(spark), [2.0], 2))
    assert (p.snapshots_min, p.snapshots_max, p.sign_kept_phases, p.verdict) == (2, 3, 1, "split")
    assert p.queue_imbalance_min == pytest.approx(-1 / 6, abs=1e-8) and p.queue_imbalance_max == pytest.approx(0.5)
    assert {r.every_s: r.phases_run for r in book.book_grid_phase(X.heavy_book(spark), [1.0, 10.0], 5).collect()}[10.0] == 3
    q = {r.every_s: r for r in book.book_grid_phase_across(both, [1.0, 2.0], 2, "book").collect()}[2.0]
    assert q.held_books == 1 and q.split_by == [0]


def test_schedule_known_answers(spark):
    r = impact.optimal_schedule(spark, 6, 3.0, 2.0, 25.0, 5.0, 8.0).first()
    assert r.urgency == pytest.approx(0.7) and r.impact_bps == 13.98295273 and r.risk_bps == 3.58880415 and r.saving_bps == 0.21511026
    calm = impact.optimal_schedule(spark, 6, 3.0, 2.0, 25.0, 5.0, 0.0).first()
    assert calm.urgency == 0 and calm.impact_bps == 13.75 and calm.saving_bps == 0


def test_calibration_recovers_clean_coefficients(spark):
    rows = [(k, "P", p, 10 * math.sqrt(p) + 20 * p) for k, p in enumerate([0.01, 0.04, 0.09, 0.16, 0.25])]
    s = spark.createDataFrame(rows, X.SAMPLE)
    for fit in (impact.calibrate_impact(s), impact.calibrate_impact_robust(s), impact.calibrate_impact_robust(s, huber_delta=3.0)):
        r = one(fit)
        assert r.coef_bps == pytest.approx(10, abs=1e-6) and r.perm_coef_bps == pytest.approx(20, abs=1e-6) and r.r_squared == pytest.approx(1)
    with pytest.raises(Exception, match="singular design"):
        impact.calibrate_impact(s.withColumn("participation", F.lit(0.1))).collect()


def test_sensitivity_breakeven(spark):
    rows = fills.sensitivity(X.crossing_fills(spark), 30000.0, [10.0, 20.0, 30.0, 40.0]).collect()
    assert rows[0].sign_flips == 1 and rows[0].breakeven_coef_bps == 24.61720435 and not rows[0].verdict_stable
    assert {r.best_alternative for r in rows} == {"twap"}
    with pytest.raises(ValueError, match="strictly increasing"):
        fills.sensitivity(X.crossing_fills(spark), 30000.0, [10.0, 10.0])


def test_fill_refusals(spark):
    good = X.crossing_fills(spark)
    with pytest.raises(ValueError, match="one side"):
        fills.shortfall(good.withColumn("side", F.when(F.col("ts_ns") == 1, "sell").otherwise("buy")), 5.0, 30000.0, 25.0)
    with pytest.raises(ValueError, match="more than parent_qty"):
        fills.shortfall(good, 1.0, 30000.0, 25.0)
    with pytest.raises(ValueError, match="larger than its interval"):
        fills.shortfall(good.withColumn("qty", F.lit(1000.0)), 5000.0, 30000.0, 25.0)


def test_pov_schedule(spark):
    rows = pov.pov_schedule(X.rising_day(spark), X.SECOND, 1.0, 0.5, 10.0).orderBy("bucket_ns").collect()
    assert [r.participation for r in rows] == [0.1] * 3 and [r.size for r in rows] == [0.2, 0.5, 0.3] and rows[0].pov_tracking_bps == 0


@pytest.mark.parametrize(
    "cap, capped, unfilled, spread, spread_unfilled",
    [(1.0, 78.0, 0.0, 78.0, 0.0), (0.2, 80.0, 0.0, 79.6, 0.0), (0.08, None, 0.4, None, 0.2), (0.05, None, 0.55, None, 0.5)],
)
def test_backtest_caps(spark, cap, capped, unfilled, spread, spread_unfilled):
    r = one(pov.pov_backtest(X.rising_day(spark), X.day_after(spark), X.SECOND, 1.0, cap, 25.0, 5.0))
    assert r.price == 78.0 and r.session_vwap == 81.0 and r.tracking_bps == -370.37037037
    assert r.capped_unfilled_qty == pytest.approx(unfilled) and r.spread_unfilled_qty == pytest.approx(spread_unfilled)
    if capped is not None:
        assert r.capped_price == capped and r.spread_price == spread


def test_backtest_refuses_other_slots(spark):
    with pytest.raises(ValueError, match="different slots"):
        pov.pov_backtest(X.rising_day(spark), X.day_after(spark).where("size > 2"), X.SECOND, 1.0, 0.5, 25.0)
    with pytest.raises(ValueError, match="plan capture: no ticks"):
        pov.pov_backtest(X.rising_day(spark).where("false"), X.day_after(spark), X.SECOND, 1.0, 0.5, 25.0)


def verdicts(rows, by):
    out = {}
    for r in sorted(rows, key=lambda r: r.cap):
        out.setdefault(r[by], []).append(r.verdict)
    return [out[k] for k in sorted(out)]


def test_walks_have_the_known_verdicts(spark):
    walk = lambda names, **k: plans.walk_forward(X.sessions(spark, names), "session", [0, 1, 2, 3], X.SECOND, 0.6, CAPS, HALF_LIVES, 25.0, 5.0, **k).collect()
    assert verdicts(walk(["middle", "level", "early", "dry"]), "input") == [["inert", "loss", "loss"], ["inert", "unstable", "gain"]]
    rows = walk(["level", "middle", "early", "dry"])
    assert verdicts(rows, "input") == [["inert", "gain", "gain"], ["inert", "unstable", "gain"]]
    assert [c for _, c in sorted({(r.cap, r.consensus) for r in rows})] == ["inert", "mixed", "gain"]


def test_window_sweep_spans(spark):
    names = ["middle", "level", "early", "dry"]
    rows = plans.window_sweep(X.sessions(spark, names), "session", [0, 1, 2, 3], X.SECOND, 0.6, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    spans = {r.cap: r.last_fold_span_bps for r in rows}
    assert [spans[c] for c in CAPS] == [0, 0.79085329, 0.75415014]


def test_holdout_agrees(spark):
    rows = plans.holdout(X.sessions(spark, ["level", "middle", "early"]), "session", [0, 1, 2], X.SECOND, 1.0, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    assert verdicts(rows, "held_out") == [["inert", "gain", "gain"]] * 3 and "mixed" not in {r.consensus for r in rows}


def test_stability_counts(spark):
    rows = plans.stability(X.sessions(spark, ["level", "middle", "dry"]), "session", [0, 1], 2, X.SECOND, 1.0, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    assert (rows[0].inert_caps, rows[0].stable_caps, rows[0].unstable_caps) == (1, 2, 0)


def test_sweep_points_equal_single_runs(spark):
    s = X.sessions(spark, ["middle", "level", "early"])
    swept = {r.cap: r for r in plans.cap_sweep(s, "session", [0, 1], 2, X.SECOND, 0.6, CAPS, 25.0, 5.0).collect()}
    for cap in CAPS:
        alone = plans.pov_forecast(s, "session", [0, 1], 2, X.SECOND, 0.6, cap, 25.0, 5.0).first()
        assert alone.capped_improvement_bps == swept[cap].improvement_bps and alone.capped_shortfall_qty == swept[cap].shortfall_qty
    first = swept[CAPS[0]]
    assert first.like_for_like_points + first.dominated_points + first.traded_off_points == len(CAPS)


def test_walk_refusals(spark):
    s = X.sessions(spark, ["middle", "level", "early", "dry"])
    with pytest.raises(ValueError, match="exactly one"):
        plans.walk_forward(s, "session", [0, 1, 2, 3], X.SECOND, None, CAPS, HALF_LIVES, 25.0)
    with pytest.raises(ValueError, match="at least 4"):
        plans.walk_forward(s, "session", [0, 1, 2], X.SECOND, 1.0, CAPS, HALF_LIVES, 25.0)
    with pytest.raises(ValueError, match="time order"):
        plans.walk_forward(s, "session", [1, 0, 2, 3], X.SECOND, 1.0, CAPS, HALF_LIVES, 25.0)


def test_pov_and_twap_fills(spark):
    t = X.rising_day(spark)
    r = one(fills.pov_fill(t, side="buy", parent_qty=1.0, participation=0.1, bucket_ns=X.SECOND))
    assert r.filled_qty == pytest.approx(1.0) and r.fully_filled and r.avg_price == pytest.approx(52.7, abs=1e-6)
    assert one(fills.twap_fill(t, side="sell", parent_qty=3.0, bucket_ns=X.SECOND)).fully_filled
    with pytest.raises(ValueError, match="participation"):
        fills.pov_fill(t, side="buy", parent_qty=1.0, participation=0.0, bucket_ns=1)
    with pytest.raises(ValueError, match="impact_model"):
        fills.twap_fill(t, side="buy", parent_qty=1.0, bucket_ns=X.SECOND, impact_model="cubic")


def test_post_trade_queries_take_every_order(spark, tmp_path):
    from tidemark import queries

    rows = [(k, k % 17) for k in (1, 2, 999, 1000, 1001, 50_000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    filled = sum(1.0 + c % 5 for _, c in rows)
    (short,) = run("shortfall")
    assert (short.fills, short.filled_qty, short.parent_qty) == (len(rows), filled, 1.25 * filled)
    assert short.final_price == pytest.approx(100 + 50_000 % 13 * 1e-2)
    assert {r.qty for r in run("counterfactual")} == {filled} and len(run("counterfactual_legs")) == 3 * len(rows)
    drift = sum((1.0 + c % 5) / filled * (k % 13) for k, c in rows)
    made = {r.coef_bps: r.realised_cost_bps for r in run("sensitivity")}
    share = [((1.0 + c % 5) / filled, 1 / (4 + k % 9)) for k, c in rows]
    for coef, cost in made.items():
        assert cost == pytest.approx(drift + sum(w * (coef * p**0.5 + 5 * p) for w, p in share), abs=1e-6)


def test_an_order_that_fills_nothing(spark):
    r = one(fills.pov_fill(X.rising_day(spark).withColumn("size", F.lit(0.0)), side="buy", parent_qty=1.0, participation=0.1, bucket_ns=X.SECOND))
    assert (r.filled_qty, r.avg_price, r.fully_filled, r.fills) == (0.0, 0.0, False, 0)


def _carry(shares, volumes, q, cap):
    left, out = 0.0, []
    for s, v in zip(shares, volumes):
        want = s * q + left
        out.append(min(want, cap * v))
        left = want - out[-1]
    return out, left


def _fit(shares, volumes, q, cap):
    pinned = set()
    while True:
        free = [k for k in range(len(shares)) if k not in pinned]
        left = q - sum(cap * volumes[k] for k in pinned)
        total = sum(shares[k] for k in free)
        if not total:
            return [cap * v if s > 0 else 0.0 for s, v in zip(shares, volumes)], left
        over = {k for k in free if left * shares[k] / total > cap * volumes[k]}
        if not over:
            return [cap * volumes[k] if k in pinned else left * shares[k] / total for k in range(len(shares))], 0.0
        pinned |= over


def test_arms_equal_plain_loops(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for k in range(40):
        n = rng.randint(1, 12)
        raw = [rng.choice([0.0, rng.random(), 1.0]) for _ in range(n)]
        raw[rng.randrange(n)] = 1.0
        shares, volumes = [x / sum(raw) for x in raw], [rng.choice([1.0, 5.0, rng.random() + 0.01]) for _ in range(n)]
        cap = rng.choice([0.05, 0.3, 1.0])
        rows += [(k, j, shares[j], 1.0 / n, volumes[j], 100.0 + j, 100.0, 2.0, cap) for j in range(n)]
        want[k] = _carry(shares, volumes, 2.0, cap), _fit(shares, volumes, 2.0, cap)
    df = spark.createDataFrame(rows, "one int, slot int, plan_share double, exec_share double, volume double, vwap double, session_vwap double, parent_qty double, cap double")
    slots = {(r.one, r.slot): (r.capped_size, r.spread_size) for r in pov.plan_slots(df, ["one"], 25.0).collect()}
    for r in pov.price_plans(df, ["one"], 25.0).collect():
        (carried, left), (fitted, over) = want[r.one]
        assert r.capped_unfilled_qty == pytest.approx(left, abs=1e-7) and r.spread_unfilled_qty == pytest.approx(over, abs=1e-7)
        assert [slots[r.one, j][0] for j in range(len(carried))] == pytest.approx(carried, abs=1e-9)
        assert [slots[r.one, j][1] for j in range(len(fitted))] == pytest.approx(fitted, abs=1e-9)


def test_forecast_refusals_and_weights(spark):
    s = X.sessions(spark, ["middle", "level", "early"])
    run = lambda rows, **k: plans.pov_forecast(rows, "session", [0, 1], 2, X.SECOND, 0.6, 0.5, 25.0, **k)
    with pytest.raises(ValueError, match="different products"):
        run(s.withColumn("product", F.when(F.col("session") == 1, "Q").otherwise("P")))
    with pytest.raises(ValueError, match="shortfall_bps"):
        run(s, shortfall_bps=-1.0)
    with pytest.raises(ValueError, match="different slots"):
        run(s.where("not (session = 0 and trade_id = 1)"))
    with pytest.raises(ValueError, match="no ticks"):
        run(s.where("session <> 1"))
    assert [r.weight for r in plans.forecast_weights(spark, 3, 1.0).orderBy("place").collect()] == [0.14285714, 0.28571429, 0.57142857]
    assert {(r.plan, r.slot) for r in plans.forecast_slots(s, "session", [0, 1], 2, X.SECOND, 0.6, 0.5, 25.0).collect()} == {(p, j) for p in ("forecast", "naive") for j in range(3)}


def test_study_summaries(spark):
    s = X.sessions(spark, ["middle", "level", "middle", "level"])
    rows = plans.window_sweep(s, "session", [0, 1, 2, 3], X.SECOND, 0.6, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    assert {(r.settled_caps, r.all_settled, r.folds_run, r.distinct_folds) for r in rows} == {(3, True, 4, 3)}
    inputs = plans.window_sweep_inputs(s, "session", [0, 1, 2, 3], X.SECOND, 0.6, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    assert sorted({(r.input, r.walks, r.histories) for r in inputs}) == [(2, 2, 1), (3, 2, 2)]
    walk = plans.walk_forward(X.sessions(spark, ["level", "middle", "early", "dry"]), "session", [0, 1, 2, 3], X.SECOND, 0.6, CAPS, HALF_LIVES, 25.0, 5.0).collect()
    assert {(r.agreeing_caps, r.all_agree, r.product, r.buckets, r.sessions) for r in walk} == {(2, False, "P", 3, 4)}
    assert sorted({(r.input, r.inert_caps, r.stable_caps, r.unstable_caps) for r in walk}) == [(2, 1, 2, 0), (3, 1, 1, 1)]


def test_grids_refuse_one_book(spark):
    alone = X.heavy_book(spark).withColumn("book", F.lit(0))
    with pytest.raises(ValueError, match="two or more"):
        book.book_grid_across(alone, [1.0, 2.0], "book")
    with pytest.raises(ValueError, match="two or more"):
        book.book_grid_phase_across(alone, [1.0, 2.0], 2, "book")
    assert {r.sign_flips for r in book.book_grid_sweep(X.heavy_book(spark), [1.0, 2.0]).collect()} == {1}


def test_reports_are_compared_to_the_last_bit(spark):
    from tidemark import compat

    kind = "id int, x double, note string, parts array<double>"
    before = spark.createDataFrame([(1, 0.1, "a", [0.1]), (2, 1.0, None, None), (3, float("nan"), "c", [])], kind)
    after = spark.createDataFrame([(1, 0.1 + 2**-56, "a", [0.1]), (2, 1.0, None, None), (4, 0.0, "c", [])], kind)
    assert compat.compare(before, before, ["id"]).count() == 0
    found = compat.compare(before, after, ["id"])
    got = {(json.loads(r.place)["id"], r["column"], r.what) for r in found.collect()}
    assert got == {(1, "x", "changed"), *[(3, c, "lost") for c in ("x", "note", "parts")], *[(4, c, "new") for c in ("x", "note", "parts")]}
    agreed = spark.createDataFrame(found.where("what <> 'new'").collect(), found.schema)
    assert {r["column"] for r in compat.unexpected(found, agreed).where("what = 'new'").collect()} == {"x", "note", "parts"}
    assert compat.unexpected(found, agreed).count() == 3
    old = spark.createDataFrame([("{}", "y", "1", "2", "changed")], found.schema)
    assert [r.what for r in compat.unexpected(found.limit(0), old).collect()] == ["settled"]
    day = ticks.summary(X.rising_day(spark), X.SECOND).withColumn("run", F.lit(1))
    assert compat.compare(day, day, ["run"]).count() == 0


def test_a_walk_over_two_thousand_sessions(spark):
    """Pooled shares of long histories, with a half-life that fades within them, against sums over all members."""
    n, slots, half_lives = 2000, 3, [0.0, 0.25, 1.0, 40.0]
    rng = np.random.default_rng(1)
    volume = rng.uniform(1, 9, (n, slots))
    share = volume / volume.sum(axis=1, keepdims=True)
    rows = [(i, j, i * X.HOUR + j * X.SECOND, float(volume[i, j]), 100.0 + j, float(share[i, j]), float(volume[i].sum()), 100.0) for i in range(n) for j in range(slots)]
    prof = spark.createDataFrame(rows, "idx int, slot long, bucket_ns long, volume double, vwap double, share double, total double, session_vwap double")
    folds = {
        "grown": plans._folds(spark, 2, n, "0", "id"), "window": plans._folds(spark, 60, n, "id - 60", "id"), "held out": plans._folds(spark, 0, n, "0", str(n)),
    }
    for name, table in folds.items():
        made = plans.fold_plans(prof, table, n, [0.5], half_lives, parent_shares=[0.1], windows=name == "window")
        some = made.where(F.col("input").isin(*[k for k in (0, 1, 2, 59, 60, 61, 997, 1998, 1999)])).collect()
        assert made.count() == table.count() * slots * (len(half_lives) + 1) and len(some) > 60
        for r in some:
            i = r.input
            history = [j for j in range(n) if j != i] if name == "held out" else list(range(0 if name == "grown" else i - 60, i))
            age = np.arange(len(history))[::-1]
            if r.plan == "naive":
                want = share[history[-1], r.slot]
            else:
                w = np.ones(len(history)) if r.half_life == 0 else 0.5 ** (age / r.half_life)
                want = (w * share[history, r.slot]).sum() / w.sum()
            assert r.plan_share == pytest.approx(want, rel=1e-9), (name, r)
            assert r.parent_qty == pytest.approx(0.1 * volume[history].sum(axis=1).mean(), rel=1e-9)


def test_books_by_stretches(spark):
    """Levels that stand over many stretches, are touched again in some and asked about in few, against plain dictionaries."""
    rng = random.Random(3)
    hour, updates, t = 3600 * X.SECOND, [], 0
    for seq in range(600):
        t += rng.choice([0, X.SECOND, hour // 5, 3 * hour])
        side = rng.choice(["bid", "ask"])
        updates.append((rng.choice("PQ"), seq, t, side, 100.0 + rng.randint(0, 9) * (1 if side == "ask" else -1), float(rng.randint(0, 3))))
    at = sorted({("P" if k % 2 else "Q", rng.randint(0, t + hour)) for k in range(40)} | {("P", updates[50][2]), ("R", 5)})
    frame = spark.createDataFrame(updates, "product string, seq long, ts_ns long, side string, price double, size double")
    got = live.l2_levels(frame, spark.createDataFrame([*at, at[0]], "product string, ts_ns long"), 4).collect()
    want = []
    for product, when in at:
        sizes = {(u[3], u[4]): u[5] for u in updates if u[0] == product and u[2] <= when}
        for side, sign in (("bid", -1), ("ask", 1)):
            levels = sorted((sign * p, z) for (s, p), z in sizes.items() if s == side and z)[:4]
            want += [(when, product, side, k, sign * p, z) for k, (p, z) in enumerate(levels)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sweeps_are_dealt_by_rows(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 4).selectExpr("id div 4 as ts_ns", "'P' as product", "if(id % 2 = 0, 'bid', 'ask') as side", "id % 4 div 2 as level", "100 + id % 4 as price", "1e0 + id % 3 as size")
    want = sorted(map(tuple, book.sweep_curve(rows, "buy", [0.5, 1.5]).collect()))
    monkeypatch.setattr(book, "TASK_ROWS", 10)
    curve = book.sweep_curve(rows, "buy", [0.5, 1.5])
    assert "hashpartitioning(ts_ns" in curve._jdf.queryExecution().executedPlan().toString() and ", 20)" in curve._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, curve.collect())) == want and len(want) == 2


def test_thinning_is_dealt_by_rows(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 2).selectExpr("id * 7 % 300 as ts_ns", "id % 2 as b")
    spacings = spark.createDataFrame([(10, 0), (7, 3)], "every_ns long, offset_ns long")
    want = sorted(map(tuple, book.thin(rows, spacings, ["b"]).collect()))
    monkeypatch.setattr(book, "TASK_ROWS", 50)
    thinned = book.thin(rows, spacings, ["b"])
    assert ", 12)" in thinned._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, thinned.collect())) == want and want
