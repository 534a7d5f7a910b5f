"""Fills of a parent order against bars, and attribution of real fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import check_grid, r8, require, safe_div
from tidemark.operators.ticks import bars, session_vwap

MODELS = ("linear", "sqrt")


def _fills(ticks: DataFrame, plan, side: str, parent_qty: float, bucket_ns: int, impact_bps: float, model: str, perm_bps: float, keys: list[str]) -> DataFrame:
    """Bars with qty and price of each child order; `plan` gives the quantity from the bars."""
    if side not in ("buy", "sell"):
        raise ValueError("side must be 'buy' or 'sell'")
    if parent_qty <= 0:
        raise ValueError("parent_qty must be positive")
    if model not in MODELS:
        raise ValueError(f"impact_model must be one of {MODELS}")
    sign = 1.0 if side == "buy" else -1.0
    w = Window.partitionBy(*keys).orderBy("bucket_ns")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = plan(bars(ticks, bucket_ns, keys), w, before).where("qty > 0")
    load = F.col("qty") / F.col("volume")
    rows = rows.withColumn("drift", F.coalesce(F.sum(perm_bps * 1e-4 * load).over(before), F.lit(0.0)))
    cost = sign * impact_bps * 1e-4 * (load if model == "linear" else F.sqrt(load))
    return rows.withColumn("price", F.col("vwap") * (1 + sign * F.col("drift")) * (1 + cost))


def _result(rows: DataFrame, ticks: DataFrame, side: str, parent_qty: float, keys: list[str]) -> DataFrame:
    arrival = ticks.groupBy(*keys).agg(F.min_by("price", F.struct("ts_ns", "trade_id")).alias("arrival"))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("qty") * F.col("price")).alias("notional"), F.sum("qty").alias("filled"), F.count(F.lit(1)).alias("fills"))
    out = arrival.join(sums, keys, "left") if keys else arrival.crossJoin(sums)
    # an order that fills nothing: no quantity, a price of 0, not filled
    out = out.fillna(0.0, ["notional", "filled"]).fillna(0, ["fills"])
    avg = F.coalesce(safe_div("notional", "filled"), F.lit(0.0))
    sign = 1.0 if side == "buy" else -1.0
    return out.select(
        *keys, F.lit(side).alias("side"), F.lit(float(parent_qty)).alias("parent_qty"), F.round("filled", 8).alias("filled_qty"), F.round(avg, 8).alias("avg_price"), F.round("arrival", 8).alias("arrival_price"),
        F.round(sign * (avg - F.col("arrival")) / F.col("arrival") * 1e4, 4).alias("is_bps"), (F.lit(float(parent_qty)) - F.col("filled") <= 1e-12).alias("fully_filled"), "fills",
    )


def pov_schedule_fills(ticks: DataFrame, *, side: str, parent_qty: float, participation: float, bucket_ns: int, impact_bps: float = 0.0, impact_model: str = "linear", perm_impact_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """The child orders of pov_fill(): keys, bucket_ns, qty, price."""
    if not 0 < participation <= 1:
        raise ValueError("participation must be in (0, 1]")

    def plan(rows: DataFrame, w, before) -> DataFrame:
        want = participation * F.col("volume")
        taken = F.coalesce(F.sum(want).over(before), F.lit(0.0))
        return rows.withColumn("qty", F.greatest(F.lit(0.0), F.least(want, parent_qty - taken)))

    return _fills(ticks, plan, side, parent_qty, bucket_ns, impact_bps, impact_model, perm_impact_bps, keys)


def pov_fill(ticks: DataFrame, *, side: str, parent_qty: float, participation: float, bucket_ns: int, impact_bps: float = 0.0, impact_model: str = "linear", perm_impact_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """Take up to `participation` of each bar's volume at its VWAP, moved by impact and by the drift of earlier children, until filled."""
    rows = pov_schedule_fills(
        ticks, side=side, parent_qty=parent_qty, participation=participation, bucket_ns=bucket_ns, impact_bps=impact_bps, impact_model=impact_model, perm_impact_bps=perm_impact_bps, keys=keys
    )
    return _result(rows, ticks, side, parent_qty, keys)


def twap_schedule_fills(ticks: DataFrame, *, side: str, parent_qty: float, bucket_ns: int, impact_bps: float = 0.0, impact_model: str = "linear", perm_impact_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """The child orders of twap_fill(): keys, bucket_ns, qty, price."""

    def plan(rows: DataFrame, w, before) -> DataFrame:
        return rows.withColumn("qty", F.lit(float(parent_qty)) / F.count(F.lit(1)).over(Window.partitionBy(*keys)))

    return _fills(ticks, plan, side, parent_qty, bucket_ns, impact_bps, impact_model, perm_impact_bps, keys)


def twap_fill(ticks: DataFrame, *, side: str, parent_qty: float, bucket_ns: int, impact_bps: float = 0.0, impact_model: str = "linear", perm_impact_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """An equal quantity in every bar; always fully filled."""
    rows = twap_schedule_fills(ticks, side=side, parent_qty=parent_qty, bucket_ns=bucket_ns, impact_bps=impact_bps, impact_model=impact_model, perm_impact_bps=perm_impact_bps, keys=keys)
    return _result(rows, ticks, side, parent_qty, keys).withColumn("fully_filled", F.lit(True))


def evaluate(ticks: DataFrame, *, side: str, parent_qty: float, participation: float, bucket_ns: int, keys: list[str] = [], **cost: object) -> DataFrame:
    """Both fills beside the session VWAP: one row per session and algorithm."""
    pov = pov_fill(ticks, side=side, parent_qty=parent_qty, participation=participation, bucket_ns=bucket_ns, keys=keys, **cost).withColumn("algo", F.lit("pov"))
    twap = twap_fill(ticks, side=side, parent_qty=parent_qty, bucket_ns=bucket_ns, keys=keys, **cost).withColumn("algo", F.lit("twap"))
    both, mark = pov.unionByName(twap), session_vwap(ticks, keys)
    both = both.join(mark, keys) if keys else both.crossJoin(mark)
    slip = (1.0 if side == "buy" else -1.0) * (F.col("avg_price") - F.col("vwap")) / F.col("vwap") * 1e4
    return both.select(*keys, "algo", F.col("vwap").alias("benchmark_vwap"), "side", "parent_qty", "avg_price", F.round(slip, 4).alias("slippage_vs_vwap_bps"), "is_bps", "fully_filled")


def _check_fills(fills: DataFrame, parent_qty: float | None, arrival: float) -> None:
    if not 0 < arrival < float("inf"):
        raise ValueError("arrival must be finite and positive")
    bad = lambda c: ~((F.col(c) > 0) & (F.col(c) < float("inf")))
    row = fills.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides"), F.min("side").alias("side"), *[F.count(F.when(bad(c) | F.col(c).isNull(), 1)).alias(c) for c in ("qty", "price", "interval_volume")],
        F.count(F.when(F.col("qty") > F.col("interval_volume"), 1)).alias("over"), F.sum("qty").alias("sum"),
    ).first()
    if not row["n"]:
        raise ValueError("no fills")
    if row["sides"] != 1 or row["side"] not in ("buy", "sell"):
        raise ValueError("fills must all be on one side, buy or sell")
    for c in ("qty", "price", "interval_volume"):
        if row[c]:
            raise ValueError(f"{c} must be finite and positive")
    if row["over"]:
        raise ValueError("a fill is larger than its interval's volume")
    if parent_qty is not None and row["sum"] > parent_qty:
        raise ValueError("fills sum to more than parent_qty")


def _signed(price: Column, arrival: float) -> Column:
    return F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * (price - arrival) / arrival * 1e4


def shortfall_slices(fills: DataFrame, arrival: float, coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """Per fill: participation, weight, realised, modelled and residual cost, unrounded."""
    p = F.col("qty") / F.col("interval_volume")
    rows = fills.crossJoin(F.broadcast(fills.agg(F.sum("qty").alias("filled"))))
    rows = rows.withColumn("participation", p).withColumn("weight", F.col("qty") / F.col("filled")).withColumn("realised", _signed(F.col("price"), arrival))
    rows = rows.withColumn("modelled", coef_bps * F.sqrt("participation") + perm_coef_bps * F.col("participation"))
    return rows.withColumn("residual", F.col("realised") - F.col("modelled"))


def shortfall(fills: DataFrame, parent_qty: float, arrival: float, coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """Post-trade attribution in one row: realised against modelled cost, and the opportunity cost of what wasn't filled."""
    if not 0 < parent_qty < float("inf"):
        raise ValueError("parent_qty must be finite and positive")
    _check_fills(fills, parent_qty, arrival)
    rows = shortfall_slices(fills, arrival, coef_bps, perm_coef_bps)
    by = lambda c: F.sum(F.col(c) * F.col("weight"))
    sums = rows.agg(
        F.min("product").alias("product"), F.min("side").alias("side"), F.count(F.lit(1)).alias("fills"), F.sum("qty").alias("filled"), F.sum(F.col("qty") * F.col("price")).alias("notional"), F.max_by("price", "ts_ns").alias("final"),
        by("realised").alias("realised"), by("modelled").alias("modelled"), by("residual").alias("residual"),
    )
    unfilled, rate = F.lit(float(parent_qty)) - F.col("filled"), F.col("filled") / parent_qty
    missed = unfilled / parent_qty * _signed(F.col("final"), arrival)
    return sums.select(
        "product", "side", "fills", F.lit(float(parent_qty)).alias("parent_qty"), r8("filled").alias("filled_qty"), r8(unfilled).alias("unfilled_qty"), r8(rate).alias("fill_rate"), F.lit(float(arrival)).alias("arrival_price"),
        r8(F.col("notional") / F.col("filled")).alias("avg_price"), r8("final").alias("final_price"), r8("realised").alias("realised_bps"), r8("modelled").alias("modelled_bps"), r8("residual").alias("residual_bps"),
        r8(missed).alias("opportunity_bps"), r8(rate * F.col("realised") + missed).alias("total_bps"),
    )


def _legs(fills: DataFrame, arrival: float, coefs: DataFrame, perm_coef_bps: float) -> DataFrame:
    """coef_bps, name, place, and of each fill ts_ns, side, price, interval_volume, q, participation, weight, drift, impact: the fills as made, in equal parts, and by volume.

    Every strategy trades in the same intervals; its impact is the model's, its drift the intervals' prices.
    """
    totals = fills.agg(F.sum("qty").alias("filled"), F.sum("interval_volume").alias("traded"), F.count(F.lit(1)).alias("n"))
    rows = fills.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(coefs))
    plans = F.explode(F.array(
        F.struct(F.lit("realised").alias("name"), F.lit(0).alias("place"), F.col("qty").alias("q")),
        F.struct(F.lit("twap").alias("name"), F.lit(1).alias("place"), (F.col("filled") / F.col("n")).alias("q")),
        F.struct(F.lit("volume").alias("name"), F.lit(2).alias("place"), (F.col("filled") * F.col("interval_volume") / F.col("traded")).alias("q")),
    ))
    rows = rows.select("product", "ts_ns", "side", "price", "interval_volume", "filled", "n", "coef_bps", plans.alias("s")).select("*", "s.*").withColumn("p", F.col("q") / F.col("interval_volume"))
    rows = rows.withColumn("participation", F.when(F.col("p") > 1, F.raise_error(F.lit("a strategy takes more than an interval's volume")).cast("double")).otherwise(F.col("p")))
    rows = rows.withColumn("weight", F.col("q") / F.col("filled")).withColumn("drift", _signed(F.col("price"), arrival))
    return rows.withColumn("impact", F.col("coef_bps") * F.sqrt("participation") + perm_coef_bps * F.col("participation")).drop("s", "p")


def _strategies(fills: DataFrame, arrival: float, coefs: DataFrame, perm_coef_bps: float) -> DataFrame:
    """coef_bps, name, place, side, intervals, qty, drift, impact and cost of each strategy of _legs()."""
    rows = _legs(fills, arrival, coefs, perm_coef_bps)
    drift, impact = F.sum(F.col("weight") * F.col("drift")), F.sum(F.col("weight") * F.col("impact"))
    # each strategy's parts make up what was filled: a sum of many equal parts would only add rounding
    return rows.groupBy("coef_bps", "name", "place").agg(
        F.min("product").alias("product"), F.first("side").alias("side"), F.max("n").alias("intervals"), F.max("filled").alias("qty"), drift.alias("drift"), impact.alias("impact"), (drift + impact).alias("cost")
    )


def counterfactual(fills: DataFrame, arrival: float, coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per strategy: what the fills cost, and what equal slices or slices by volume would have; side, intervals, arrival_price, best_alternative and edge_bps repeat."""
    _check_fills(fills, None, arrival)
    coefs = fills.sparkSession.createDataFrame([(float(coef_bps),)], "coef_bps double")
    rows = _strategies(fills, arrival, coefs, perm_coef_bps).withColumn("cost_bps", r8("cost"))
    w, other = Window.partitionBy(), F.col("place") > 0  # three rows
    rows = rows.withColumn("best_alternative", F.min_by("name", F.when(other, F.struct("cost_bps", "place"))).over(w))
    rows = rows.withColumn("edge_bps", r8(F.min(F.when(other, F.col("cost_bps"))).over(w) - F.max(F.when(~other, F.col("cost_bps"))).over(w)))
    return rows.select("product", "side", "intervals", r8(F.lit(float(arrival))).alias("arrival_price"), "name", r8("qty").alias("qty"), r8("drift").alias("drift_bps"), r8("impact").alias("impact_bps"), "cost_bps", "best_alternative", "edge_bps")


def counterfactual_legs(fills: DataFrame, arrival: float, coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per strategy and interval: what it trades there, and what that costs."""
    _check_fills(fills, None, arrival)
    rows = _legs(fills, arrival, fills.sparkSession.createDataFrame([(float(coef_bps),)], "coef_bps double"), perm_coef_bps)
    return rows.select(
        "name", "ts_ns", r8("q").alias("qty"), r8("price").alias("price"), r8("interval_volume").alias("interval_volume"), r8("participation").alias("participation"), r8("weight").alias("weight"),
        r8("drift").alias("drift_bps"), r8("impact").alias("impact_bps"), r8(F.col("drift") + F.col("impact")).alias("cost_bps"),
    )


def sensitivity(fills: DataFrame, arrival: float, coef_grid: list[float], perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per coefficient: best alternative and edge; range of the edge, its sign flips, breakeven and stability repeat."""
    grid = check_grid(coef_grid, "coef_grid", low_open=False)
    _check_fills(fills, None, arrival)
    coefs = fills.sparkSession.createDataFrame([(g,) for g in grid], "coef_bps double")
    rows = _strategies(fills, arrival, coefs, perm_coef_bps).withColumn("cost_bps", r8("cost"))
    alt = F.when(F.col("place") > 0, F.struct("cost_bps", "place", "name"))
    points = rows.groupBy("coef_bps").agg(F.min("product").alias("product"), F.max(F.when(F.col("place") == 0, F.col("cost_bps"))).alias("realised_cost_bps"), F.min(alt).alias("b"))
    points = points.select("product", "coef_bps", "realised_cost_bps", F.col("b.name").alias("best_alternative"), F.col("b.cost_bps").alias("best_cost_bps"), r8(F.col("b.cost_bps") - F.col("realised_cost_bps")).alias("edge_bps"))
    w = Window.orderBy("coef_bps")  # a row for each point of the grid
    points = points.withColumn("next_coef", F.lead("coef_bps").over(w)).withColumn("next_edge", F.lead("edge_bps").over(w))
    flips = F.col("edge_bps") * F.col("next_edge") < 0
    cross = F.col("coef_bps") + (F.col("next_coef") - F.col("coef_bps")) * -F.col("edge_bps") / (F.col("next_edge") - F.col("edge_bps"))
    sums = points.agg(
        F.min("edge_bps").alias("edge_min_bps"), F.max("edge_bps").alias("edge_max_bps"), F.count(F.when(flips, 1)).alias("sign_flips"),
        F.coalesce(F.min_by(F.when(flips, cross), F.when(flips, F.col("coef_bps"))), F.min(F.when(F.col("edge_bps") == 0, F.col("coef_bps")))).alias("breakeven"),
        (F.count_distinct("best_alternative") == 1).alias("one"), F.min(F.signum("edge_bps")).alias("lo"), F.max(F.signum("edge_bps")).alias("hi"),
    )
    sums = sums.select("edge_min_bps", "edge_max_bps", "sign_flips", r8("breakeven").alias("breakeven_coef_bps"), (F.col("one") & (F.col("lo") == F.col("hi")) & (F.col("lo") != 0)).alias("verdict_stable"))
    return points.drop("next_coef", "next_edge").crossJoin(F.broadcast(sums))
