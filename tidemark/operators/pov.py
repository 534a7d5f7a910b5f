"""Volume-following plans: schedules, and plans priced on a session under a participation cap.

A plan row has the columns of its scenario, a plan's share of the parent in each slot, and the executed session's
volume and VWAP there.  Any number of scenarios is priced by windows over one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import r8, require, safe_div
from tidemark.operators.ticks import profile


def check_order(bucket_ns: int, parent_qty: float | None, caps: list[float], coef_bps: float, perm_coef_bps: float) -> None:
    if bucket_ns < 1:
        raise ValueError("bucket_ns must be >= 1")
    if parent_qty is not None and not 0 < parent_qty < float("inf"):
        raise ValueError("parent_qty must be finite and positive")
    if any(not 0 < c <= 1 for c in caps):
        raise ValueError("cap must be in (0, 1]")
    if not (0 <= coef_bps < float("inf") and 0 <= perm_coef_bps < float("inf")):
        raise ValueError("coefficients must be finite and >= 0")


def measured(ticks: DataFrame, bucket_ns: int, keys: list[str]) -> DataFrame:
    """profile() of sessions that can be planned on: every bucket traded."""
    out = profile(ticks, bucket_ns, keys)
    bad = F.raise_error(F.concat(F.lit("bucket "), F.col("bucket_ns").cast("string"), F.lit(" traded no volume and cannot be priced"))).cast("double")
    return out.withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")).otherwise(bad))


def pov_schedule(ticks: DataFrame, bucket_ns: int, parent_qty: float, cap: float, coef_bps: float, perm_coef_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """One row per bucket of the plan that takes a constant part of the volume; the session's totals and the TWAP twin's repeat."""
    check_order(bucket_ns, parent_qty, [cap], coef_bps, perm_coef_bps)
    q, c, k = float(parent_qty), float(coef_bps), float(perm_coef_bps)
    rows = measured(ticks, bucket_ns, keys).withColumn("p", q / F.col("total"))
    rows = rows.withColumn("p", F.when(F.col("p") > cap, F.raise_error(F.lit("the order needs more than the cap's participation")).cast("double")).otherwise(F.col("p")))
    rows = rows.withColumn("temp", F.col("share") * c * F.sqrt("p")).withColumn("perm", F.col("share") * k * F.col("p")).withColumn("tp", q / F.col("slots") / F.col("volume"))
    # a session's totals by windows over the slots that its profile has brought together already
    w = Window.partitionBy(*keys)
    every = lambda f: f.over(w)
    totals = {
        "pov_price": every(F.sum(F.col("share") * F.col("vwap"))), "pov_impact": every(F.sum("temp")) + every(F.sum("perm")), "twap_price": every(F.avg("vwap")),
        "twap_impact": every(F.avg(F.sqrt("tp") * c)) + every(F.avg(F.col("tp") * k)), "twap_max": every(F.max("tp")),
        "session_vwap": r8(every(F.sum(F.col("vwap") * F.col("volume"))) / F.col("total")),
    }
    rows = rows.select("*", *[v.alias(name) for name, v in totals.items()])
    off = lambda x: r8((F.col(x) - F.col("session_vwap")) / F.col("session_vwap") * 1e4)
    return rows.select(
        *keys, "slots", r8("total").alias("total_volume"), r8("p").alias("participation"), "session_vwap", r8("pov_price").alias("pov_price"), off("pov_price").alias("pov_tracking_bps"), r8("pov_impact").alias("pov_impact_bps"),
        r8("twap_price").alias("twap_price"), off("twap_price").alias("twap_tracking_bps"), r8("twap_impact").alias("twap_impact_bps"), r8("twap_max").alias("twap_max_participation"),
        (r8("twap_max") <= r8(F.lit(float(cap)))).alias("twap_feasible"), r8(F.col("twap_impact") - F.col("pov_impact")).alias("edge_bps"),
        "bucket_ns", r8("volume").alias("volume"), r8("share").alias("volume_share"), r8("vwap").alias("vwap"), r8(F.col("share") * q).alias("size"), r8("temp").alias("temp_bps"), r8("perm").alias("perm_bps"),
    )


def plan_slots(plans: DataFrame, scenario: list[str], coef_bps: float, perm_coef_bps: float = 0.0, near: list[str] = []) -> DataFrame:
    """One row per scenario and slot: the columns of plans, with size, participation, temp_bps, perm_bps of the plan as it is, and what
    each arm trades there under the cap: capped_size (what a slot can't take is carried to the next; carry is what is left then) and
    spread_size (the plan reshaped to fit).

    plans has the scenario columns, slot, plan_share, exec_share, volume, vwap, session_vwap, parent_qty and cap.  Rows are dealt once, by
    near (some of the scenario's columns) or the scenario; everything after that is windows over sorted slots, linear in them.
    """
    c, k = float(coef_bps), float(perm_coef_bps)
    rows = plans.repartition(*[F.col(x) for x in near or scenario])
    whole = Window.partitionBy(*scenario)
    room = F.col("cap") * F.col("volume")
    rows = rows.withColumn("size", F.col("plan_share") * F.col("parent_qty")).withColumn("participation", F.col("size") / F.col("volume"))
    rows = rows.withColumn("temp_bps", F.col("plan_share") * c * F.sqrt("participation")).withColumn("perm_bps", F.col("plan_share") * k * F.col("participation"))
    # carrying: what waits after a slot is the walk of wants less rooms above its least so far
    past = whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("walk", F.sum(F.col("size") - room).over(past))
    rows = rows.withColumn("carry", F.col("walk") - F.least(F.lit(0.0), F.min("walk").over(past)))
    rows = rows.withColumn("want", F.col("size") + F.coalesce(F.lag("carry").over(whole.orderBy("slot")), F.lit(0.0)))
    rows = rows.withColumn("capped_size", F.col("want") - F.col("carry"))
    # reshaping: in order of room per share, slots are pinned at the cap until scaling the rest fits
    rows = rows.withColumn("ratio", F.when(F.col("plan_share") > 0, room / F.col("plan_share")).otherwise(float("inf")))
    order = whole.orderBy("ratio", "slot")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("scale", safe_div(F.col("parent_qty") - F.coalesce(F.sum(room).over(before), F.lit(0.0)), F.sum("plan_share").over(after)))
    rows = rows.withColumn("fits", F.col("scale") * F.col("plan_share") <= room)
    rows = rows.withColumn("free", F.coalesce(F.max("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.withColumn("scaled", F.first(F.when(F.col("fits"), F.col("scale")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("spread_size", F.when(F.col("plan_share") <= 0, 0.0).when(F.col("free"), F.col("scaled") * F.col("plan_share")).otherwise(room))
    return rows.withColumn("pinned", ~F.col("free")).drop("walk", "ratio", "scale", "fits", "free")


def price_plans(plans: DataFrame, scenario: list[str], coef_bps: float, perm_coef_bps: float = 0.0, near: list[str] = []) -> DataFrame:
    """One row per scenario: the plan's score as it is, and executed under the cap by carrying (capped_) and by reshaping (spread_).

    plans and near are those of plan_slots().
    """
    c, k = float(coef_bps), float(perm_coef_bps)
    rows = plan_slots(plans, scenario, coef_bps, perm_coef_bps, near)
    impact = lambda x: F.sum(x / F.col("parent_qty") * (c * F.sqrt(x / F.col("volume")) + k * x / F.col("volume")))
    capped, spread = F.col("capped_size"), F.col("spread_size")
    sums = rows.groupBy(*scenario).agg(
        F.sum(F.col("plan_share") * F.col("vwap")).alias("price"), (F.sum("temp_bps") + F.sum("perm_bps")).alias("impact"), F.max("participation").alias("most"),
        (F.sum(F.abs(F.col("plan_share") - F.col("exec_share"))) / 2).alias("distance"), F.first("session_vwap").alias("session"), F.first("parent_qty").alias("q"), F.first("cap").alias("limit"),
        F.sum("volume").alias("traded"), F.count(F.lit(1)).alias("slots"),
        F.sum(capped).alias("c_filled"), F.max_by("carry", "slot").alias("c_left"), F.sum(capped * F.col("vwap")).alias("c_pv"), impact(capped).alias("c_impact"), F.max(capped / F.col("volume")).alias("c_most"),
        F.count(F.when(F.col("carry") > 0, 1)).alias("c_slots"),
        F.sum(spread).alias("s_filled"), F.when(F.max("scaled").isNull(), F.first("parent_qty") - F.sum(spread)).otherwise(0.0).alias("s_left"), F.sum(spread * F.col("vwap")).alias("s_pv"), impact(spread).alias("s_impact"),
        F.max(spread / F.col("volume")).alias("s_most"), F.count(F.when(F.col("pinned"), 1)).alias("s_slots"),
    )
    oracle_p = F.col("q") / F.col("traded")
    oracle = c * F.sqrt(oracle_p) + k * oracle_p
    track = lambda x: r8((x - F.col("session")) / F.col("session") * 1e4)

    def arm(a: str, name: str) -> list[Column]:
        price = safe_div(f"{a}_pv", f"{a}_filled")
        return [
            r8(f"{a}_filled").alias(f"{name}_filled_qty"), r8(f"{a}_left").alias(f"{name}_unfilled_qty"), (r8(f"{a}_left") == 0).alias(f"{name}_completed"), F.col(f"{a}_slots").alias(f"{name}_capped_slots"),
            r8(price).alias(f"{name}_price"), track(price).alias(f"{name}_tracking_bps"), r8(f"{a}_impact").alias(f"{name}_impact_bps"),
            r8(safe_div(F.col(f"{a}_impact") * F.col("q"), F.col(f"{a}_filled"))).alias(f"{name}_filled_impact_bps"), r8(f"{a}_most").alias(f"{name}_max_participation"),
        ]

    return sums.select(
        *scenario, F.col("q").alias("parent_qty"), F.col("limit").alias("plan_cap"), "slots", r8("traded").alias("exec_volume"), r8("distance").alias("profile_distance"), r8("session").alias("session_vwap"),
        r8("price").alias("price"), track(F.col("price")).alias("tracking_bps"),
        r8("impact").alias("impact_bps"), r8("most").alias("max_participation"), (r8("most") <= r8("limit")).alias("feasible"), r8(F.col("impact") - oracle).alias("forecast_cost_bps"),
        r8(oracle_p).alias("oracle_participation"), r8(oracle).alias("oracle_impact_bps"), (r8(oracle_p) <= r8("limit")).alias("oracle_feasible"), *arm("c", "capped"), *arm("s", "spread"),
    )


def _same_slots(a: DataFrame, b: DataFrame, message: str) -> None:
    odd = a.select("slot").exceptAll(b.select("slot")).unionByName(b.select("slot").exceptAll(a.select("slot")))
    if not odd.isEmpty():
        raise ValueError(message)


def pov_backtest(plan_ticks: DataFrame, exec_ticks: DataFrame, bucket_ns: int, parent_qty: float, cap: float, coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """The plan of one session's volume profile, priced on another session: one row, as price_plans()."""
    check_order(bucket_ns, parent_qty, [cap], coef_bps, perm_coef_bps)
    for name, t in (("plan", plan_ticks), ("execution", exec_ticks)):
        if t.isEmpty():
            raise ValueError(f"{name} capture: no ticks")
    products = [t.agg(F.min_by("product", "ts_ns")).first()[0] for t in (plan_ticks, exec_ticks)]
    if products[0] != products[1]:
        raise ValueError(f"captures are of different products: {products[0]} and {products[1]}")
    plan, done = measured(plan_ticks, bucket_ns, []), measured(exec_ticks, bucket_ns, [])
    _same_slots(plan, done, "captures trade in different slots")
    rows = done.join(plan.select("slot", F.col("share").alias("plan_share")), "slot").withColumnRenamed("share", "exec_share")
    whole = F.lit(exec_ticks.agg(F.sum(F.col("price") * F.col("size")) / F.sum("size")).first()[0])
    rows = rows.withColumn("session_vwap", r8(whole)).withColumn("parent_qty", F.lit(float(parent_qty))).withColumn("cap", F.lit(float(cap))).withColumn("one", F.lit(1))
    return price_plans(rows, ["one"], coef_bps, perm_coef_bps).drop("one")


def gains(arm: str) -> list[Column]:
    """improvement, shortfall, like_for_like and breakeven of a forecast over a naive plan, from their reported (rounded) figures; those of the
    naive plan are columns whose names start with naive_."""
    imp = r8(F.col(f"naive_{arm}_filled_impact_bps") - F.col(f"{arm}_filled_impact_bps"))
    short = r8(F.col(f"{arm}_unfilled_qty") - F.col(f"naive_{arm}_unfilled_qty"))
    even = r8(safe_div(imp * F.col("parent_qty"), short))
    return [imp.alias("improvement_bps"), short.alias("shortfall_qty"), (short == 0).alias("like_for_like"), F.when(even > 0, even).alias("breakeven_bps")]
