"""Two-term impact: cost = coef * sqrt(p) + perm * p.  Curves, calibration and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import named, product_of, r8


def impact_curve(slices: DataFrame, coef_bps: float, perm_coef_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    if not keys and slices.isEmpty():
        raise ValueError("no impact slices")
    cost, perm = F.sqrt("participation") * coef_bps, F.col("participation") * perm_coef_bps
    return slices.groupBy(*keys).agg(
        *product_of(slices), F.count(F.lit(1)).alias("slices"), F.lit(float(coef_bps)).alias("coef_bps"), F.lit(float(perm_coef_bps)).alias("perm_coef_bps"),
        r8(F.avg(cost)).alias("avg_impact_bps"), r8(F.max(cost)).alias("max_impact_bps"), r8(F.sum(cost)).alias("total_impact_bps"),
        r8(F.avg(perm)).alias("avg_perm_impact_bps"), r8(F.sum(perm)).alias("total_perm_impact_bps"), r8(F.sum(cost) + F.sum(perm)).alias("total_cost_bps"),
    )


def _fit(samples: DataFrame, weight, ridge: float, keys: list[str]) -> DataFrame:
    """keys, coef, perm, n, rmse, r2: weighted normal equations in one aggregate; the fit's quality is unweighted."""
    p, y, w = F.col("participation"), F.col("realised_bps"), weight
    s = F.sqrt(p)
    sums = samples.groupBy(*keys).agg(
        *product_of(samples), F.count(F.lit(1)).alias("n"), (F.sum(w * p) + ridge).alias("s11"), F.sum(w * s * p).alias("s12"), (F.sum(w * p * p) + ridge).alias("s22"),
        F.sum(w * s * y).alias("b1"), F.sum(w * p * y).alias("b2"), F.sum(p).alias("u11"), F.sum(s * p).alias("u12"), F.sum(p * p).alias("u22"), F.sum(s * y).alias("v1"),
        F.sum(p * y).alias("v2"), F.sum(y * y).alias("yy"), F.sum(y).alias("y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    flat = F.abs(det) <= 1e-12 * F.col("s11") * F.col("s22")
    out = sums.withColumn("det", F.when(flat, F.raise_error(F.lit("singular design: participation does not vary")).cast("double")).otherwise(det))
    out = out.withColumn("coef", (F.col("s22") * F.col("b1") - F.col("s12") * F.col("b2")) / F.col("det")).withColumn("perm", (F.col("s11") * F.col("b2") - F.col("s12") * F.col("b1")) / F.col("det"))
    c, k = F.col("coef"), F.col("perm")
    res = F.greatest(F.lit(0.0), F.col("yy") - 2 * (c * F.col("v1") + k * F.col("v2")) + c * c * F.col("u11") + 2 * c * k * F.col("u12") + k * k * F.col("u22"))
    tot = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    return out.select(*keys, *named(out), "coef", "perm", "n", F.sqrt(res / F.col("n")).alias("rmse"), F.when(tot == 0, 0.0).otherwise(1 - res / tot).alias("r2"))


def _report(fit: DataFrame, keys: list[str]) -> DataFrame:
    return fit.select(*keys, *named(fit), F.col("n").alias("samples"), r8("coef").alias("coef_bps"), r8("perm").alias("perm_coef_bps"), r8("rmse").alias("rmse_bps"), r8("r2").alias("r_squared"))


def calibrate_impact(samples: DataFrame, keys: list[str] = []) -> DataFrame:
    """Least squares through the origin on sqrt(p) and p; one pass."""
    return _report(_fit(samples, F.lit(1.0), 0.0, keys), keys)


def calibrate_impact_robust(samples: DataFrame, huber_delta: float | None = None, ridge_lambda: float = 0.0, max_iters: int = 8, keys: list[str] = []) -> DataFrame:
    """Huber weights by max_iters reweighted passes (one without huber_delta), and a ridge on both sums of squares.

    Each pass is one aggregate whose few results are carried to the rows as constants (or, with keys, by a join).
    """
    if huber_delta is not None and not huber_delta > 0:
        raise ValueError("huber_delta must be positive")
    if ridge_lambda < 0:
        raise ValueError("ridge_lambda must be >= 0")
    if max_iters < 1:
        raise ValueError("max_iters must be >= 1")
    p, y, rows, weight = F.col("participation"), F.col("realised_bps"), samples, F.lit(1.0)
    fit = _fit(rows, weight, ridge_lambda, keys)
    for _ in range(max_iters - 1 if huber_delta is not None else 0):
        if keys:
            rows = samples.join(fit.select(*keys, "coef", "perm"), keys)
            c, k = F.col("coef"), F.col("perm")
        else:
            found = fit.first()
            c, k = F.lit(found["coef"]), F.lit(found["perm"])
        r = F.abs(y - c * F.sqrt(p) - k * p)
        weight = F.when(r <= huber_delta, 1.0).otherwise(F.lit(float(huber_delta)) / r)
        fit = _fit(rows, weight, ridge_lambda, keys)
    return _report(fit, keys)


def optimal_schedules(orders: DataFrame, slices: int, coef_bps: float, perm_coef_bps: float = 0.0, keys: list[str] = []) -> DataFrame:
    """For each order the schedule of least impact plus risk among exponential ones of urgency 0.0 to 4.0: one row per slice, totals repeated.

    orders: keys (which tell them apart), total_size, per_slice_volume, sigma_bps.  An order is worked out by itself, over 41 urgencies times its
    slices; the grid of weights is the same for all and small.  ValueError by Spark where even slices take more than the volume.
    """
    if slices < 1 or min(coef_bps, perm_coef_bps) < 0:
        raise ValueError("slices must be positive, coefficients not negative")
    spark, n = orders.sparkSession, slices
    weights = spark.range(41).select((F.col("id") / 10.0).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"))
    w = Window.partitionBy("k")
    weights = weights.withColumn("raw", F.exp(-F.col("k") * F.col("slice") / n)).withColumn("weight", F.col("raw") / F.sum("raw").over(w))
    weights = weights.withColumn("remaining", 1 - F.sum("weight").over(w.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))).drop("raw")
    # what an order of unit participation costs at each urgency: an order's own figures only scale it
    unit = weights.groupBy("k").agg(
        F.sum(F.pow("weight", F.lit(1.5))).alias("temp1"), F.sum(F.col("weight") ** 2).alias("perm1"), F.sqrt(F.sum(F.col("remaining") ** 2) / n).alias("risk1"), F.max("weight").alias("most1")
    )
    load = F.col("total_size") / F.col("per_slice_volume")
    sums = orders.withColumn("load", load).crossJoin(F.broadcast(unit))  # 41 rows
    sums = sums.withColumn("impact", F.sqrt("load") * coef_bps * F.col("temp1") + F.col("load") * perm_coef_bps * F.col("perm1")).withColumn("risk", F.col("sigma_bps") * F.col("risk1"))
    sums = sums.withColumn("total", F.col("impact") + F.col("risk")).withColumn("most", F.col("load") * F.col("most1"))
    even = lambda c: F.max(F.when(F.col("k") == 0, F.col(c)))
    best = sums.groupBy(*keys, "total_size", "per_slice_volume").agg(
        F.min_by(F.struct("k", "impact", "risk", "total"), F.when(F.col("most") <= 1, F.struct(r8("total"), F.col("k")))).alias("b"),
        F.when(even("most") > 1, F.raise_error(F.lit("even slices take more than the volume")).cast("double")).otherwise(even("impact")).alias("t_impact"), even("risk").alias("t_risk"), even("total").alias("t_total"),
    )
    out = best.select(*keys, "total_size", "per_slice_volume", "b.*", "t_impact", "t_risk", "t_total").join(F.broadcast(weights), "k")
    out = out.withColumn("size", F.col("weight") * F.col("total_size")).withColumn("participation", F.col("size") / F.col("per_slice_volume"))
    return out.select(
        *keys, F.col("k").alias("urgency"), r8("impact").alias("impact_bps"), r8("risk").alias("risk_bps"), r8("total").alias("total_bps"), r8("t_impact").alias("twap_impact_bps"), r8("t_risk").alias("twap_risk_bps"),
        r8("t_total").alias("twap_total_bps"), r8(F.col("t_total") - F.col("total")).alias("saving_bps"), "slice", r8("weight").alias("weight"), r8("size").alias("size"),
        r8("participation").alias("participation"), r8(F.sqrt("participation") * coef_bps * F.col("weight")).alias("temp_bps"), r8(F.col("participation") * perm_coef_bps * F.col("weight")).alias("perm_bps"), r8("remaining").alias("remaining"),
    )


def optimal_schedule(
    spark: SparkSession, slices: int, total_size: float, per_slice_volume: float, coef_bps: float, perm_coef_bps: float = 0.0, sigma_bps: float = 0.0
) -> DataFrame:
    """optimal_schedules() of one order."""
    if not total_size > 0 or not per_slice_volume > 0 or sigma_bps < 0:
        raise ValueError("slices, total_size and per_slice_volume must be positive, coefficients not negative")
    order = spark.range(1).select(F.lit(float(total_size)).alias("total_size"), F.lit(float(per_slice_volume)).alias("per_slice_volume"), F.lit(float(sigma_bps)).alias("sigma_bps"))
    return optimal_schedules(order, slices, coef_bps, perm_coef_bps)
