"""Scenario studies: caps, half-lives, folds, windows and shares as tables beside the data, priced in one plan.

Profiles are measured once and written: a row per session and slot.  A study is a table of folds, each an input session and a run of
sessions that it is forecast from, made by Spark from the number of sessions.  A history is never unfolded into its members: windows over the
sessions of a slot keep decayed running sums S(i) = share(i - 1) + d S(i - 1), and the pooled share of sessions h..i is a difference of two of
them, S(i) - d^(i - h) S(h).  So a study costs a row for each fold and slot, however long the histories are.  Parameter grids are unfolded
from the call's arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bucket_of, check_grid, r8, safe_div
from tidemark.operators.pov import check_order, gains, plan_slots, price_plans
from tidemark.storage import written

#: A running sum's weights may fall by this power of two before it starts afresh; what is older has no bit left in a double.
_FADES = 900
_SCENARIO, _NEAR = ["fold", "cap", "parent_share", "half_life", "plan"], ["fold", "cap", "parent_share"]


def profiles(ticks: DataFrame, key: str, sessions: list, bucket_ns: int) -> DataFrame:
    """idx (place in sessions), slot, bucket_ns, volume, vwap, share, total, slots, session_vwap, first_ts, last_ts, product and last_product of the
    named sessions, as a written table; one read of the ticks."""
    spark = ticks.sparkSession
    kind = ticks.schema[key].dataType.simpleString()
    places = spark.createDataFrame([(s, i) for i, s in enumerate(sessions)], f"{key} {kind}, idx int")
    made = ticks.join(F.broadcast(places), key).groupBy("idx", bucket_of("ts_ns", bucket_ns).alias("bucket_ns")).agg(
        F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("pv"), F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"), F.min("product").alias("p"), F.max("product").alias("q")
    )
    w = Window.partitionBy("idx")
    bad = F.raise_error(F.concat(F.lit("bucket "), F.col("bucket_ns").cast("string"), F.lit(" traded no volume and cannot be priced"))).cast("double")
    made = made.withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")).otherwise(bad))
    return written(
        made.select(
            "idx", F.expr(f"(bucket_ns - min(bucket_ns) over (partition by idx)) div {bucket_ns}").alias("slot"), "bucket_ns", "volume", (F.col("pv") / F.col("volume")).alias("vwap"),
            (F.col("volume") / F.sum("volume").over(w)).alias("share"), F.sum("volume").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("slots"), r8(F.sum("pv").over(w) / F.sum("volume").over(w)).alias("session_vwap"),
            F.min("a").over(w).alias("first_ts"), F.max("b").over(w).alias("last_ts"), F.min("p").over(w).alias("product"), F.max("q").over(w).alias("last_product"),
        ),
        "profiles",
    )


def _check(prof: DataFrame, n: int, ordered: bool) -> dict:
    """Refuse sessions that can't be compared; product and buckets of those that can.  One row comes to the driver."""
    per = prof.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("slot")).alias("h"), F.first("first_ts").alias("a"), F.first("last_ts").alias("b"), F.first("product").alias("p"), F.first("last_product").alias("q")
    )
    per = per.withColumn("before", F.lag("b").over(Window.orderBy("idx")))  # a row per session
    row = per.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("n", "h").alias("shapes"), F.count(F.when(F.col("a") <= F.col("before"), 1)).alias("overlaps"), F.min("p").alias("p"), F.max("q").alias("q"), F.first("n").alias("slots")
    ).first()
    if row["sessions"] < n:
        missing = sorted(set(range(n)) - {r["idx"] for r in prof.select("idx").distinct().collect()})  # a row per session
        raise ValueError(f"history capture {missing[0] + 1}: no ticks")
    if row["p"] != row["q"]:
        raise ValueError(f"captures are of different products: {row['p']} and {row['q']}")
    if row["shapes"] > 1:
        raise ValueError("captures trade in different slots")
    if ordered and row["overlaps"]:
        raise ValueError("sessions must be in time order and not overlap")
    return {"product": row["p"], "buckets": row["slots"]}


def _headed(out: DataFrame, head: dict) -> DataFrame:
    """What is the same for the whole report, as columns before its rows."""
    kind = lambda k, v: "long" if isinstance(v, int) or k == "window" else "string" if isinstance(v, str) else "double"
    return out.select(*[F.lit(v).cast(kind(k, v)).alias(k) for k, v in head.items()], "*")


def _pools(prof: DataFrame, half_lives: list[float], sessions: int) -> DataFrame:
    """prof with what folds are pooled from: newer (the share one session earlier), totals (the sum of totals so far), and for each half-life k
    before_k and run_k, the decayed sums of the shares before the session and up to it.

    Within blocks of _FADES half-lives the sums are prefix sums of scaled shares; a block takes over the sum at the end of the one before.
    """
    w = Window.partitionBy("slot").orderBy("idx")
    rows = prof
    runs = []
    for k, h in enumerate(half_lives):
        decay = 1.0 if h == 0 else 0.5 ** (1.0 / h)
        span = sessions if h == 0 else max(1, min(sessions, int(_FADES * h)))
        power = lambda n, d=decay: F.pow(F.lit(d), n)
        if span >= sessions:
            run = power(F.col("idx")) * F.sum(F.col("share") * power(-F.col("idx"))).over(w)
        else:
            block, at, local = F.expr(f"idx div {span}"), F.col("idx") % span, f"local_{k}"
            rows = rows.withColumn("block_", block).withColumn(local, power(at) * F.sum(F.col("share") * power(-at)).over(Window.partitionBy("slot", "block_").orderBy("idx")))
            ended = F.max(F.when(at == span - 1, F.struct(block.alias("block"), F.col(local).alias("local")))).over(w.rowsBetween(Window.unboundedPreceding, -1))["local"]
            run = F.col(local) + F.coalesce(power(at + 1) * ended, F.lit(0.0))
        runs.append(run.alias(f"run_{k}"))
    # all sums by one pass over the windows, and what stood before them by one more
    rows = rows.select("*", F.lag("share").over(w).alias("newer"), F.sum("total").over(w).alias("totals"), *runs)
    return rows.select("*", *[F.coalesce(F.lag(f"run_{k}").over(w), F.lit(0.0)).alias(f"before_{k}") for k in range(len(half_lives))])


def fold_plans(
    prof: DataFrame, folds: DataFrame, sessions: int, caps: list[float], half_lives: list[float], parent_qty: float | None = None, parent_shares: list[float] | None = None, windows: bool = False
) -> DataFrame:
    """A row per scenario and slot: fold, input, cap, parent_share (null with a quantity), half_life, plan, and the columns that plan_slots() prices.

    folds: fold, input, lo, hi: the history is sessions lo..hi - 1 without the input.  windows: some lo is above 0.
    plan is 'forecast', from the history pooled with weights halved every half_life sessions (0: equal), or 'naive', the newest session's (its half_life is -1).
    """
    pools = _pools(prof, half_lives, sessions)
    sums = [c for k in range(len(half_lives)) for c in (f"run_{k}", f"before_{k}")]
    named = lambda tag, columns: [F.col(c).alias(f"{tag}_{c}") for c in columns]
    ends = pools.select((F.col("idx") + 1).alias("hi"), "slot", *named("hi", ["share", "newer", "totals", *sums]))
    own = pools.select(F.col("idx").alias("input"), "slot", "bucket_ns", "volume", "vwap", "session_vwap", *named("in", ["share", "total", *sums]))
    rows = folds.join(own, "input").join(ends, ["hi", "slot"])
    lo = {c: F.lit(0.0) for c in ("totals", *sums)}
    if windows:
        starts = pools.select((F.col("idx") + 1).alias("lo"), "slot", *named("lo", ["totals", *sums]))
        rows = rows.join(starts, ["lo", "slot"], "left")
        lo = {c: F.coalesce(f"lo_{c}", F.lit(0.0)) for c in lo}

    # a session held out of its own history: those before it are one session nearer to the end
    inside = (F.col("input") >= F.col("lo")) & (F.col("input") < F.col("hi"))
    members = F.col("hi") - F.col("lo") - inside.cast("int")

    def pooled(k: int, h: float) -> Column:
        decay = 1.0 if h == 0 else 0.5 ** (1.0 / h)
        power = lambda n: F.pow(F.lit(decay), n)
        whole = F.col(f"hi_run_{k}") - power(F.col("hi") - F.col("lo")) * lo[f"run_{k}"]
        gone = power(F.col("hi") - 1 - F.col("input")) * (F.col(f"in_run_{k}") - F.col(f"in_before_{k}"))
        # sessions before lo in the input's own sums, too
        gone = gone - (power(F.col("hi") - F.col("lo")) - power(F.col("hi") - F.col("lo") - 1)) * lo[f"run_{k}"] if windows else gone
        weights = members if decay == 1.0 else (1 - power(members)) / (1 - decay)
        return F.when(inside, whole - gone).otherwise(whole) / weights

    newest = F.when(inside & (F.col("input") == F.col("hi") - 1), F.col("hi_newer")).otherwise(F.col("hi_share"))
    plans = [F.struct(F.lit("naive").alias("plan"), F.lit(-1.0).alias("half_life"), newest.alias("plan_share"))]
    plans += [F.struct(F.lit("forecast").alias("plan"), F.lit(float(h)).alias("half_life"), pooled(k, float(h)).alias("plan_share")) for k, h in enumerate(half_lives)]
    mean = (F.col("hi_totals") - lo["totals"] - F.when(inside, F.col("in_total")).otherwise(0.0)) / members
    shares = [F.lit(None).cast("double")] if parent_shares is None else [F.lit(float(x)) for x in parent_shares]
    rows = rows.withColumn("mean", mean).withColumn("one", F.explode(F.array(*plans))).withColumn("cap", F.explode(F.array(*[F.lit(float(c)) for c in caps]))).withColumn("parent_share", F.explode(F.array(*shares)))
    qty = F.lit(float(parent_qty)) if parent_shares is None else F.col("parent_share") * F.col("mean")
    return rows.select("fold", "input", "cap", "parent_share", "one.*", "slot", "bucket_ns", "volume", "vwap", F.col("in_share").alias("exec_share"), "session_vwap", qty.alias("parent_qty"))


def score_folds(
    prof: DataFrame, folds: DataFrame, sessions: int, caps: list[float], half_lives: list[float], coef_bps: float, perm_coef_bps: float, parent_qty: float | None = None,
    parent_shares: list[float] | None = None, windows: bool = False,
) -> DataFrame:
    """fold, cap, parent_share, half_life, plan and the columns of price_plans()."""
    return price_plans(fold_plans(prof, folds, sessions, caps, half_lives, parent_qty, parent_shares, windows), _SCENARIO, coef_bps, perm_coef_bps, _NEAR)


def gain_rows(scored: DataFrame, arm: str = "capped") -> DataFrame:
    """fold, cap, parent_share, half_life, parent_qty, forecast_unfilled_qty, naive_unfilled_qty, improvement_bps, shortfall_qty, like_for_like, breakeven_bps."""
    w = Window.partitionBy(*_NEAR)
    naive = [F.max(F.when(F.col("plan") == "naive", F.col(f"{arm}_{c}"))).over(w).alias(f"naive_{arm}_{c}") for c in ("filled_impact_bps", "unfilled_qty")]
    met = scored.select("*", *naive).where("plan = 'forecast'")
    return met.select(*_NEAR, "half_life", "parent_qty", F.col(f"{arm}_unfilled_qty").alias("forecast_unfilled_qty"), F.col(f"naive_{arm}_unfilled_qty").alias("naive_unfilled_qty"), *gains(arm))


def cell_rows(gained: DataFrame) -> DataFrame:
    """fold, cap, parent_share: flat and span of the improvement over half-lives, the improvement at each, sign_stable, inert, verdict."""
    x, flat = F.col("improvement_bps"), F.col("half_life") == 0
    moved = F.when(~flat, x)
    out = gained.groupBy(*_NEAR).agg(
        F.first("parent_qty").alias("parent_qty"), F.max(F.when(flat, x)).alias("flat_improvement_bps"), F.min(moved).alias("improvement_min_bps"), F.max(moved).alias("improvement_max_bps"),
        F.array_sort(F.collect_list(F.when(~flat, F.struct("half_life", "improvement_bps")))).alias("points"),
    )
    lo, hi, f = F.col("improvement_min_bps"), F.col("improvement_max_bps"), F.col("flat_improvement_bps")
    out = out.withColumn("improvement_span_bps", r8(hi - lo)).withColumn("sign_stable", ~((hi > 0) & (lo < 0))).withColumn("inert", (f == 0) & (hi == 0) & (lo == 0))
    verdict = F.when(F.col("inert"), "inert").when(~F.col("sign_stable"), "unstable").when(hi > 0, "gain").when(lo < 0, "loss").when(f > 0, "gain").otherwise("loss")
    return out.withColumn("verdict", verdict)


def _counts(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells with how many of a study's caps are inert, stable and unstable."""
    w = Window.partitionBy(*by)
    count = lambda c: F.count(F.when(c, 1)).over(w)
    inert, stable = F.col("inert"), F.col("sign_stable")
    return cells.withColumn("inert_caps", count(inert)).withColumn("stable_caps", count(stable & ~inert)).withColumn("unstable_caps", count(~stable))


def _study(
    ticks: DataFrame, key: str, sessions: list, bucket_ns: int, caps: list[float], coef_bps: float, perm_coef_bps: float, parent_qty: float | None, least: int, ordered: bool = False
) -> tuple[DataFrame, dict]:
    """Profiles, and what heads the report."""
    check_order(bucket_ns, parent_qty, caps, coef_bps, perm_coef_bps)
    if len(sessions) < least:
        raise ValueError(f"need at least {least} sessions")
    prof = profiles(ticks, key, sessions, bucket_ns)
    seen = _check(prof, len(sessions), ordered)
    return prof, {"product": seen["product"], "bucket_ns": bucket_ns, "buckets": seen["buckets"], "sessions": len(sessions), "coef_bps": float(coef_bps), "perm_coef_bps": float(perm_coef_bps)}


def _check_forecast(half_life: float, shortfall_bps: float | None) -> None:
    if half_life < 0:
        raise ValueError("half_life must be >= 0")
    if shortfall_bps is not None and not 0 <= shortfall_bps < float("inf"):
        raise ValueError("shortfall_bps must be finite and >= 0")


def _folds(spark: SparkSession, first: int, n: int, lo: str, hi: str) -> DataFrame:
    """A fold for each session from `first` to n - 1, named by it."""
    return spark.range(first, n).selectExpr("cast(id as int) as fold", "cast(id as int) as input", f"cast({lo} as int) as lo", f"cast({hi} as int) as hi")


def _one_fold(spark: SparkSession, history: list) -> DataFrame:
    return _folds(spark, len(history), len(history) + 1, "0", "id")


def backtests(ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float, caps: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """Each session's profile as the plan for the next: input, cap and the columns of price_plans(), a row per pair and cap."""
    prof, head = _study(ticks, key, sessions, bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 2)
    pairs = _folds(ticks.sparkSession, 1, len(sessions), "id - 1", "id")
    scored = score_folds(prof, pairs, len(sessions), caps, [], coef_bps, perm_coef_bps, parent_qty)
    return _headed(scored.select(F.col("fold").alias("input"), "cap", *[c for c in scored.columns if c not in (*_SCENARIO, "plan_cap")]), head)


def backtest_slots(ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float, caps: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """The schedule and both arms' sizes of backtests(): a row per pair, cap and slot."""
    prof, _ = _study(ticks, key, sessions, bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 2)
    rows = plan_slots(fold_plans(prof, _folds(ticks.sparkSession, 1, len(sessions), "id - 1", "id"), len(sessions), caps, [], parent_qty), _SCENARIO, coef_bps, perm_coef_bps, _NEAR)
    return rows.select("input", "cap", *_slot_columns())


def _slot_columns() -> list[Column]:
    names = {"volume": "volume", "exec_share": "volume_share", "vwap": "vwap", "plan_share": "plan_share", "size": "size", "participation": "participation", "temp_bps": "temp_bps", "perm_bps": "perm_bps", "capped_size": "capped_size", "spread_size": "spread_size"}
    return [F.col("slot"), F.col("bucket_ns"), *[r8(a).alias(b) for a, b in names.items()]]


def pov_forecast(
    ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap: float, coef_bps: float, perm_coef_bps: float = 0.0, half_life: float = 0.0,
    shortfall_bps: float | None = None, half_life_defaulted: bool = False,
) -> DataFrame:
    """The pooled forecast and the newest session's profile as plans for a further session: one row per plan, gains of both arms repeated."""
    _check_forecast(half_life, shortfall_bps)
    prof, head = _study(ticks, key, [*history, execution], bucket_ns, [cap], coef_bps, perm_coef_bps, parent_qty, 2)
    head |= {"sessions": len(history), "half_life": float(half_life), "shortfall_bps": shortfall_bps if shortfall_bps is None else float(shortfall_bps)}
    scored = score_folds(prof, _one_fold(ticks.sparkSession, history), len(history) + 1, [cap], [half_life], coef_bps, perm_coef_bps, parent_qty)
    w = Window.partitionBy(*_NEAR)
    by = lambda plan, c: F.max(F.when(F.col("plan") == plan, F.col(c))).over(w)
    # the figures of both plans beside each other, on both rows
    figures = [f"{arm}_{c}" for arm in ("capped", "spread") for c in ("filled_impact_bps", "unfilled_qty")]
    out = scored.select("*", *[by("forecast", c).alias(f"f_{c}") for c in figures], *[by("naive", c).alias(f"n_{c}") for c in figures], by("forecast", "impact_bps").alias("f_impact"), by("naive", "impact_bps").alias("n_impact"))
    for arm in ("capped", "spread"):
        imp = r8(F.col(f"n_{arm}_filled_impact_bps") - F.col(f"f_{arm}_filled_impact_bps"))
        short = r8(F.col(f"f_{arm}_unfilled_qty") - F.col(f"n_{arm}_unfilled_qty"))
        even = r8(safe_div(imp * F.col("parent_qty"), short))
        out = out.withColumn(f"{arm}_improvement_bps", imp).withColumn(f"{arm}_shortfall_qty", short).withColumn(f"{arm}_like_for_like", short == 0).withColumn(f"{arm}_breakeven_bps", F.when(even > 0, even))
        out = out.withColumn(f"{arm}_net_bps", r8(imp - short / F.col("parent_qty") * F.lit(shortfall_bps).cast("double")))
    out = out.withColumn("improvement_bps", r8(F.col("n_impact") - F.col("f_impact"))).withColumn("half_life_defaulted", F.lit(half_life_defaulted))
    gone = {"fold", "cap", "parent_share", "half_life", "f_impact", "n_impact", *[f"{x}_{c}" for x in "fn" for c in figures]}
    return _headed(out.select(*[c for c in out.columns if c not in gone]), head)


def forecast_slots(ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap: float, coef_bps: float, perm_coef_bps: float = 0.0, half_life: float = 0.0) -> DataFrame:
    """The schedules and both arms' sizes of pov_forecast(): a row per plan and slot."""
    _check_forecast(half_life, None)
    prof, _ = _study(ticks, key, [*history, execution], bucket_ns, [cap], coef_bps, perm_coef_bps, parent_qty, 2)
    rows = plan_slots(fold_plans(prof, _one_fold(ticks.sparkSession, history), len(history) + 1, [cap], [half_life], parent_qty), _SCENARIO, coef_bps, perm_coef_bps, _NEAR)
    return rows.select("plan", *_slot_columns())


def forecast_weights(spark, sessions: int, half_life: float) -> DataFrame:
    """The weight that each session of a history has in the pooled profile: place (0 the oldest), weight; they sum to one."""
    _check_forecast(half_life, None)
    raw = F.lit(1.0) if half_life == 0 else F.pow(F.lit(0.5), (sessions - 1 - F.col("id")) / F.lit(float(half_life)))
    rows = spark.range(sessions).withColumn("raw", raw)
    return rows.select(F.col("id").alias("place"), r8(F.col("raw") / F.sum("raw").over(Window.partitionBy())).alias("weight"))


def cap_sweep(ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0, half_life: float = 0.0) -> DataFrame:
    """One row per cap (carrying arm); counts of the grid's parts, like_for_like_from_cap and the breakeven's range repeat."""
    _check_forecast(half_life, None)
    caps = check_grid(cap_grid, "cap_grid", high=1.0)
    prof, head = _study(ticks, key, [*history, execution], bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 2)
    g = gain_rows(score_folds(prof, _one_fold(ticks.sparkSession, history), len(history) + 1, caps, [half_life], coef_bps, perm_coef_bps, parent_qty)).drop("fold", "half_life", "parent_qty", "parent_share")
    whole = Window.partitionBy()  # a row for each cap of the grid
    g = g.withColumn("dominated", ~F.col("like_for_like") & F.col("breakeven_bps").isNull())
    g = g.withColumn("from_here", F.min(F.col("like_for_like").cast("int")).over(Window.orderBy("cap").rowsBetween(0, Window.unboundedFollowing)) == 1)
    count = lambda c: F.count(c).over(whole)
    g = g.select(
        *[c for c in g.columns if c != "from_here"],
        count(F.when(F.col("like_for_like"), 1)).alias("like_for_like_points"), count(F.when(F.col("dominated"), 1)).alias("dominated_points"), count(F.col("breakeven_bps")).alias("traded_off_points"),
        F.min(F.when(F.col("from_here"), F.col("cap"))).over(whole).alias("like_for_like_from_cap"), F.min("breakeven_bps").over(whole).alias("breakeven_min_bps"), F.max("breakeven_bps").over(whole).alias("breakeven_max_bps"),
    )
    return _headed(g, head | {"sessions": len(history), "parent_qty": float(parent_qty), "half_life": float(half_life)})


def hl_sweep(ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap: float, hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per half-life (carrying arm); flat run, range, stability and the first best and worst half-life repeat."""
    hls = check_grid(hl_grid, "hl_grid")
    prof, head = _study(ticks, key, [*history, execution], bucket_ns, [cap], coef_bps, perm_coef_bps, parent_qty, 2)
    n = len(history)
    g = gain_rows(score_folds(prof, _one_fold(ticks.sparkSession, history), len(history) + 1, [cap], [0.0, *hls], coef_bps, perm_coef_bps, parent_qty))
    w = Window.partitionBy(*_NEAR)  # a row for each half-life of the grid
    x, flat = F.col("improvement_bps"), F.col("half_life") == 0
    lo, hi, f = (F.col(c) for c in ("improvement_min_bps", "improvement_max_bps", "flat_improvement_bps"))
    g = g.withColumn("flat_improvement_bps", F.max(F.when(flat, x)).over(w)).withColumn("improvement_min_bps", F.min(F.when(~flat, x)).over(w)).withColumn("improvement_max_bps", F.max(F.when(~flat, x)).over(w))
    first = lambda sign: F.min_by(F.when(~flat, F.col("half_life")), F.when(~flat, F.struct(sign * x, F.col("half_life")))).over(w)
    g = g.withColumn("best_half_life", first(-1.0)).withColumn("worst_half_life", first(1.0)).where("half_life > 0")
    total = (1 - F.pow(F.lit(0.5), F.lit(float(n)) / F.col("half_life"))) / (1 - F.pow(F.lit(0.5), 1 / F.col("half_life")))
    points = g.select(
        "half_life", r8(1.0 / total).alias("newest_weight"), "improvement_bps", "shortfall_qty", "like_for_like", "breakeven_bps", (~F.col("like_for_like") & F.col("breakeven_bps").isNull()).alias("dominated"),
        "flat_improvement_bps", "improvement_min_bps", "improvement_max_bps", r8(hi - lo).alias("improvement_span_bps"), (~((hi > 0) & (lo < 0))).alias("sign_stable"), ((f == 0) & (hi == 0) & (lo == 0)).alias("inert"),
        "best_half_life", "worst_half_life",
    )
    return _headed(points, head | {"sessions": n, "parent_qty": float(parent_qty), "cap": float(cap)})


def _stability_cells(ticks, key, history, execution, bucket_ns, parent_qty, cap_grid, hl_grid, coef_bps, perm_coef_bps) -> tuple[DataFrame, dict]:
    caps, hls = check_grid(cap_grid, "cap_grid", high=1.0), check_grid(hl_grid, "hl_grid")
    prof, head = _study(ticks, key, [*history, execution], bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 2)
    scored = score_folds(prof, _one_fold(ticks.sparkSession, history), len(history) + 1, caps, [0.0, *hls], coef_bps, perm_coef_bps, parent_qty)
    return cell_rows(gain_rows(scored)).drop("parent_share"), head | {"sessions": len(history), "parent_qty": float(parent_qty)}


def stability(ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per cap: flat improvement, span over half-lives, sign_stable, inert, verdict.  No cell is named best."""
    cells, head = _stability_cells(ticks, key, history, execution, bucket_ns, parent_qty, cap_grid, hl_grid, coef_bps, perm_coef_bps)
    cells = _counts(cells, ["fold"]).withColumn("all_sign_stable", F.col("unstable_caps") == 0)
    return _headed(cells.drop("fold", "parent_qty", "points"), head)


def stability_points(ticks: DataFrame, key: str, history: list, execution: object, bucket_ns: int, parent_qty: float, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """The improvement at every cap and half-life of stability()."""
    cells, _ = _stability_cells(ticks, key, history, execution, bucket_ns, parent_qty, cap_grid, hl_grid, coef_bps, perm_coef_bps)
    return cells.select("cap", F.explode("points").alias("p")).select("cap", "p.*")


def _consensus(cells: DataFrame, extra: list[str] = []) -> DataFrame:
    """cells with each cap's consensus over folds, on how many caps the folds agree, and whether on all."""
    w, whole = Window.partitionBy(*extra, "cap"), Window.partitionBy(*extra)
    cells = cells.withColumn("consensus", F.when(F.min("verdict").over(w) == F.max("verdict").over(w), F.col("verdict")).otherwise("mixed"))
    agreed = F.collect_set(F.when(F.col("consensus") != "mixed", F.col("cap"))).over(whole)  # caps of the grid
    cells = cells.withColumn("agreeing_caps", F.size(agreed).cast("long"))
    return cells.withColumn("all_agree", F.min((F.col("consensus") != "mixed").cast("int")).over(whole) == 1)


_FOLD = ["inert_caps", "stable_caps", "unstable_caps", "consensus", "agreeing_caps", "all_agree"]


def holdout(ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per held-out session and cap: verdict and flat improvement when the others, in their order, forecast it; the fold's counts and the caps' consensus repeat."""
    caps, hls = check_grid(cap_grid, "cap_grid", high=1.0), check_grid(hl_grid, "hl_grid")
    prof, head = _study(ticks, key, sessions, bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 3)
    n = len(sessions)
    folds = _folds(ticks.sparkSession, 0, n, "0", str(n))
    cells = _counts(cell_rows(gain_rows(score_folds(prof, folds, n, caps, [0.0, *hls], coef_bps, perm_coef_bps, parent_qty))), ["fold"])
    cells = _consensus(cells).select(F.col("fold").alias("held_out"), "cap", "verdict", "flat_improvement_bps", *_FOLD)
    return _headed(cells, head | {"parent_qty": float(parent_qty)})


def _check_parent(parent_qty: float | None, parent_share: float | None) -> None:
    if (parent_qty is None) == (parent_share is None):
        raise ValueError("give exactly one of parent_qty and parent_share")
    if parent_share is not None and not 0 < parent_share <= 1:
        raise ValueError("parent_share must be in (0, 1]")


def walk_forward(
    ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float | None, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0,
    window: int | None = None, parent_share: float | None = None,
) -> DataFrame:
    """One row per fold and cap: each session forecast from those before it, all or the last `window`; the fold's counts and the caps' consensus repeat."""
    _check_parent(parent_qty, parent_share)
    caps, hls, n = check_grid(cap_grid, "cap_grid", high=1.0), check_grid(hl_grid, "hl_grid"), len(sessions)
    if window is not None and (window < 2 or n < window + 2):
        raise ValueError("window must be >= 2 and leave at least two sessions")
    prof, head = _study(ticks, key, sessions, bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 4, ordered=True)
    lo = "0" if window is None else f"id - {window}"
    folds = _folds(ticks.sparkSession, 2 if window is None else window, n, lo, "id")
    scored = score_folds(prof, folds, n, caps, [0.0, *hls], coef_bps, perm_coef_bps, parent_qty, None if parent_share is None else [parent_share], window is not None)
    cells = _consensus(_counts(cell_rows(gain_rows(scored)), ["fold"]))
    cells = cells.withColumn("input", F.col("fold")).withColumn("history_from", F.expr(lo.replace("id", "fold")).cast("int")).select("input", "history_from", "parent_share", "parent_qty", "cap", "verdict", "flat_improvement_bps", *_FOLD)
    return _headed(cells, head | {"window": window})


def _window_cells(ticks, key, sessions, bucket_ns, parent_qty, parent_shares, caps, hls, coef_bps, perm_coef_bps) -> tuple[DataFrame, DataFrame, dict]:
    """(walks, cells, head): walks(window, input, history_from, last); cells(parent_share, input, history_from, cap, ...), a written table with each distinct fold priced once."""
    n, spark = len(sessions), ticks.sparkSession
    prof, head = _study(ticks, key, sessions, bucket_ns, caps, coef_bps, perm_coef_bps, parent_qty, 4, ordered=True)
    # window 0 grows from the first session; the others are 2 to n - 2 wide
    slid = spark.range(2, n - 1).selectExpr("cast(id as int) as window", f"explode(sequence(cast(id as int), {n - 1})) as input").withColumn("history_from", F.col("input") - F.col("window"))
    grown = spark.range(2, n).selectExpr("0 as window", "cast(id as int) as input", "0 as history_from")
    walks = slid.unionByName(grown).withColumn("last", F.col("input") == n - 1)
    # histories that start at 0 are in both but the longest, which no window takes
    folds = slid.drop("window").unionByName(grown.drop("window").where(F.col("input") == n - 1))
    folds = folds.select((F.col("input").cast("long") * n + F.col("history_from")).alias("fold"), "input", F.col("history_from").alias("lo"), F.col("input").alias("hi"))
    cells = cell_rows(gain_rows(score_folds(prof, folds, n, caps, [0.0, *hls], coef_bps, perm_coef_bps, parent_qty, parent_shares, True)))
    cells = cells.withColumn("input", F.expr(f"cast(fold div {n} as int)")).withColumn("history_from", (F.col("fold") % n).cast("int"))
    cells = cells.select("parent_share", "input", "history_from", "cap", "verdict", "flat_improvement_bps")
    slides = (n - 3) * (n - 2) // 2 + n - 3 if n > 3 else 0  # the sum of n - w for w from 2 to n - 2
    return walks, written(cells, "cells"), head | {"folds_run": slides + n - 2, "distinct_folds": slides + 1}


def _per_walk(walks: DataFrame, cells: DataFrame) -> DataFrame:
    met = walks.join(cells, ["input", "history_from"])
    return met.groupBy("parent_share", "window", "cap").agg(
        F.count(F.lit(1)).alias("folds"), F.when(F.min("verdict") == F.max("verdict"), F.max("verdict")).otherwise("mixed").alias("consensus"),
        F.max(F.when(F.col("last"), F.col("verdict"))).alias("last_verdict"), F.max(F.when(F.col("last"), F.col("flat_improvement_bps"))).alias("last_flat_improvement_bps"),
    )


def _per_input(walks: DataFrame, cells: DataFrame) -> DataFrame:
    """input, cap: how many walks score the input and from how many histories, whether its verdict is the same in all, and the span of its flat improvement."""
    met = walks.join(cells, ["input", "history_from"])
    return met.groupBy("input", "cap").agg(
        F.count(F.lit(1)).alias("walks"), F.count_distinct("history_from").alias("histories"), (F.min("verdict") == F.max("verdict")).alias("verdict_stable"),
        r8(F.max("flat_improvement_bps") - F.min("flat_improvement_bps")).alias("span_bps"),
    )


def _sweep_arguments(parent_qty, parent_share, cap_grid, hl_grid) -> tuple:
    _check_parent(parent_qty, parent_share)
    return check_grid(cap_grid, "cap_grid", high=1.0), check_grid(hl_grid, "hl_grid"), None if parent_share is None else [parent_share]


def window_sweep(
    ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float | None, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0, parent_share: float | None = None
) -> DataFrame:
    """One row per walk (window 0 grows) and cap: consensus and last fold.  Per cap, whether walks agree and settle, the last fold's span, whether
    every input's verdict holds whatever its history, and the widest span with its input (the last of equals).  For the whole sweep, on how many caps
    the walks settle, and on how many only the newest fold holds."""
    caps, hls, shares = _sweep_arguments(parent_qty, parent_share, cap_grid, hl_grid)
    walks, cells, head = _window_cells(ticks, key, sessions, bucket_ns, parent_qty, shares, caps, hls, coef_bps, perm_coef_bps)
    rows = _per_walk(walks, cells).drop("parent_share")
    w, same = Window.partitionBy("cap"), lambda c: F.min(c).over(Window.partitionBy("cap")) == F.max(c).over(Window.partitionBy("cap"))
    rows = rows.withColumn("consensus_stable", same("consensus")).withColumn("last_fold_stable", same("last_verdict"))
    rows = rows.withColumn("last_fold_span_bps", r8(F.max("last_flat_improvement_bps").over(w) - F.min("last_flat_improvement_bps").over(w)))
    rows = rows.withColumn("settled", F.col("consensus_stable") & (F.col("consensus") != "mixed"))
    inputs = _per_input(walks, cells).groupBy("cap").agg(
        F.min("verdict_stable").alias("every_input_stable"), F.max("span_bps").alias("widest_span_bps"), F.max_by("input", F.struct("span_bps", "input")).alias("widest_span_input"),
        F.count(F.when(F.col("histories") > 1, 1)).alias("compared_inputs"),
    )
    rows = rows.join(F.broadcast(inputs), "cap")  # a row for each cap of the grid
    whole = Window.partitionBy()
    which = lambda c: F.size(F.collect_set(F.when(c, F.col("cap"))).over(whole)).cast("long")
    rows = rows.withColumn("settled_caps", which(F.col("settled"))).withColumn("newest_only_caps", which(F.col("last_fold_stable") & ~F.col("every_input_stable")))
    return _headed(rows.withColumn("all_settled", F.col("settled_caps") == len(caps)), head)


def window_sweep_inputs(
    ticks: DataFrame, key: str, sessions: list, bucket_ns: int, parent_qty: float | None, cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0, parent_share: float | None = None
) -> DataFrame:
    """The inputs of window_sweep(): a row per input session and cap."""
    caps, hls, shares = _sweep_arguments(parent_qty, parent_share, cap_grid, hl_grid)
    walks, cells, _ = _window_cells(ticks, key, sessions, bucket_ns, parent_qty, shares, caps, hls, coef_bps, perm_coef_bps)
    return _per_input(walks, cells)


def share_sweep(ticks: DataFrame, key: str, sessions: list, bucket_ns: int, share_grid: list[float], cap_grid: list[float], hl_grid: list[float], coef_bps: float, perm_coef_bps: float = 0.0) -> DataFrame:
    """One row per parent share and cap: the verdict on which all walks settle (or null) and the last fold's; per share, on how many caps they settle; per
    cap, at how many shares it settles and whether the verdicts hold over shares; and on how many caps they do."""
    shares, caps, hls = check_grid(share_grid, "share_grid", high=1.0), check_grid(cap_grid, "cap_grid", high=1.0), check_grid(hl_grid, "hl_grid")
    walks, cells, head = _window_cells(ticks, key, sessions, bucket_ns, None, shares, caps, hls, coef_bps, perm_coef_bps)
    per = _per_walk(walks, cells).groupBy("parent_share", "cap").agg(
        F.when((F.min("consensus") == F.max("consensus")) & (F.max("consensus") != "mixed"), F.max("consensus")).alias("settled"),
        F.max(F.when(F.col("window") == 0, F.col("last_verdict"))).alias("last_verdict"),
    )
    w, whole = Window.partitionBy("cap"), Window.partitionBy()
    same = lambda c: F.min(c).over(w) == F.max(c).over(w)
    per = per.withColumn("settled_caps", F.count("settled").over(Window.partitionBy("parent_share"))).withColumn("settled_at", F.count("settled").over(w))
    per = per.withColumn("share_stable", F.coalesce((F.col("settled_at") == len(shares)) & same("settled"), F.lit(False))).withColumn("last_share_stable", same("last_verdict"))
    held = F.size(F.collect_set(F.when(F.col("share_stable"), F.col("cap"))).over(whole)).cast("long")
    return _headed(per.withColumn("held_caps", held), head)
