"""Level-2 book analytics: depth, queues, sweeps, and how they hold up when snapshots are thinned.

A snapshot is all rows of one ts_ns.  `keys` part a table into books.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions import check_grid, named, product_of, r8, require, safe_div
from tidemark.storage import written

#: Snapshots of a stretch of time, on the mean, when a book is thinned: what a task holds.
STRETCH_SNAPSHOTS = 500_000
#: Rows that a task sorts, on the mean.
TASK_ROWS = 2_000_000
#: Rows of a stretch: its own times, times of what comes after it, and where it is entered.
_TIME, _AHEAD, _ENTRY = 0, 1, 2


def _depths(book: DataFrame, keys: list[str]) -> DataFrame:
    """One row per snapshot: depth and best level of each side; an empty side has depth 0 and a null best price."""
    on = lambda s: F.col("side") == s
    top = lambda s, c: F.max(F.when(on(s) & (F.col("level") == 0), F.col(c)))
    whole = lambda s: F.coalesce(F.sum(F.when(on(s), F.col("size"))), F.lit(0.0))
    return book.groupBy(*keys, "ts_ns").agg(
        *product_of(book), whole("bid").alias("bid_depth"), whole("ask").alias("ask_depth"), top("bid", "price").alias("bid"), top("ask", "price").alias("ask"),
        F.coalesce(top("bid", "size"), F.lit(0.0)).alias("bid_queue"), F.coalesce(top("ask", "size"), F.lit(0.0)).alias("ask_queue"),
    )


def _means(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    balance = lambda a, b: F.avg(safe_div(F.col(a) - F.col(b), F.col(a) + F.col(b)))
    return snapshots.groupBy(*keys).agg(
        *product_of(snapshots), F.count(F.lit(1)).alias("snapshots"),
        r8(F.avg("bid_depth")).alias("avg_bid_depth"), r8(F.avg("ask_depth")).alias("avg_ask_depth"), r8(balance("bid_depth", "ask_depth")).alias("avg_depth_imbalance"),
        r8(F.avg(F.col("ask") - F.col("bid"))).alias("avg_spread"),
        r8(F.avg("bid_queue")).alias("avg_bid_queue"), r8(F.avg("ask_queue")).alias("avg_ask_queue"), r8(balance("bid_queue", "ask_queue")).alias("avg_queue_imbalance"),
    )


def depth_metrics(book: DataFrame, keys: list[str] = []) -> DataFrame:
    if not keys and book.isEmpty():
        raise ValueError("no book levels")
    return _means(_depths(book, keys), keys).select(*keys, *named(book), "snapshots", "avg_bid_depth", "avg_ask_depth", "avg_depth_imbalance", "avg_spread")


def queue_metrics(book: DataFrame, keys: list[str] = []) -> DataFrame:
    if not keys and book.isEmpty():
        raise ValueError("no book levels")
    return _means(_depths(book, keys), keys).select(*keys, *named(book), "snapshots", "avg_bid_queue", "avg_ask_queue", "avg_queue_imbalance")


def _parts(spark: SparkSession, rows: int) -> int:
    """Into how many tasks so many rows are dealt: as many as the session has, or more, of TASK_ROWS at most on the mean."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _sweeps(book: DataFrame, side: str, sizes: list[float], keys: list[str]) -> DataFrame:
    """keys, order_size and the averages of walking the book with it; one sort for all sizes."""
    if side not in ("buy", "sell"):
        raise ValueError("side must be 'buy' or 'sell'")
    if any(not 0 < s < float("inf") for s in sizes):
        raise ValueError("order_size must be finite and positive")
    sign, taken = (1, "ask") if side == "buy" else (-1, "bid")
    snap = Window.partitionBy(*keys, "ts_ns")
    walk = snap.orderBy(sign * F.col("price"), "level")
    levels = book.where(F.col("side") == taken).select(*keys, "ts_ns", *named(book), "level", "price", "size")
    levels = levels.repartition(_parts(book.sparkSession, levels.count()), *keys, "ts_ns")
    levels = levels.withColumn("ahead", F.sum("size").over(walk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(walk))
    take = [F.greatest(F.lit(0.0), F.least(F.lit(float(s)) - F.col("ahead"), F.col("size"))) for s in sizes]
    swept = [
        F.struct(F.lit(float(s)).alias("order_size"), F.sum(t * F.col("price")).over(snap).alias("notional"), F.sum(t).over(snap).alias("filled"), F.sum(F.when(t > 0, 1.0).otherwise(0.0)).over(snap).alias("levels"))
        for s, t in zip(sizes, take)
    ]
    # windows over what is sorted once hold a snapshot at a time; sizes are unfolded from a row per snapshot
    snaps = levels.select(
        *keys, *named(book), "nth", F.sum("size").over(snap).alias("depth"), (F.min("price") if side == "buy" else F.max("price")).over(snap).alias("touch"), F.array(*swept).alias("swept"),
    ).where("nth = 1")
    snaps = snaps.withColumn("s", F.explode("swept")).select(*keys, *named(book), "depth", "touch", "s.*")
    vwap = safe_div("notional", "filled")
    return snaps.groupBy(*keys, "order_size").agg(
        *product_of(snaps), F.count(F.lit(1)).alias("snapshots"), F.count(F.when(F.col("filled") >= F.col("order_size") - 1e-9, 1)).alias("filled_snapshots"),
        F.avg(vwap).alias("vwap"), F.avg(sign * (vwap - F.col("touch")) / F.col("touch") * 1e4).alias("slippage"), F.avg("levels").alias("levels"),
        F.avg(F.col("filled") / F.col("order_size")).alias("fill"), F.avg("depth").alias("depth"),
    )


def sweep_cost(book: DataFrame, side: str, order_size: float, keys: list[str] = []) -> DataFrame:
    """Cost of taking order_size from every snapshot: buy from the asks upwards, sell to the bids downwards."""
    out = _sweeps(book, side, [order_size], keys)
    return out.select(
        *keys, *named(out), F.lit(side).alias("side"), "order_size", "snapshots", "filled_snapshots", r8("vwap").alias("avg_sweep_vwap"), r8("slippage").alias("avg_slippage_bps"),
        r8("levels").alias("avg_levels_consumed"), r8("fill").alias("avg_fill_ratio"),
    )


def sweep_curve(book: DataFrame, side: str, sizes: list[float], keys: list[str] = []) -> DataFrame:
    """One row per order size: participation in the mean depth, slippage measured and as fitted by coef * sqrt(participation).

    The fit goes through the origin, over the sizes that every snapshot filled; it needs two.  Columns from snapshots to
    r_squared repeat on each row of the curve.
    """
    sizes = sorted(float(s) for s in sizes)
    if len(sizes) < 2 or any(b == a for a, b in zip(sizes, sizes[1:])):
        raise ValueError("sizes must be at least two, without repeats")
    rows = _sweeps(book, side, sizes, keys)
    rows = rows.withColumn("p", F.col("order_size") / F.col("depth")).withColumn("y", r8("slippage")).withColumn("fitted", F.col("fill") >= 1 - 1e-9)
    w = Window.partitionBy(*keys)
    fit = lambda x: F.sum(F.when(F.col("fitted"), x)).over(w)
    rows = rows.withColumn("n", fit(F.lit(1))).withColumn("coef", safe_div(fit(F.sqrt("p") * F.col("y")), fit(F.col("p")))).withColumn("mean", safe_div(fit(F.col("y")), F.col("n")))
    rows = rows.withColumn("residual", F.col("y") - F.col("coef") * F.sqrt("p"))
    rows = rows.withColumn("res", fit(F.col("residual") ** 2)).withColumn("tot", fit((F.col("y") - F.col("mean")) ** 2)).withColumn("points", F.count(F.lit(1)).over(w))
    if not keys:
        require(rows, {"fewer than two sizes were filled by every snapshot": F.coalesce(F.col("n"), F.lit(0)) < 2})
    return rows.select(
        *keys, *named(rows), F.lit(side).alias("side"), "snapshots", r8("depth").alias("avg_depth"), "points", F.col("n").cast("long").alias("fitted_points"), r8("coef").alias("coef_bps"),
        r8(F.sqrt(F.col("res") / F.col("n"))).alias("rmse_bps"), r8(F.when(F.col("tot") == 0, 0.0).otherwise(1 - F.col("res") / F.col("tot"))).alias("r_squared"),
        "order_size", r8("p").alias("participation"), F.col("y").alias("measured_bps"), r8(F.col("coef") * F.sqrt("p")).alias("modelled_bps"), r8("residual").alias("residual_bps"),
        r8("fill").alias("fill_ratio"), "fitted",
    )


def _own(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where the snapshots of a stretch are, in order of time, and their times."""
    ts = rows["ts_ns"].to_numpy()
    at = np.flatnonzero(rows["kind"].to_numpy() == _TIME)
    at = at[np.argsort(ts[at], kind="stable")]
    return at, ts[at]


def _crossings(rows: pa.Table) -> pa.Table:
    """For each snapshot at which a stretch may be entered, the one at which a later stretch is entered when that one is kept."""
    own, ts = _own(rows)
    if not len(ts):
        return rows.slice(0, 0).append_column("to_ns", pa.array([], pa.int64()))
    every, begins = rows["every_ns"][0].as_py(), rows["begins_ns"][0].as_py()
    after = np.searchsorted(ts, ts + every)
    last = np.where(after < len(ts), after, np.arange(len(ts)))
    while True:  # pointers double until each stands on the last snapshot kept in the stretch
        further = last[last]
        if (further == last).all():
            break
        last = further
    entries = np.arange(min(len(ts), int(np.searchsorted(ts, begins + every)) + 1))
    ahead = np.sort(rows.filter(pc.not_equal(rows["kind"], _TIME))["ts_ns"].to_numpy())
    place = np.searchsorted(ahead, ts[last[entries]] + every)
    to = pa.array([int(ahead[p]) if p < len(ahead) else None for p in place], pa.int64())
    return rows.take(pa.array(own[entries])).append_column("to_ns", to)


def _kept(rows: pa.Table) -> pa.Table:
    """The snapshots of a stretch that are kept from its entry on."""
    own, ts = _own(rows)
    entry = rows.filter(pc.equal(rows["kind"], _ENTRY))["ts_ns"].to_pylist()
    after = np.searchsorted(ts, ts + rows["every_ns"][0].as_py()).tolist() if len(ts) else []
    found = []
    for at in np.searchsorted(ts, entry).tolist():
        while at < len(ts):
            found.append(at)
            at = after[at]
    return rows.take(pa.array(own[np.array(found, np.int64)], pa.int64()))


def thin(book: DataFrame, spacings: DataFrame, keys: list[str] = []) -> DataFrame:
    """keys, the columns of spacings, ts_ns: the snapshots that a slower recorder would have kept.

    spacings has every_ns and offset_ns (and labels).  Kept are the first snapshot at or after first + offset_ns, and then each at
    least every_ns after the last kept.

    A book's time is cut into stretches of some STRETCH_SNAPSHOTS, one spacing long at least.  Each stretch finds for all snapshots at
    which it may be entered where the chain of kept ones enters a later stretch; what is entered is then followed from stretch to stretch, twice as
    many in each round, and each stretch gives what it keeps from its entry on.  A task holds the times of one stretch.
    """
    labels, one = spacings.columns, F.lit(1)
    group = [*keys, *labels]
    times = book.select(*keys, "ts_ns").distinct()
    sizes = times.groupBy(*keys).agg(F.count(one).alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"))
    # how many spacings long a stretch is: as many as hold STRETCH_SNAPSHOTS on the mean
    fits = F.floor(F.lit(float(STRETCH_SNAPSHOTS)) * (F.col("t1") - F.col("t0") + 1) / (F.col("n") * F.col("every_ns")))
    sets = sizes.crossJoin(F.broadcast(spacings)).withColumn("width", F.col("every_ns") * F.greatest(one, F.least(F.lit(STRETCH_SNAPSHOTS), fits)))
    met = times.join(sets, keys) if keys else times.crossJoin(sets)
    begins = F.col("t0") + F.col("stretch") * F.col("width")
    met = met.withColumn("stretch", F.expr("(ts_ns - t0) div width")).withColumn("begins_ns", begins)
    columns = [*group, "stretch", "begins_ns"]
    rows = met.select(*columns, F.lit(_TIME).alias("kind"), "ts_ns")
    first = met.where(F.col("ts_ns") >= F.col("t0") + F.col("offset_ns")).groupBy(*group).agg(F.min(F.struct("ts_ns", "stretch", "begins_ns")).alias("f")).select(*group, "f.*")
    entries = first.select(*columns, F.lit(_ENTRY).alias("kind"), "ts_ns")

    most, dealt = sets.agg(F.coalesce(F.max((F.col("t1") - F.col("t0")) / F.col("width")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = _parts(book.sparkSession, dealt)
    if most >= 1:
        entries = _entered(met, rows, entries, group, int(most) + 1, parts)
    kept = rows.unionByName(entries).repartition(parts, *group, "stretch").groupBy(*group, "stretch").applyInArrow(_kept, rows.schema)
    return kept.select(*group, "ts_ns")


def _entered(met: DataFrame, rows: DataFrame, entries: DataFrame, group: list[str], stretches: int, parts: int) -> DataFrame:
    """The entry of every stretch that the chains come through, from their first ones."""
    late = F.col("ts_ns") >= F.col("begins_ns") + F.col("every_ns")
    ends = met.groupBy(*group, "stretch", "begins_ns", "width").agg(F.min("ts_ns").alias("first"), F.min(F.when(late, F.col("ts_ns"))).alias("later"))
    w = Window.partitionBy(*group).orderBy("stretch")
    ends = ends.withColumn("next", F.lead("stretch").over(w)).withColumn("first1", F.lead("first").over(w)).withColumn("later1", F.lead("later").over(w)).withColumn("first2", F.lead("first", 2).over(w))
    # a chain leaves for the beginning of the next stretch, of which a copy is at hand, or else for what comes first after that
    after = F.when(F.col("next") == F.col("stretch") + 1, F.coalesce("later1", "first2")).otherwise(F.col("first1"))
    columns = [*group, "stretch", "begins_ns"]
    ahead = ends.select(*columns, F.lit(_AHEAD).alias("kind"), after.alias("ts_ns")).where("ts_ns is not null")
    heads = met.where(~late & (F.col("stretch") > 0)).select(*group, (F.col("stretch") - 1).alias("stretch"), (F.col("begins_ns") - F.col("width")).alias("begins_ns"), F.lit(_AHEAD).alias("kind"), "ts_ns")
    schema = StructType([*rows.schema.fields, StructField("to_ns", LongType())])
    jumps = rows.unionByName(heads).unionByName(ahead).repartition(parts, *group, "stretch").groupBy(*group, "stretch").applyInArrow(_crossings, schema)
    jumps = written(jumps.where("to_ns is not null").select(*group, "ts_ns", "to_ns"), "jumps")
    reached = entries.select(*group, "ts_ns")
    for _ in range((stretches - 1).bit_length()):
        reached = written(reached.unionByName(reached.join(jumps, [*group, "ts_ns"]).select(*group, F.col("to_ns").alias("ts_ns"))).distinct(), "reached")
        then = jumps.select(*group, F.col("ts_ns").alias("to_ns"), F.col("to_ns").alias("then_ns"))
        jumps = written(jumps.join(then, [*group, "to_ns"]).select(*group, "ts_ns", F.col("then_ns").alias("to_ns")), "jumps")
    return reached.join(met.select(*columns, "ts_ns"), [*group, "ts_ns"]).select(*columns, F.lit(_ENTRY).alias("kind"), "ts_ns")


def _every_ns(every_s: float) -> int:
    return int(every_s * 1e9 + 0.5)


def _snapshots(book: DataFrame, keys: list[str]) -> DataFrame:
    """A row per snapshot, written: a grid reads the levels once."""
    return written(_depths(book, keys), "snapshots")


def _grid_rows(snaps: DataFrame, grid: list[float], phases: int, keys: list[str]) -> DataFrame:
    """keys, every_s, phase and the averages of the thinned book of these snapshots, with spread_ratio, queue_sign_kept and the full book's figures."""
    if not grid or any(not 0 < g < float("inf") for g in grid) or len(set(grid)) < len(grid):
        raise ValueError("spacings must be finite, positive and without repeats")
    spark = snaps.sparkSession
    rows = [(float(g), k, _every_ns(g), _every_ns(g) * k // phases) for g in grid for k in range(phases)]
    spacings = spark.createDataFrame(rows, "every_s double, phase int, every_ns long, offset_ns long")
    full = _means(snaps, keys)
    kept = thin(snaps, spacings, keys).select(*keys, "every_s", "phase", "ts_ns")
    rows = _means(kept.join(snaps, [*keys, "ts_ns"]), [*keys, "every_s", "phase"])
    whole = full.select(*keys, *[F.col(c).alias(f"full_{c}") for c in full.columns if c not in keys])
    rows = rows.join(whole, keys) if keys else rows.crossJoin(whole)
    return rows.withColumn("spread_ratio", r8(safe_div("avg_spread", "full_avg_spread"))).withColumn(
        "queue_sign_kept", F.col("avg_queue_imbalance") * F.col("full_avg_queue_imbalance") > 0
    )


_FIGURES = ["snapshots", "avg_bid_depth", "avg_ask_depth", "avg_depth_imbalance", "avg_spread", "avg_bid_queue", "avg_ask_queue", "avg_queue_imbalance"]


def book_grid_sweep(book: DataFrame, every_grid: list[float], keys: list[str] = []) -> DataFrame:
    """One row per spacing, and the full book as every_s 0: averages, spread_ratio to the full book, queue_sign_kept; sign_flips, at how many spacings
    the sign isn't kept, repeats."""
    snaps = _snapshots(book, keys)
    rows = _grid_rows(snaps, every_grid, 1, keys)
    full = _means(snaps, keys).withColumn("every_s", F.lit(0.0)).withColumn("spread_ratio", F.lit(1.0)).withColumn("queue_sign_kept", F.lit(True))
    columns = [*keys, "every_s", *_FIGURES, "spread_ratio", "queue_sign_kept"]
    return full.select(columns).unionByName(rows.select(columns)).withColumn("sign_flips", F.count(F.when(~F.col("queue_sign_kept"), 1)).over(Window.partitionBy(*keys)))


def _several(book: DataFrame, key: str, name: str) -> None:
    n = book.select(key).distinct().limit(2).count()
    if n < 2:
        raise ValueError(f"{name} needs two or more books, got {n}")


def book_grid_across(book: DataFrame, every_grid: list[float], key: str) -> DataFrame:
    """One row per spacing over the books of `key`: in how many the queue's sign is kept, which lose it, ratios and the widest drift of the depth
    imbalance; held_spacings, which all books keep, repeats."""
    _several(book, key, "book-grid-across")
    rows = _grid_rows(_snapshots(book, [key]), every_grid, 1, [key])
    drift = F.abs(F.col("avg_depth_imbalance") - F.col("full_avg_depth_imbalance"))
    rows = rows.groupBy("every_s").agg(
        F.count(F.when(F.col("queue_sign_kept"), 1)).alias("sign_kept_books"), F.array_sort(F.collect_list(F.when(~F.col("queue_sign_kept"), F.col(key)))).alias("sign_lost_by"),
        F.min("spread_ratio").alias("spread_ratio_min"), F.max("spread_ratio").alias("spread_ratio_max"), r8(F.max(drift)).alias("imbalance_drift_max"),
        F.count(F.lit(1)).alias("books"),
    ).withColumn("held", F.col("sign_kept_books") == F.col("books"))
    return rows.withColumn("held_spacings", F.count(F.when(F.col("held"), 1)).over(Window.partitionBy()))  # a row for each spacing of the grid


def held_without(rows: DataFrame, books: DataFrame, key: str, lost: str = "sign_lost_by") -> DataFrame:
    """For each book, how many spacings every other book holds; rows are those of book_grid_across(), or of book_grid_phase_across() with lost='not_held_by'."""
    others = books.select(key).distinct().crossJoin(F.broadcast(rows.select("every_s", lost)))
    fine = F.size(F.filter(lost, lambda b: b != F.col(key))) == 0
    return others.groupBy(key).agg(F.count(F.when(fine, 1)).alias("held_without"))


def book_grid_phase(book: DataFrame, every_grid: list[float], phases: int, keys: list[str] = []) -> DataFrame:
    """One row per spacing over `phases` starts: ranges of the figures, and whether the queue's sign is held, lost or split."""
    if phases < 2:
        raise ValueError("phases must be >= 2")
    rows = _grid_rows(_snapshots(book, keys), every_grid, phases, keys)
    kept = F.count(F.when(F.col("queue_sign_kept"), 1))
    out = rows.groupBy(*keys, "every_s").agg(
        F.count(F.lit(1)).alias("phases_run"), F.min("snapshots").alias("snapshots_min"), F.max("snapshots").alias("snapshots_max"),
        F.min("spread_ratio").alias("spread_ratio_min"), F.max("spread_ratio").alias("spread_ratio_max"),
        F.min("avg_queue_imbalance").alias("queue_imbalance_min"), F.max("avg_queue_imbalance").alias("queue_imbalance_max"),
        kept.alias("sign_kept_phases"), F.max(F.when(F.col("phase") == 0, F.col("queue_sign_kept"))).alias("first_phase_kept"),
        F.max(F.abs("full_avg_queue_imbalance")).alias("full_queue_imbalance_abs"), F.max("full_avg_queue_imbalance").alias("full_queue_imbalance"),
    )
    all_, none = F.col("sign_kept_phases") == F.col("phases_run"), F.col("sign_kept_phases") == 0
    out = out.withColumn("verdict", F.when(all_, "held").when(none, "lost").otherwise("split"))
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1)).over(Window.partitionBy(*keys)).alias(f"{v}_spacings")
    return out.select("*", count("held"), count("lost"), count("split"))


def book_grid_phase_across(book: DataFrame, every_grid: list[float], phases: int, key: str) -> DataFrame:
    """One row per spacing over books and starts: who holds, loses and splits, and where the misses lie; on how many spacings all books hold, from every
    start and from the first, repeats."""
    _several(book, key, "book-grid-phase-across")
    rows = book_grid_phase(book, every_grid, phases, [key]).withColumn("missed", F.col("phases_run") - F.col("sign_kept_phases"))
    spacing = Window.partitionBy("every_s")
    w = spacing.orderBy(F.desc("missed"), key)
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("run", F.sum("missed").over(w)).withColumn("all_missed", F.sum("missed").over(spacing))
    is_ = lambda v: F.col("verdict") == v
    missed, side = F.col("missed") > 0, F.col("full_queue_imbalance_abs")
    rows = rows.withColumn("strongest", F.coalesce(F.max(F.when(missed, side)).over(spacing), F.lit(0.0))).withColumn("faintest", F.min(F.when(~missed, side)).over(spacing))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(key))))
    out = rows.groupBy("every_s").agg(
        F.count(F.when(is_("held"), 1)).alias("held_books"), listed(is_("lost")).alias("lost_by"), listed(is_("split")).alias("split_by"), listed(~is_("held")).alias("not_held_by"),
        F.count(F.when(F.col("first_phase_kept"), 1)).alias("first_phase_books"),
        F.sum("sign_kept_phases").alias("kept_starts"), F.sum("phases_run").alias("starts_run"),
        F.max("missed").alias("most_missed"), F.min_by(key, "place").alias("most_missed_book"), F.max(F.when(F.col("place") == 2, F.col("missed"))).alias("next_most_missed"),
        F.sum(F.when(F.col("place") > 1, F.col("sign_kept_phases")).otherwise(0)).alias("kept_without_weakest"), F.sum(F.when(F.col("place") > 1, F.col("phases_run")).otherwise(0)).alias("run_without_weakest"),
        F.coalesce(F.min(F.when((2 * F.col("run") >= F.col("all_missed")) & (F.col("all_missed") > 0), F.col("place"))), F.lit(0)).cast("long").alias("half_missed_by"),
        F.max("strongest").alias("strongest_side_missed"), F.coalesce(F.max("faintest"), F.lit(0.0)).alias("faintest_side_held"),
        F.count(F.when(~missed & (side <= F.col("strongest")), 1)).alias("held_no_clearer"), F.count(F.when(missed & (side >= F.col("faintest")), 1)).alias("missed_no_fainter"),
        F.min_by(key, F.when(missed, F.struct(-side, F.col(key)))).alias("strongest_missed_book"), F.min_by(key, F.when(~missed, F.struct(side, F.col(key)))).alias("faintest_held_book"),
        F.max(F.when((F.col("place") == 1) & missed, side)).alias("most_missed_side"), F.min(F.when(missed, side)).alias("faintest_side_missed"), F.count(F.lit(1)).alias("books"),
    )
    out = out.withColumn("held", F.col("held_books") == F.col("books"))
    whole = Window.partitionBy()  # a row for each spacing of the grid
    return out.withColumn("held_spacings", F.count(F.when(F.col("held"), 1)).over(whole)).withColumn("first_phase_held_spacings", F.count(F.when(F.col("first_phase_books") == F.col("books"), 1)).over(whole))
