"""Every operator as a query on the driver's tables, with the SQL that it is held against.

Reports come flat and rounded to six decimals on both sides.  The SQL states each operator in another form than the
engine does: window formulas for folds, recursion for greedy scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import plans, sources
from tidemark.functions import round_report, tables
from tidemark.operators import asof, book, fills, impact, pov, quotes, ticks, windows
from tidemark.sources import adapters, live
from tidemark.sources.adapters import BAR_NS, DAY_NS, SLOT_NS
from tidemark.storage import new_path
from tidemark.streaming import book as book_stream
from tidemark.streaming import events
from tidemark.streaming import session as streaming
from tidemark.streaming import trades
from tidemark.streaming import windows as stream_windows
from tidemark.streaming.state import latest, to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Days of the test tables, each a session; only the SQL needs to know, the queries take the sessions that there are.
DAYS = 30
PARENT, COEF, PERM = 40.0, 25.0, 5.0
CAPS, HALF_LIVES, SHARES = [0.05, 0.1, 0.2], [0.25, 0.5, 1.0, 2.0, 4.0], [0.05, 0.1, 0.15]


def _query(sql: str | None = None, places: int = 6):
    """Register a function as a query, with its SQL, which selects the same columns and has [[double]] around what is to be rounded."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: round_report(round_report(f(spark, sf_dir), 8), places)
        if sql:
            ORACLES[f.__name__] = _expand(sql)
        return f

    return register


def _expand(sql: str) -> str:
    """Replace [[expression]] by its rounding, half away from zero, and add the CTEs of the tables."""
    while "[[" in sql:
        a = sql.index("[[")
        b = sql.index("]]", a)
        x = sql[a + 2 : b]
        # eight decimals first, as reports have them: then no noise of summation is left at the sixth
        sql = sql[:a] + f"(sign({x}) * floor(floor(abs({x}) * 1e8 + 0.5) / 1e8 * 1e6 + 0.5) / 1e6 + 0e0)" + sql[b + 2 :]
    used = [f"{name} AS ({body})" for name, body in _TABLES.items() if f"{name}" in sql]
    text = sql.strip()
    recursive = "RECURSIVE " if text.startswith("WITH RECURSIVE") else ""
    text = text.removeprefix("WITH RECURSIVE").removeprefix("WITH").strip()
    if not used:
        return sql.strip()
    if not sql.strip().startswith("WITH"):
        return f"WITH {', '.join(used)} {text}"
    return f"WITH {recursive}{', '.join([*used, text])}"


_NS = "epoch_us(ts) * 1000"
_TABLES = {
    "t_ticks": f"""SELECT {_NS} AS ts_ns, 100 + value AS price, 1 + (user_id % 10) / 10e0 AS size, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
        event_id AS trade_id, ({_NS}) // {DAY_NS} AS session_id FROM events""",
    "t_quotes": f"""SELECT {_NS} AS ts_ns, 100 + value - 5e-2 * (1 + event_id % 5) AS bid, 1e0 + event_id % 7 AS bid_size, 100 + value + 5e-2 * (1 + event_id % 5) AS ask,
        1e0 + event_id % 11 AS ask_size FROM events""",
    "t_book": f"""SELECT {_NS} AS ts_ns, CASE WHEN s = 0 THEN 'bid' ELSE 'ask' END AS side, level, 100 + value + (2 * s - 1) * (5e-2 * (1 + event_id % 5) + 1e-1 * level) AS price,
        1e-1 + ((event_id * 31 + level * 17 + s * 7) % 29) / 10e0 AS size, ({_NS}) // {DAY_NS} AS session_id FROM events, range(5) l(level), range(2) q(s)""",
    "t_samples": "SELECT p AS participation, 10e0 * sqrt(p) + 20e0 * p + ((o_orderkey % 7) - 3) * 1e-1 AS realised_bps FROM (SELECT o_orderkey, 1e-2 + (o_custkey % 50) / 100e0 AS p FROM orders)",
    "t_fills": """SELECT o_orderkey * 1000000000 AS ts_ns, qty, 100e0 + (o_orderkey % 13) * 1e-2 AS price, qty * (4 + o_orderkey % 9) AS interval_volume
        FROM (SELECT o_orderkey, 1e0 + o_custkey % 5 AS qty FROM orders)""",
}


# ticks


@_query(f"""SELECT session_id, ts_ns // {BAR_NS} * {BAR_NS} AS bucket_ns, [[arg_min(price, (ts_ns, trade_id))]] AS open, [[max(price)]] AS high, [[min(price)]] AS low,
    [[arg_max(price, (ts_ns, trade_id))]] AS close, [[sum(size)]] AS volume, [[sum(price * size) / sum(size)]] AS vwap FROM t_ticks GROUP BY ALL""")
def bars_ohlcv(spark, sf_dir):
    return ticks.bars(adapters.ticks(spark, sf_dir), BAR_NS, ["session_id"])


@_query("SELECT session_id, [[sum(price * size) / sum(size)]] AS vwap FROM t_ticks GROUP BY ALL")
def session_vwap(spark, sf_dir):
    return ticks.session_vwap(adapters.ticks(spark, sf_dir), ["session_id"])


_TWAP = "(SELECT session_id, sum(price * dt) / sum(dt) AS twap FROM (SELECT session_id, price, CAST(lead(ts_ns) OVER (PARTITION BY session_id ORDER BY ts_ns, trade_id) - ts_ns AS DOUBLE) AS dt FROM t_ticks) GROUP BY ALL)"


@_query(f"SELECT session_id, [[twap]] AS twap FROM {_TWAP}")
def session_twap(spark, sf_dir):
    return ticks.session_twap(adapters.ticks(spark, sf_dir), ["session_id"])


_FLOW = "(SELECT session_id, sum(size) FILTER (side = 'buy') AS b, sum(size) FILTER (side = 'sell') AS s FROM t_ticks GROUP BY ALL)"


@_query(f"SELECT session_id, [[b]] AS buy_volume, [[s]] AS sell_volume, [[(b - s) / (b + s)]] AS imbalance FROM {_FLOW}")
def order_flow(spark, sf_dir):
    return ticks.order_flow(adapters.ticks(spark, sf_dir), ["session_id"])


_BARS = f"""(SELECT session_id, ts_ns // {BAR_NS} * {BAR_NS} AS bar_ns, [[arg_min(price, (ts_ns, trade_id))]] AS bar_open, [[max(price)]] AS bar_high, [[min(price)]] AS bar_low, [[arg_max(price, (ts_ns, trade_id))]] AS bar_close, [[sum(size)]] AS bar_volume,
    [[sum(price * size) / sum(size)]] AS bar_vwap FROM t_ticks GROUP BY ALL)"""


@_query(f"""SELECT session_id, 'EVT' AS product, CAST({BAR_NS} AS BIGINT) AS bucket_ns, n AS ticks, [[v]] AS vwap, [[twap]] AS twap, [[b]] AS buy_volume, [[s]] AS sell_volume, [[(b - s) / (b + s)]] AS imbalance,
    bar_ns, bar_open, bar_high, bar_low, bar_close, bar_volume, bar_vwap
    FROM {_FLOW} JOIN {_TWAP} USING (session_id) JOIN {_BARS} USING (session_id)
    JOIN (SELECT session_id, count(*) AS n, sum(price * size) / sum(size) AS v FROM t_ticks GROUP BY ALL) USING (session_id)""")
def summary(spark, sf_dir):
    """The report with its bars, a row each."""
    rows = ticks.summary(adapters.ticks(spark, sf_dir), BAR_NS, ["session_id"])
    bar = [F.col(f"bar.{a}").alias(f"bar_{b}") for a, b in (("bucket_ns", "ns"), ("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"), ("volume", "volume"), ("vwap", "vwap"))]
    return rows.withColumn("bar", F.explode("bars")).select(*[c for c in rows.columns if c != "bars"], *bar)


_CHUNK = 4096
_STREAM = f"""SELECT CAST(session_id AS VARCHAR) AS session, n AS rows, first_ts_ns, last_ts_ns, [[b + s]] AS volume, [[notional]] AS notional, [[notional / (b + s)]] AS vwap, [[twap]] AS twap, [[b]] AS buy_volume, [[s]] AS sell_volume, [[(b - s) / (b + s)]] AS imbalance,
    CAST({_CHUNK} AS BIGINT) AS chunk_rows, (n + {_CHUNK} - 1) // {_CHUNK} AS chunks, least(n, {_CHUNK}) + CASE WHEN n > {_CHUNK} THEN 1 ELSE 0 END AS peak_rows_in_memory
    FROM {_FLOW} JOIN {_TWAP} USING (session_id)
    JOIN (SELECT session_id, count(*) AS n, sum(price * size) AS notional, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns FROM t_ticks GROUP BY ALL) USING (session_id)"""


@_query(_STREAM)
def stream_session(spark, sf_dir):
    """The table read as a stream and folded by state, to its end."""
    live = adapters.ticks(spark, sf_dir, stream=True)
    return streaming.to_end(streaming.stream(live, "session_id", _CHUNK), _CHUNK).drop("rows_held")  # counted while folding; at most peak_rows_in_memory, or the stream fails


@_query(_STREAM)
def stream_replay(spark, sf_dir):
    return streaming.replay(adapters.ticks(spark, sf_dir), "session_id", _CHUNK).withColumn("session", F.col("session_id").cast("string")).drop("session_id")


_WINDOWED = """SELECT product, start_ns, [[arg_min(price, (ts_ns, trade_id))]] AS open, [[max(price)]] AS high, [[min(price)]] AS low, [[arg_max(price, (ts_ns, trade_id))]] AS close,
    count(*) AS trades, [[sum(size)]] AS volume, [[sum(price * size) / sum(size)]] AS vwap FROM w GROUP BY ALL"""


@_query(f"WITH w AS (SELECT *, 'EVT' AS product, ts_ns // 3600000000000 * 3600000000000 AS start_ns FROM t_ticks) {_WINDOWED}")
def windowed_bars(spark, sf_dir):
    """Hourly bars of a stream, by event time."""
    live_bars = stream_windows.windowed_bars(adapters.ticks(spark, sf_dir, stream=True), "1 hour", "40 days")
    return latest(to_table(live_bars), ["product", "start_ns"], "trades")


@_query(f"WITH w AS (SELECT *, 'EVT' AS product, (ts_ns // 1800000000000 - k) * 1800000000000 AS start_ns FROM t_ticks, range(4) s(k)) {_WINDOWED}")
def sliding_bars_stream(spark, sf_dir):
    """Bars of two hours that begin every half hour, of a stream."""
    live_bars = stream_windows.windowed_bars(adapters.ticks(spark, sf_dir, stream=True), "2 hours", "40 days", "30 minutes")
    return latest(to_table(live_bars), ["product", "start_ns"], "trades")


@_query("""WITH w AS (SELECT *, (ts_ns // 300000000000 - k) * 300000000000 AS start_ns FROM t_ticks, range(12) s(k))
    SELECT start_ns, count(*) AS trades, [[sum(size)]] AS volume, [[sum(price * size) / sum(size)]] AS vwap FROM w GROUP BY ALL""")
def rolling_vwap(spark, sf_dir):
    """The last hour's VWAP, every five minutes."""
    return windows.rolling_vwap(adapters.ticks(spark, sf_dir), 3_600_000_000_000, 300_000_000_000)


@_query("""WITH g AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns) < 240000000000 THEN 0 ELSE 1 END AS opens FROM t_ticks),
    b AS (SELECT *, sum(opens) OVER (ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM g)
    SELECT product, start_ns, last_ns, trades, [[volume]] AS volume, [[vwap]] AS vwap FROM (
        SELECT 'EVT' AS product, burst, min(ts_ns) AS start_ns, max(ts_ns) AS last_ns, count(*) AS trades, sum(size) AS volume, sum(price * size) / sum(size) AS vwap FROM b GROUP BY burst)""")
def trade_bursts(spark, sf_dir):
    """Runs of trades less than four minutes apart."""
    return windows.trade_bursts(adapters.ticks(spark, sf_dir), 240_000_000_000, ["product"])


@_query(f"""SELECT CAST(session_id AS VARCHAR) AS session, ts_ns // {BAR_NS} * {BAR_NS} AS start_ns, [[arg_min(price, (ts_ns, trade_id))]] AS open, [[max(price)]] AS high, [[min(price)]] AS low,
    [[arg_max(price, (ts_ns, trade_id))]] AS close, [[sum(size)]] AS volume, [[sum(price * size) / sum(size)]] AS vwap FROM t_ticks GROUP BY ALL""")
def sql_bars(spark, sf_dir):
    """Bars by a table function of SQL."""
    tables.register(adapters.ticks(spark, sf_dir), "session_id")
    return spark.sql(f"SELECT * FROM tidemark_bars({BAR_NS})")


@_query(f"""SELECT CAST(session_id AS VARCHAR) AS session, n AS ticks, [[v]] AS vwap, [[b]] AS buy_volume, [[s]] AS sell_volume, [[(b - s) / (b + s)]] AS imbalance
    FROM {_FLOW} JOIN (SELECT session_id, count(*) AS n, sum(price * size) / sum(size) AS v FROM t_ticks GROUP BY ALL) USING (session_id)""")
def sql_session_report(spark, sf_dir):
    """Two reports joined in SQL."""
    tables.register(adapters.ticks(spark, sf_dir), "session_id")
    return spark.sql("SELECT session, ticks, vwap, buy_volume, sell_volume, imbalance FROM tidemark_vwap() JOIN tidemark_order_flow() USING (session)")


# quotes and books


@_query("""SELECT 'EVT' AS product, count(*) AS quotes, [[avg(ask - bid)]] AS avg_spread, [[avg((bid + ask) / 2)]] AS avg_mid, [[avg((bid * ask_size + ask * bid_size) / (bid_size + ask_size))]] AS avg_microprice,
    [[avg((bid_size - ask_size) / (bid_size + ask_size))]] AS avg_book_imbalance FROM t_quotes""")
def quote_metrics(spark, sf_dir):
    return quotes.quote_metrics(adapters.quotes(spark, sf_dir))


@_query("""WITH m AS (SELECT ts_ns AS quote_ns, (bid + ask) / 2 AS mid FROM t_quotes),
    a AS (SELECT t.*, m.mid FROM t_ticks t ASOF LEFT JOIN m ON t.ts_ns > m.quote_ns),
    b AS (SELECT a.*, m.mid AS later FROM a ASOF LEFT JOIN m ON a.ts_ns + 300000000000 >= m.quote_ns),
    c AS (SELECT *, CASE WHEN side = 'buy' THEN 2e0 ELSE -2e0 END * (price - mid) / mid * 1e4 AS e, CASE WHEN side = 'buy' THEN 2e0 ELSE -2e0 END * (price - later) / mid * 1e4 AS r FROM b),
    d AS (SELECT session_id, count(*) AS trades, count(e) AS priced_trades, sum(size) AS v, sum(e * size) / sum(size) FILTER (e IS NOT NULL) AS es, sum(r * size) / sum(size) FILTER (r IS NOT NULL) AS rs FROM c GROUP BY ALL)
    SELECT session_id, trades, priced_trades, [[v]] AS volume, [[es]] AS effective_spread_bps, [[rs]] AS realised_spread_bps, [[es - rs]] AS price_impact_bps FROM d""")
def trade_spreads(spark, sf_dir):
    """Effective and realised spread against the quotes that stood before each trade and five minutes after it."""
    return asof.trade_spreads(adapters.ticks(spark, sf_dir), adapters.quotes(spark, sf_dir), 300_000_000_000, ["session_id"])


_SNAPS = """(SELECT session_id, ts_ns, sum(size) FILTER (side = 'bid') AS bd, sum(size) FILTER (side = 'ask') AS ad, max(price) FILTER (side = 'bid' AND level = 0) AS bp, max(price) FILTER (side = 'ask' AND level = 0) AS ap,
    max(size) FILTER (side = 'bid' AND level = 0) AS bq, max(size) FILTER (side = 'ask' AND level = 0) AS aq FROM t_book GROUP BY ALL)"""


@_query(f"SELECT session_id, 'EVT' AS product, count(*) AS snapshots, [[avg(bd)]] AS avg_bid_depth, [[avg(ad)]] AS avg_ask_depth, [[avg((bd - ad) / (bd + ad))]] AS avg_depth_imbalance, [[avg(ap - bp)]] AS avg_spread FROM {_SNAPS} GROUP BY ALL")
def depth_metrics(spark, sf_dir):
    return book.depth_metrics(adapters.book(spark, sf_dir), ["session_id"])


@_query(f"SELECT session_id, 'EVT' AS product, count(*) AS snapshots, [[avg(bq)]] AS avg_bid_queue, [[avg(aq)]] AS avg_ask_queue, [[avg((bq - aq) / (bq + aq))]] AS avg_queue_imbalance FROM {_SNAPS} GROUP BY ALL")
def queue_metrics(spark, sf_dir):
    return book.queue_metrics(adapters.book(spark, sf_dir), ["session_id"])


def _sweep_sql(side: str, sizes: str) -> str:
    taken, sign, touch = ("ask", "1", "min") if side == "buy" else ("bid", "-1", "max")
    return f"""swept AS (
        SELECT q, ts_ns, sum(take * price) AS notional, sum(take) AS filled, count(*) FILTER (take > 0) AS levels, {touch}(price) AS touch, {sign} AS sg FROM (
            SELECT q, ts_ns, price, greatest(0, least(size, q - ahead)) AS take FROM (
                SELECT *, sum(size) OVER (PARTITION BY ts_ns ORDER BY {sign} * price, level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM t_book WHERE side = '{taken}'
            ), (SELECT unnest([{sizes}]) AS q)) GROUP BY ALL),
        costs AS (SELECT q, count(*) AS snapshots, count(*) FILTER (filled >= q - 1e-9) AS filled_snapshots, avg(notional / filled) AS vwap, avg(sg * (notional / filled - touch) / touch * 1e4) AS slip, avg(levels) AS levels, avg(filled / q) AS fill
            FROM swept GROUP BY q)"""


_COST = "SELECT 'EVT' AS product, '{side}' AS side, q AS order_size, snapshots, filled_snapshots, [[vwap]] AS avg_sweep_vwap, [[slip]] AS avg_slippage_bps, [[levels]] AS avg_levels_consumed, [[fill]] AS avg_fill_ratio FROM costs"


@_query(f"WITH {_sweep_sql('buy', '2e0')} {_COST.format(side='buy')}")
def sweep_cost_buy(spark, sf_dir):
    return book.sweep_cost(adapters.book(spark, sf_dir), "buy", 2.0)


@_query(f"WITH {_sweep_sql('sell', '3e0')} {_COST.format(side='sell')}")
def sweep_cost_sell(spark, sf_dir):
    return book.sweep_cost(adapters.book(spark, sf_dir), "sell", 3.0)


SIZES = [0.2, 0.3, 0.4, 3.0, 30.0]
_CURVE = f"""WITH {_sweep_sql('buy', ', '.join(f'{s}e0' for s in SIZES))},
    depth AS (SELECT avg(d) AS depth FROM (SELECT sum(size) AS d FROM t_book WHERE side = 'ask' GROUP BY ts_ns)),
    points AS (SELECT *, q / depth AS p, floor(slip * 1e8 + 0.5) / 1e8 AS y, fill >= 1 - 1e-9 AS fitted FROM costs, depth),
    fit AS (SELECT sum(sqrt(p) * y) / sum(p) AS coef, avg(y) AS mean, count(*) AS n FROM points WHERE fitted),
    errs AS (SELECT sum((y - coef * sqrt(p)) ** 2) AS res, sum((y - mean) ** 2) AS tot FROM points, fit WHERE fitted)"""


@_query(f"""{_CURVE} SELECT 'buy' AS side, q AS order_size, snapshots, [[depth]] AS avg_depth, [[p]] AS participation, [[y]] AS measured_bps, [[coef * sqrt(p)]] AS modelled_bps, [[y - coef * sqrt(p)]] AS residual_bps,
    [[fill]] AS fill_ratio, fitted FROM points, fit""")
def sweep_curve(spark, sf_dir):
    rows = book.sweep_curve(adapters.book(spark, sf_dir), "buy", SIZES)
    return rows.select("side", "order_size", "snapshots", "avg_depth", "participation", "measured_bps", "modelled_bps", "residual_bps", "fill_ratio", "fitted")


@_query(f"{_CURVE} SELECT CAST({len(SIZES)} AS BIGINT) AS points, n AS fitted_points, [[coef]] AS coef_bps, [[sqrt(res / n)]] AS rmse_bps, [[CASE WHEN tot = 0 THEN 0 ELSE 1 - res / tot END]] AS r_squared FROM fit, errs")
def sweep_curve_fit(spark, sf_dir):
    return book.sweep_curve(adapters.book(spark, sf_dir), "buy", SIZES).select("points", "fitted_points", "coef_bps", "rmse_bps", "r_squared").distinct()


HOUR = 3_600_000_000_000
GRID = [7200.0, 14400.0, 28800.0]


def _thin_sql(rows: str) -> str:
    """Recursion over kept snapshots, independent of the engine's fold."""
    return f"""times AS (SELECT DISTINCT session_id, ts_ns FROM t_book), starts AS (SELECT session_id, min(ts_ns) AS t0 FROM times GROUP BY ALL), grid(every_s, phase, every_ns, offset_ns) AS (VALUES {rows}),
        kept AS (SELECT session_id, every_s, phase, every_ns, (SELECT min(t.ts_ns) FROM times t WHERE t.session_id = starts.session_id AND t.ts_ns >= t0 + offset_ns) AS ts_ns FROM starts, grid
            UNION ALL SELECT k.session_id, k.every_s, k.phase, k.every_ns, (SELECT min(t.ts_ns) FROM times t WHERE t.session_id = k.session_id AND t.ts_ns >= k.ts_ns + k.every_ns) FROM kept k WHERE k.ts_ns IS NOT NULL)"""


def _grid_values(phases: int) -> str:
    return ", ".join(f"({g}e0, {k}, {int(g * 1e9)}, {int(g * 1e9) * k // phases})" for g in GRID for k in range(phases))


_R8 = "(sign({x}) * floor(abs({x}) * 1e8 + 0.5) / 1e8)"
_r = lambda x: _R8.format(x=x)
_FIGURES = f"""count(*) AS snapshots, {_r('avg(bd)')} AS bd, {_r('avg(ad)')} AS ad, {_r('avg((bd - ad) / (bd + ad))')} AS di, {_r('avg(ap - bp)')} AS sp, {_r('avg(bq)')} AS bq, {_r('avg(aq)')} AS aq, {_r('avg((bq - aq) / (bq + aq))')} AS qi"""


def _grid_sql(phases: int) -> str:
    return f"""WITH RECURSIVE {_thin_sql(_grid_values(phases))},
        whole AS (SELECT session_id, {_FIGURES} FROM {_SNAPS} GROUP BY ALL),
        thinned AS (SELECT session_id, every_s, phase, {_FIGURES} FROM kept JOIN {_SNAPS} USING (session_id, ts_ns) GROUP BY ALL),
        rated AS (SELECT t.*, {_r('t.sp / w.sp')} AS ratio, t.qi * w.qi > 0 AS sign_kept, w.qi AS wqi, w.di AS wdi FROM thinned t JOIN whole w USING (session_id))"""


@_query(f"WITH RECURSIVE {_thin_sql(_grid_values(1))} SELECT session_id, every_s, ts_ns FROM kept WHERE ts_ns IS NOT NULL")
def book_thin(spark, sf_dir):
    spacings = spark.createDataFrame([(g, int(g * 1e9), 0) for g in GRID], "every_s double, every_ns long, offset_ns long")
    return book.thin(adapters.book(spark, sf_dir), spacings, ["session_id"]).select("session_id", "every_s", "ts_ns")


_NAMES = "[[bd]] AS avg_bid_depth, [[ad]] AS avg_ask_depth, [[di]] AS avg_depth_imbalance, [[sp]] AS avg_spread, [[bq]] AS avg_bid_queue, [[aq]] AS avg_ask_queue, [[qi]] AS avg_queue_imbalance"


@_query(f"""{_grid_sql(1)}, rowed AS (SELECT session_id, every_s, snapshots, {_NAMES}, [[ratio]] AS spread_ratio, sign_kept AS queue_sign_kept FROM rated
    UNION ALL SELECT session_id, 0e0, snapshots, {_NAMES}, 1e0, true FROM whole)
    SELECT *, count(*) FILTER (NOT queue_sign_kept) OVER (PARTITION BY session_id) AS sign_flips FROM rowed""")
def book_grid_sweep(spark, sf_dir):
    return book.book_grid_sweep(adapters.book(spark, sf_dir), GRID, ["session_id"])


_ACROSS = f"""{_grid_sql(1)}, spaced AS (SELECT every_s, count(*) FILTER (sign_kept) AS sign_kept_books, coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER (NOT sign_kept), '') AS sign_lost_by,
    [[min(ratio)]] AS spread_ratio_min, [[max(ratio)]] AS spread_ratio_max, [[max(abs(di - wdi))]] AS imbalance_drift_max, count(*) AS books, bool_and(sign_kept) AS held FROM rated GROUP BY every_s)"""


@_query(f"{_ACROSS} SELECT *, count(*) FILTER (held) OVER () AS held_spacings FROM spaced")
def book_grid_across(spark, sf_dir):
    rows = book.book_grid_across(adapters.book(spark, sf_dir), GRID, "session_id")
    return rows.withColumn("sign_lost_by", F.array_join("sign_lost_by", ","))


_WITHOUT = "SELECT b.session_id, count(*) FILTER (lost.n - coalesce(own.n, 0) = 0) AS held_without FROM (SELECT DISTINCT session_id FROM rated) b CROSS JOIN (SELECT every_s, count(*) FILTER (NOT {kept}) AS n FROM {rows} GROUP BY every_s) lost LEFT JOIN (SELECT session_id, every_s, 1 AS n FROM {rows} WHERE NOT {kept}) own ON own.session_id = b.session_id AND own.every_s = lost.every_s GROUP BY b.session_id"


@_query(f"{_grid_sql(1)} {_WITHOUT.format(kept='sign_kept', rows='rated')}")
def book_grid_held_without(spark, sf_dir):
    books = adapters.book(spark, sf_dir)
    return book.held_without(book.book_grid_across(books, GRID, "session_id"), books, "session_id")


_PHASE = f"""{_grid_sql(4)}, phased AS (SELECT session_id, every_s, count(*) AS phases_run, min(snapshots) AS snapshots_min, max(snapshots) AS snapshots_max, min(ratio) AS rmin, max(ratio) AS rmax, min(qi) AS qmin, max(qi) AS qmax,
    count(*) FILTER (sign_kept) AS kept_n, bool_or(sign_kept) FILTER (phase = 0) AS first_kept, max(abs(wqi)) AS side, max(wqi) AS wqi FROM rated GROUP BY ALL)"""


@_query(f"""{_PHASE} SELECT session_id, every_s, phases_run, snapshots_min, snapshots_max, [[rmin]] AS spread_ratio_min, [[rmax]] AS spread_ratio_max, [[qmin]] AS queue_imbalance_min, [[qmax]] AS queue_imbalance_max,
    kept_n AS sign_kept_phases, first_kept AS first_phase_kept, [[side]] AS full_queue_imbalance_abs, [[wqi]] AS full_queue_imbalance, CASE WHEN kept_n = phases_run THEN 'held' WHEN kept_n = 0 THEN 'lost' ELSE 'split' END AS verdict,
    count(*) FILTER (kept_n = phases_run) OVER b AS held_spacings, count(*) FILTER (kept_n = 0) OVER b AS lost_spacings, count(*) FILTER (kept_n > 0 AND kept_n < phases_run) OVER b AS split_spacings FROM phased WINDOW b AS (PARTITION BY session_id)""")
def book_grid_phase(spark, sf_dir):
    return book.book_grid_phase(adapters.book(spark, sf_dir), GRID, 4, ["session_id"])


_LIST = "coalesce(string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) FILTER ({x}), '')"


@_query(f"""{_PHASE}, o AS (SELECT *, phases_run - kept_n AS missed, row_number() OVER (PARTITION BY every_s ORDER BY kept_n - phases_run, session_id) AS place, sum(phases_run - kept_n) OVER (PARTITION BY every_s ORDER BY kept_n - phases_run, session_id ROWS UNBOUNDED PRECEDING) AS run,
        sum(phases_run - kept_n) OVER (PARTITION BY every_s) AS all_missed, coalesce(max(side) FILTER (kept_n < phases_run) OVER (PARTITION BY every_s), 0) AS strongest, min(side) FILTER (kept_n = phases_run) OVER (PARTITION BY every_s) AS faintest FROM phased),
    f AS (SELECT every_s, count(*) FILTER (missed = 0) AS held_books, {_LIST.format(x='kept_n = 0')} AS lost_by, {_LIST.format(x='kept_n > 0 AND missed > 0')} AS split_by, {_LIST.format(x='missed > 0')} AS not_held_by, count(*) FILTER (first_kept) AS first_phase_books,
        CAST(sum(kept_n) AS BIGINT) AS kept_starts, CAST(sum(phases_run) AS BIGINT) AS starts_run, max(missed) AS most_missed, arg_min(session_id, place) AS most_missed_book, max(missed) FILTER (place = 2) AS next_most_missed,
        CAST(sum(kept_n) FILTER (place > 1) AS BIGINT) AS kept_without_weakest, CAST(sum(phases_run) FILTER (place > 1) AS BIGINT) AS run_without_weakest, coalesce(min(place) FILTER (2 * run >= all_missed AND all_missed > 0), 0) AS half_missed_by,
        [[max(strongest)]] AS strongest_side_missed, [[coalesce(max(faintest), 0)]] AS faintest_side_held, count(*) FILTER (missed = 0 AND side <= strongest) AS held_no_clearer, count(*) FILTER (missed > 0 AND side >= faintest) AS missed_no_fainter,
        arg_min(session_id, (-side, session_id)) FILTER (missed > 0) AS strongest_missed_book, arg_min(session_id, (side, session_id)) FILTER (missed = 0) AS faintest_held_book, [[max(side) FILTER (place = 1 AND missed > 0)]] AS most_missed_side,
        [[min(side) FILTER (missed > 0)]] AS faintest_side_missed, count(*) AS books, bool_and(missed = 0) AS held FROM o GROUP BY every_s)
    SELECT *, count(*) FILTER (held) OVER () AS held_spacings, count(*) FILTER (first_phase_books = books) OVER () AS first_phase_held_spacings FROM f""")
def book_grid_phase_across(spark, sf_dir):
    rows = book.book_grid_phase_across(adapters.book(spark, sf_dir), GRID, 4, "session_id")
    return rows.select(*[F.array_join(c, ",").alias(c) if c in ("lost_by", "split_by", "not_held_by") else F.col(c) for c in rows.columns])


@_query(f"{_PHASE} {_WITHOUT.format(kept='(kept_n = phases_run)', rows='phased')}")
def book_grid_phase_held_without(spark, sf_dir):
    books = adapters.book(spark, sf_dir)
    return book.held_without(book.book_grid_phase_across(books, GRID, 4, "session_id"), books, "session_id", "not_held_by")


_UPDATES = "event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, floor(value / 20) * 20 + 100 + event_id % 2 AS price, (event_id * 7 % 5) * 1e0 AS size"


@_query(f"""WITH u AS (SELECT {_NS} AS ts_ns, {_UPDATES} FROM events), a AS (SELECT max(ts_ns) AS seen_at FROM t_ticks GROUP BY session_id),
    f AS (SELECT seen_at, side, price, arg_max(size, seq) AS size FROM a JOIN u ON ts_ns <= seen_at GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY seen_at, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) - 1 AS level FROM f WHERE size > 0)
    SELECT seen_at AS ts_ns, 'EVT' AS product, side, level, [[price]] AS price, [[size]] AS size FROM r WHERE level < 3""")
def l2_top_levels(spark, sf_dir):
    rows = adapters._events(spark, sf_dir)
    updates = rows.selectExpr("'EVT' AS product", "ts_ns", *_UPDATES_SPARK)
    at = adapters.ticks(spark, sf_dir).groupBy("session_id").agg(F.max("ts_ns").alias("ts_ns")).select(F.lit("EVT").alias("product"), "ts_ns")
    return live.l2_levels(updates, at, 3)


_UPDATES_SPARK = ["event_id AS seq", "if(event_id % 2 = 0, 'bid', 'ask') AS side", "floor(value / 20) * 20e0 + 100 + event_id % 2 AS price", "(event_id * 7 % 5) * 1e0 AS size"]


_SEEDS = "event_id % 1000 = 999"
#: Top three levels after each message: every level's last size since the newest snapshot, at every message.
_MOVES = f"""WITH RECURSIVE u AS (SELECT {_NS} AS ts_ns, {_UPDATES}, {_SEEDS} AS seeds FROM events),
    m AS (SELECT *, count(*) FILTER (seeds) OVER (ORDER BY seq) AS epoch FROM u), l AS (SELECT DISTINCT side AS s, price AS p FROM u),
    g AS (SELECT seq, ts_ns, seeds, epoch, s, p, CASE WHEN s = side AND p = price THEN size END AS z FROM m, l),
    h AS (SELECT *, last_value(z IGNORE NULLS) OVER (PARTITION BY epoch, s, p ORDER BY seq) AS size FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq, s ORDER BY CASE WHEN s = 'bid' THEN -p ELSE p END) AS nth FROM h WHERE size > 0),
    t AS (SELECT seq, ts_ns, list((s, p, size) ORDER BY s, nth) AS said FROM r WHERE nth <= 3 AND NOT seeds GROUP BY seq, ts_ns HAVING count(DISTINCT s) = 2),
    @WRITTEN SELECT ts_ns, 'EVT' AS product, s AS side, nth - 1 AS level, [[p]] AS price, [[size]] AS size FROM k JOIN r USING (seq, ts_ns) WHERE nth <= 3"""


def _l2_messages(spark, sf_dir):
    rows = adapters._events(spark, sf_dir, stream=True)
    return rows.selectExpr("'EVT' AS product", "ts_ns", *_UPDATES_SPARK, f"{_SEEDS} AS snapshot")


@_query(_MOVES.replace("@WRITTEN", "k AS (SELECT seq, ts_ns FROM (SELECT *, lag(said) OVER (ORDER BY seq) AS before FROM t) WHERE before IS NULL OR said <> before)"))
def l2_stream(spark, sf_dir):
    """The book as state over a stream of its updates: written when its top levels moved, seeded anew by every thousandth message."""
    return to_table(book_stream.l2_stream(_l2_messages(spark, sf_dir), 3), mode="append")


@_query(_MOVES.replace("@WRITTEN", """w AS (SELECT min(ts_ns) AS ts_ns FROM t UNION ALL SELECT (SELECT min(t.ts_ns) FROM t WHERE t.ts_ns >= w.ts_ns + 3600000000000) FROM w WHERE w.ts_ns IS NOT NULL),
    k AS (SELECT seq, ts_ns FROM t JOIN w USING (ts_ns))"""))
def l2_stream_hourly(spark, sf_dir):
    """The same book, written on a grid of an hour."""
    return to_table(book_stream.l2_stream(_l2_messages(spark, sf_dir), 3, every=3600.0), mode="append")


# impact and calibration


@_query("""SELECT 'EVT' AS product, count(*) AS slices, 10e0 AS coef_bps, 20e0 AS perm_coef_bps, [[avg(sqrt(participation) * 10)]] AS avg_impact_bps, [[max(sqrt(participation) * 10)]] AS max_impact_bps, [[sum(sqrt(participation) * 10)]] AS total_impact_bps,
    [[avg(participation * 20)]] AS avg_perm_impact_bps, [[sum(participation * 20)]] AS total_perm_impact_bps, [[sum(sqrt(participation) * 10 + participation * 20)]] AS total_cost_bps FROM t_samples""")
def impact_curve(spark, sf_dir):
    return impact.impact_curve(adapters.samples(spark, sf_dir), 10.0, 20.0)


def _fit_sql(passes: int, delta: float | None, ridge: float) -> str:
    """Chained fits: w0 has weight 1; each further pass weighs by the residuals of the one before."""
    steps, previous = [], None
    for k in range(passes):
        c, m = (f"c{k - 1}", f"m{k - 1}") if k else ("", "")
        res = f"abs(realised_bps - {c} * sqrt(participation) - {m} * participation)"
        weight = f"CASE WHEN {res} <= {delta} THEN 1e0 ELSE {delta} / {res} END" if k else "1e0"
        steps.append(
            f"""w{k} AS (SELECT participation AS p, realised_bps AS y, {weight} AS w FROM t_samples{f', f{k - 1}' if k else ''}),
            s{k} AS (SELECT sum(w * p) + {ridge} AS a, sum(w * p * sqrt(p)) AS b, sum(w * p * p) + {ridge} AS d, sum(w * sqrt(p) * y) AS e, sum(w * p * y) AS g FROM w{k}),
            f{k} AS (SELECT (d * e - b * g) / (a * d - b * b) AS c{k}, (a * g - b * e) / (a * d - b * b) AS m{k} FROM s{k})"""
        )
        previous = k
    last = f"""q AS (SELECT count(*) AS n, sum((realised_bps - c{previous} * sqrt(participation) - m{previous} * participation) ** 2) AS res, sum((realised_bps - mean) ** 2) AS tot
        FROM t_samples, f{previous}, (SELECT avg(realised_bps) AS mean FROM t_samples))"""
    return f"WITH {', '.join(steps)}, {last} SELECT 'EVT' AS product, n AS samples, [[c{previous}]] AS coef_bps, [[m{previous}]] AS perm_coef_bps, [[sqrt(res / n)]] AS rmse_bps, [[1 - res / tot]] AS r_squared FROM q, f{previous}"


@_query(_fit_sql(1, None, 0))
def calibrate_impact(spark, sf_dir):
    return impact.calibrate_impact(adapters.samples(spark, sf_dir))


@_query(_fit_sql(8, 0.15, 0))
def calibrate_robust_huber(spark, sf_dir):
    return impact.calibrate_impact_robust(adapters.samples(spark, sf_dir), huber_delta=0.15)


@_query(_fit_sql(1, None, 0.01))
def calibrate_ridge(spark, sf_dir):
    return impact.calibrate_impact_robust(adapters.samples(spark, sf_dir), ridge_lambda=0.01)


@_query("""WITH o AS (SELECT session_id, sum(size) / 10 AS q, sum(size) / 6 AS v, stddev_pop(price) / avg(price) * 100 AS sigma FROM t_ticks GROUP BY session_id),
    g AS (SELECT u / 10e0 AS k, i, exp(-(u / 10e0) * i / 6) AS raw FROM range(41) a(u), range(6) b(i)),
    w AS (SELECT k, i, raw / sum(raw) OVER (PARTITION BY k) AS w FROM g),
    p AS (SELECT *, w * q AS size, w * q / v AS p, 1 - sum(w) OVER (PARTITION BY session_id, k ORDER BY i) AS remaining FROM w, o),
    s AS (SELECT session_id, k, sum(sqrt(p) * 25 * w + p * 5 * w) AS impact, any_value(sigma) * sqrt(sum(remaining ** 2) / 6) AS risk FROM p GROUP BY session_id, k HAVING max(p) <= 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY floor((impact + risk) * 1e8 + 0.5), k) AS place FROM s), t AS (SELECT session_id, impact AS ti, risk AS tr FROM s WHERE k = 0)
    SELECT session_id, k AS urgency, [[impact]] AS impact_bps, [[risk]] AS risk_bps, [[impact + risk]] AS total_bps, [[ti]] AS twap_impact_bps, [[tr]] AS twap_risk_bps, [[ti + tr]] AS twap_total_bps, [[ti + tr - impact - risk]] AS saving_bps,
        CAST(i AS INTEGER) AS slice, [[w]] AS weight, [[size]] AS size, [[p]] AS participation, [[sqrt(p) * 25 * w]] AS temp_bps, [[p * 5 * w]] AS perm_bps, [[remaining]] AS remaining FROM p JOIN b USING (session_id, k) JOIN t USING (session_id) WHERE place = 1""")
def optimal_schedule(spark, sf_dir):
    """A tenth of each session's volume in six slices, by the session's own volume and spread of prices."""
    volume = F.sum("size")
    orders = adapters.ticks(spark, sf_dir).groupBy("session_id").agg((volume / 10).alias("total_size"), (volume / 6).alias("per_slice_volume"), (F.stddev_pop("price") / F.avg("price") * 100).alias("sigma_bps"))
    return impact.optimal_schedules(orders, 6, 25.0, 5.0, ["session_id"])


# post-trade


# every order's fill; the parent is a quarter more than what is filled, however many orders there are


@_query("""WITH a AS (SELECT *, qty / interval_volume AS p, qty / sum(qty) OVER () AS w, (price - 100) / 100 * 1e4 AS r FROM t_fills),
    b AS (SELECT count(*) AS n, sum(qty) AS filled, 1.25e0 * sum(qty) AS parent, sum(qty * price) / sum(qty) AS px, arg_max(price, ts_ns) AS last, sum(w * r) AS realised, sum(w * (25 * sqrt(p) + 5 * p)) AS modelled FROM a),
    c AS (SELECT *, parent - filled AS unfilled, (parent - filled) / parent * (last - 100) / 100 * 1e4 AS missed FROM b)
    SELECT 'EVT' AS product, 'buy' AS side, n AS fills, parent AS parent_qty, [[filled]] AS filled_qty, [[unfilled]] AS unfilled_qty, [[filled / parent]] AS fill_rate, 100e0 AS arrival_price, [[px]] AS avg_price, [[last]] AS final_price, [[realised]] AS realised_bps,
        [[modelled]] AS modelled_bps, [[realised - modelled]] AS residual_bps, [[missed]] AS opportunity_bps, [[filled / parent * realised + missed]] AS total_bps FROM c""")
def shortfall(spark, sf_dir):
    rows = adapters.fills(spark, sf_dir)
    return fills.shortfall(rows, 1.25 * rows.agg(F.sum("qty")).first()[0], 100.0, COEF, PERM)


@_query("""SELECT ts_ns, [[qty / interval_volume]] AS participation, [[qty / sum(qty) OVER ()]] AS weight, [[(price - 100) / 100 * 1e4]] AS realised_bps, [[25 * sqrt(qty / interval_volume) + 5 * qty / interval_volume]] AS modelled_bps,
    [[(price - 100) / 100 * 1e4 - 25 * sqrt(qty / interval_volume) - 5 * qty / interval_volume]] AS residual_bps FROM t_fills""")
def shortfall_slices(spark, sf_dir):
    rows = fills.shortfall_slices(adapters.fills(spark, sf_dir), 100.0, COEF, PERM)
    return rows.select("ts_ns", "participation", "weight", *[F.col(c).alias(f"{c}_bps") for c in ("realised", "modelled", "residual")])


def _strategy_sql(coefs: str) -> str:
    return f"""WITH f AS (SELECT *, sum(qty) OVER () AS filled, sum(interval_volume) OVER () AS traded, count(*) OVER () AS n FROM t_fills),
        s AS (SELECT 'realised' AS name, 0 AS place, qty AS q, * FROM f UNION ALL SELECT 'twap', 1, filled / n, * FROM f UNION ALL SELECT 'volume', 2, filled * interval_volume / traded, * FROM f),
        r AS (SELECT coef, name, place, max(n) AS n, sum(q) AS qty, sum(q / filled * (price - 100) / 100 * 1e4) AS drift, sum(q / filled * (coef * sqrt(q / interval_volume) + 5 * q / interval_volume)) AS impact FROM s, (SELECT unnest([{coefs}]) AS coef) GROUP BY coef, name, place),
        k AS (SELECT *, floor((drift + impact) * 1e8 + 0.5) / 1e8 AS cost FROM r),
        b AS (SELECT coef, max(cost) FILTER (place = 0) AS made, min(cost) FILTER (place > 0) AS best, arg_min(name, (cost, place)) FILTER (place > 0) AS who FROM k GROUP BY coef)"""


@_query(f"{_strategy_sql('25e0')} SELECT 'EVT' AS product, 'buy' AS side, n AS intervals, 100e0 AS arrival_price, name, [[qty]] AS qty, [[drift]] AS drift_bps, [[impact]] AS impact_bps, [[cost]] AS cost_bps, who AS best_alternative, [[best - made]] AS edge_bps FROM k JOIN b USING (coef)")
def counterfactual(spark, sf_dir):
    return fills.counterfactual(adapters.fills(spark, sf_dir), 100.0, COEF, PERM)


@_query(f"""{_strategy_sql('25e0')} SELECT name, ts_ns, [[q]] AS qty, [[price]] AS price, [[interval_volume]] AS interval_volume, [[q / interval_volume]] AS participation, [[q / filled]] AS weight, [[(price - 100) / 100 * 1e4]] AS drift_bps,
    [[25 * sqrt(q / interval_volume) + 5 * q / interval_volume]] AS impact_bps, [[(price - 100) / 100 * 1e4 + 25 * sqrt(q / interval_volume) + 5 * q / interval_volume]] AS cost_bps FROM s""")
def counterfactual_legs(spark, sf_dir):
    return fills.counterfactual_legs(adapters.fills(spark, sf_dir), 100.0, COEF, PERM)


COEFS = [5.0, 10.0, 20.0, 30.0, 40.0]


@_query(f"""{_strategy_sql(', '.join(f'{c}e0' for c in COEFS))}, e AS (SELECT *, best - made AS edge, lead(best - made) OVER o AS ne, lead(coef) OVER o AS nc FROM b WINDOW o AS (ORDER BY coef)),
    t AS (SELECT min(edge) AS lo, max(edge) AS hi, count(*) FILTER (edge * ne < 0) AS flips, arg_min(coef + (nc - coef) * -edge / (ne - edge), coef) FILTER (edge * ne < 0) AS be,
        count(DISTINCT who) = 1 AND (min(edge) > 0 OR max(edge) < 0) AS stable FROM e)
    SELECT 'EVT' AS product, coef AS coef_bps, [[made]] AS realised_cost_bps, who AS best_alternative, [[best]] AS best_cost_bps, [[edge]] AS edge_bps, [[lo]] AS edge_min_bps, [[hi]] AS edge_max_bps, flips AS sign_flips, [[be]] AS breakeven_coef_bps, stable AS verdict_stable FROM e, t""")
def sensitivity(spark, sf_dir):
    return fills.sensitivity(adapters.fills(spark, sf_dir), 100.0, COEFS, PERM)


def _fill_sql(algo: str) -> str:
    qty = "greatest(0, least(0.2 * volume, 60 - coalesce(sum(0.2 * volume) OVER b, 0)))" if algo == "pov" else "60e0 / count(*) OVER (PARTITION BY session_id)"
    return f"""{algo}_q AS (SELECT *, {qty} AS qty FROM (SELECT session_id, ts_ns // {BAR_NS} AS bucket, sum(size) AS volume, sum(price * size) / sum(size) AS vwap FROM t_ticks GROUP BY ALL)
            WINDOW b AS (PARTITION BY session_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        {algo}_p AS (SELECT *, vwap * (1 + coalesce(sum(20 * 1e-4 * qty / volume) OVER b, 0)) * (1 + 10 * 1e-4 * sqrt(qty / volume)) AS price FROM {algo}_q WHERE qty > 0
            WINDOW b AS (PARTITION BY session_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        {algo}_r AS (SELECT session_id, '{algo}' AS algo, count(*) AS fills, sum(qty) AS filled, sum(qty * price) / sum(qty) AS px, arrival, v FROM {algo}_p
            JOIN (SELECT session_id, arg_min(price, (ts_ns, trade_id)) AS arrival, sum(price * size) / sum(size) AS v FROM t_ticks GROUP BY ALL) USING (session_id) GROUP BY ALL)"""


_FILL = "SELECT session_id, 'buy' AS side, 60e0 AS parent_qty, [[filled]] AS filled_qty, [[px]] AS avg_price, [[arrival]] AS arrival_price, round((px - arrival) / arrival * 1e4, 4) AS is_bps, {full} AS fully_filled, fills FROM {algo}_r"
_COSTS = {"impact_bps": 10.0, "impact_model": "sqrt", "perm_impact_bps": 20.0}


@_query(f"WITH {_fill_sql('pov')} {_FILL.format(algo='pov', full='60 - filled <= 1e-12')}")
def pov_fill(spark, sf_dir):
    return fills.pov_fill(adapters.ticks(spark, sf_dir), side="buy", parent_qty=60.0, participation=0.2, bucket_ns=BAR_NS, keys=["session_id"], **_COSTS)


@_query(f"WITH {_fill_sql('twap')} {_FILL.format(algo='twap', full='true')}")
def twap_fill(spark, sf_dir):
    return fills.twap_fill(adapters.ticks(spark, sf_dir), side="buy", parent_qty=60.0, bucket_ns=BAR_NS, keys=["session_id"], **_COSTS)


_EVAL = "SELECT session_id, algo, [[v]] AS benchmark_vwap, 'buy' AS side, 60e0 AS parent_qty, [[px]] AS avg_price, round((px - v) / v * 1e4, 4) AS slippage_vs_vwap_bps, round((px - arrival) / arrival * 1e4, 4) AS is_bps, algo = 'twap' OR 60 - filled <= 1e-12 AS fully_filled FROM {algo}_r"


@_query(f"WITH {_fill_sql('pov')}, {_fill_sql('twap')} {_EVAL.format(algo='pov')} UNION ALL {_EVAL.format(algo='twap')}")
def evaluate(spark, sf_dir):
    return fills.evaluate(adapters.ticks(spark, sf_dir), side="buy", parent_qty=60.0, participation=0.2, bucket_ns=BAR_NS, keys=["session_id"], **_COSTS)


_CHILD = "SELECT session_id, bucket * {ns} AS bucket_ns, [[qty]] AS qty, [[price]] AS price FROM {algo}_p"


@_query(f"WITH {_fill_sql('pov')} {_CHILD.format(ns=BAR_NS, algo='pov')}")
def pov_fill_schedule(spark, sf_dir):
    rows = fills.pov_schedule_fills(adapters.ticks(spark, sf_dir), side="buy", parent_qty=60.0, participation=0.2, bucket_ns=BAR_NS, keys=["session_id"], **_COSTS)
    return rows.select("session_id", "bucket_ns", "qty", "price")


@_query(f"WITH {_fill_sql('twap')} {_CHILD.format(ns=BAR_NS, algo='twap')}")
def twap_fill_schedule(spark, sf_dir):
    rows = fills.twap_schedule_fills(adapters.ticks(spark, sf_dir), side="buy", parent_qty=60.0, bucket_ns=BAR_NS, keys=["session_id"], **_COSTS)
    return rows.select("session_id", "bucket_ns", "qty", "price")


# volume-following plans

_PROFILE = f"""prof AS (SELECT *, session_id - min(session_id) OVER () AS idx, bucket - min(bucket) OVER s AS slot, volume / sum(volume) OVER s AS share, sum(volume) OVER s AS total, count(*) OVER s AS slots,
        floor(sum(vwap * volume) OVER s / sum(volume) OVER s * 1e8 + 0.5) / 1e8 AS sv
    FROM (SELECT session_id, ts_ns // {SLOT_NS} AS bucket, sum(size) AS volume, sum(price * size) / sum(size) AS vwap FROM t_ticks GROUP BY ALL) WINDOW s AS (PARTITION BY session_id))"""


@_query(f"""WITH {_PROFILE} SELECT session_id, slots, [[any_value(total)]] AS total_volume, [[10 / any_value(total)]] AS participation, [[any_value(sv)]] AS session_vwap, [[sum(share * vwap)]] AS pov_price,
    [[sum(share * (25 * sqrt(10 / total) + 5 * 10 / total))]] AS pov_impact_bps, [[avg(vwap)]] AS twap_price, [[(avg(vwap) - any_value(sv)) / any_value(sv) * 1e4]] AS twap_tracking_bps,
    [[avg(25 * sqrt(10e0 / slots / volume) + 5 * 10e0 / slots / volume)]] AS twap_impact_bps, [[max(10e0 / slots / volume)]] AS twap_max_participation,
    [[avg(25 * sqrt(10e0 / slots / volume) + 5 * 10e0 / slots / volume) - sum(share * (25 * sqrt(10 / total) + 5 * 10 / total))]] AS edge_bps FROM prof GROUP BY session_id, slots""")
def pov_schedule(spark, sf_dir):
    rows = pov.pov_schedule(adapters.ticks(spark, sf_dir), SLOT_NS, 10.0, 1.0, COEF, PERM, ["session_id"])
    return rows.select(
        "session_id", "slots", "total_volume", "participation", "session_vwap", "pov_price", "pov_impact_bps", "twap_price", "twap_tracking_bps", "twap_impact_bps", "twap_max_participation", "edge_bps"
    ).distinct()


@_query(f"""WITH {_PROFILE} SELECT session_id, bucket * {SLOT_NS} AS bucket_ns, [[volume]] AS volume, [[share]] AS volume_share, [[vwap]] AS vwap, [[share * 10]] AS size, [[share * 25 * sqrt(10 / total)]] AS temp_bps, [[share * 5 * 10 / total]] AS perm_bps FROM prof""")
def pov_schedule_slots(spark, sf_dir):
    rows = pov.pov_schedule(adapters.ticks(spark, sf_dir), SLOT_NS, 10.0, 1.0, COEF, PERM, ["session_id"])
    return rows.select("session_id", "bucket_ns", "volume", "volume_share", "vwap", "size", "temp_bps", "perm_bps")


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """The ticks, and the days that have any, in order."""
    rows = adapters.ticks(spark, sf_dir)
    return rows, sorted(r["session_id"] for r in rows.select("session_id").distinct().collect())  # a row per session


def _priced_sql(folds: list[tuple[int, list[int]]], caps: list[float], half_lives: list[float], parent: str, shares: list[float] = [0.0]) -> str:
    """Plans of all folds priced: carrying by the recursion's closed form, reshaping by the prefix of pinned slots."""
    members = ", ".join(f"({f}, {i}, {m}, {len(h) - 1 - k})" for f, (i, h) in enumerate(folds) for k, m in enumerate(h))
    hls = ", ".join(f"{h}e0" for h in half_lives)
    pooled = f"""SELECT fold, input, hl, 'forecast' AS plan, slot, sum(w * share) / sum(w) AS ps FROM (SELECT *, CASE WHEN hl = 0 THEN 1e0 ELSE pow(0.5e0, age / CASE WHEN hl = 0 THEN 1e0 ELSE hl END) END AS w FROM hist, (SELECT unnest([{hls}]) AS hl)) GROUP BY ALL
            UNION ALL """ if half_lives else ""
    return f"""WITH {_PROFILE}, mem(fold, input, member, age) AS (VALUES {members}), cps AS (SELECT unnest([{', '.join(f'{c}e0' for c in caps)}]) AS cap), shs AS (SELECT unnest([{', '.join(f'{x}e0' for x in shares)}]) AS psh),
        hist AS (SELECT mem.*, slot, share, total FROM mem JOIN prof ON idx = member),
        plans AS ({pooled}SELECT fold, input, -1e0 AS hl, 'naive' AS plan, slot, share AS ps FROM hist WHERE age = 0),
        par AS (SELECT fold, psh, {parent} AS q FROM (SELECT DISTINCT fold, member, total FROM hist), shs GROUP BY fold, psh),
        x AS (SELECT fold, input, psh, cap, hl, plan, plans.slot, bucket, ps, volume, vwap, share AS es, sv, q, total, cap * volume / ps AS ratio FROM plans JOIN par USING (fold) JOIN prof ON prof.idx = input AND prof.slot = plans.slot, cps),
        y AS (SELECT *, sum(ps * q - cap * volume) OVER o AS walk FROM x WINDOW o AS (PARTITION BY fold, psh, cap, hl, plan ORDER BY slot)),
        z AS (SELECT *, walk - least(0, min(walk) OVER o) AS carry FROM y WINDOW o AS (PARTITION BY fold, psh, cap, hl, plan ORDER BY slot)),
        c AS (SELECT *, ps * q + coalesce(lag(carry) OVER o, 0) - carry AS cf FROM z WINDOW o AS (PARTITION BY fold, psh, cap, hl, plan ORDER BY slot)),
        l AS (SELECT *, (q - coalesce(sum(cap * volume) OVER b, 0)) / sum(ps) OVER a AS lam FROM c
            WINDOW b AS (PARTITION BY fold, psh, cap, hl, plan ORDER BY ratio, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY fold, psh, cap, hl, plan ORDER BY ratio, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        m AS (SELECT *, arg_min(lam, ratio) FILTER (lam * ps <= cap * volume) OVER (PARTITION BY fold, psh, cap, hl, plan) AS lam0 FROM l),
        d AS (SELECT *, CASE WHEN lam0 IS NULL OR lam0 * ps > cap * volume THEN cap * volume ELSE lam0 * ps END AS sf FROM m),
        priced AS (SELECT fold, input, psh, cap, hl, plan, any_value(q) AS q, any_value(sv) AS sv, any_value(total) AS total, count(*) AS slots, sum(abs(ps - es)) / 2 AS distance, sum(ps * vwap) AS price, sum(ps * (25 * sqrt(ps * q / volume) + 5 * ps * q / volume)) AS impact, max(ps * q / volume) AS most,
            25 * sqrt(any_value(q / total)) + 5 * any_value(q / total) AS oracle, sum(cf) AS c_filled, arg_max(carry, slot) AS c_left, sum(cf * vwap) / sum(cf) AS c_price, sum(cf / q * (25 * sqrt(cf / volume) + 5 * cf / volume)) AS c_impact, max(cf / volume) AS c_most, count(*) FILTER (carry > 0) AS c_capped,
            sum(sf) AS s_filled, CASE WHEN any_value(lam0) IS NULL THEN any_value(q) - sum(sf) ELSE 0e0 END AS s_left, sum(sf * vwap) / sum(sf) AS s_price, sum(sf / q * (25 * sqrt(sf / volume) + 5 * sf / volume)) AS s_impact, max(sf / volume) AS s_most,
            count(*) FILTER (lam0 IS NULL OR lam0 * ps > cap * volume) AS s_capped FROM d GROUP BY fold, input, psh, cap, hl, plan),
        {', '.join(_gain_sql(arm, name) for arm, name in (('c', 'be'), ('s', 'bes')))},
        cell AS (SELECT fold, psh, cap, any_value(q) AS q, max(imp) FILTER (hl = 0) AS flat, min(imp) FILTER (hl > 0) AS lo, max(imp) FILTER (hl > 0) AS hi FROM be GROUP BY fold, psh, cap),
        verd AS (SELECT *, NOT (hi > 0 AND lo < 0) AS stable, flat = 0 AND hi = 0 AND lo = 0 AS inert, CASE WHEN flat = 0 AND hi = 0 AND lo = 0 THEN 'inert' WHEN hi > 0 AND lo < 0 THEN 'unstable' WHEN hi > 0 THEN 'gain' WHEN lo < 0 THEN 'loss' WHEN flat > 0 THEN 'gain' ELSE 'loss' END AS verdict FROM cell)"""


def _gain_sql(a: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN sf <> 0 AND imp * q / sf > 0 THEN {_r('imp * q / sf')} END AS breakeven FROM (
            SELECT f.fold, f.psh, f.cap, f.hl, f.q, {_r(f'f.{a}_left')} AS fu, {_r(f'n.{a}_left')} AS nu, {_r(f'n.{a}_impact * n.q / n.{a}_filled - f.{a}_impact * f.q / f.{a}_filled')} AS imp, {_r(f'f.{a}_left - n.{a}_left')} AS sf
            FROM priced f JOIN priced n ON f.fold = n.fold AND f.psh = n.psh AND f.cap = n.cap AND f.plan = 'forecast' AND n.plan = 'naive'))"""


def _head_sql(sessions: int = DAYS) -> str:
    return f"'EVT' AS product, CAST({SLOT_NS} AS BIGINT) AS bucket_ns, CAST(24 AS BIGINT) AS buckets, CAST({sessions} AS BIGINT) AS sessions, {COEF}e0 AS coef_bps, {PERM}e0 AS perm_coef_bps"


def _arm_sql(a: str, name: str) -> str:
    return f"""[[{a}_filled]] AS {name}_filled_qty, [[{a}_left]] AS {name}_unfilled_qty, {_r(f'{a}_left')} = 0 AS {name}_completed, {a}_capped AS {name}_capped_slots, [[{a}_price]] AS {name}_price, [[({a}_price - sv) / sv * 1e4]] AS {name}_tracking_bps,
        [[{a}_impact]] AS {name}_impact_bps, [[{a}_impact * q / {a}_filled]] AS {name}_filled_impact_bps, [[{a}_most]] AS {name}_max_participation"""


_SCORE = f"""q AS parent_qty, slots, [[total]] AS exec_volume, [[distance]] AS profile_distance, [[sv]] AS session_vwap, [[price]] AS price, [[(price - sv) / sv * 1e4]] AS tracking_bps, [[impact]] AS impact_bps, [[most]] AS max_participation,
    {_r('most')} <= {_r('cap')} AS feasible, [[impact - oracle]] AS forecast_cost_bps, [[q / total]] AS oracle_participation, [[oracle]] AS oracle_impact_bps, {_r('q / total')} <= {_r('cap')} AS oracle_feasible, {_arm_sql('c', 'capped')}, {_arm_sql('s', 'spread')}"""
_SLOT = f"""slot, bucket * {SLOT_NS} AS bucket_ns, [[volume]] AS volume, [[es]] AS volume_share, [[vwap]] AS vwap, [[ps]] AS plan_share, [[ps * q]] AS size, [[ps * q / volume]] AS participation, [[ps * 25 * sqrt(ps * q / volume)]] AS temp_bps, [[ps * 5 * ps * q / volume]] AS perm_bps,
    [[cf]] AS capped_size, [[sf]] AS spread_size"""
_PAIRS = [(i, [i - 1]) for i in range(1, DAYS)]
_QTY = f"{PARENT}e0"


@_query(f"{_priced_sql(_PAIRS, CAPS, [], _QTY)} SELECT {_head_sql()}, input, cap, {_SCORE} FROM priced")
def pov_backtest(spark, sf_dir):
    """Each day's profile as the plan for the next, under three caps."""
    rows, days = _sessions(spark, sf_dir)
    return plans.backtests(rows, "session_id", days, SLOT_NS, PARENT, CAPS, COEF, PERM)


@_query(f"{_priced_sql(_PAIRS, CAPS, [], _QTY)} SELECT input, cap, {_SLOT} FROM d")
def pov_backtest_slots(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.backtest_slots(rows, "session_id", days, SLOT_NS, PARENT, CAPS, COEF, PERM)


_ONE = [(DAYS - 1, list(range(DAYS - 1)))]
_BOTH = ", ".join(
    f"(SELECT [[imp]] FROM {t}) AS {a}_improvement_bps, (SELECT [[sf]] FROM {t}) AS {a}_shortfall_qty, (SELECT sf = 0 FROM {t}) AS {a}_like_for_like, (SELECT [[breakeven]] FROM {t}) AS {a}_breakeven_bps, (SELECT [[imp - sf / q * 12e0]] FROM {t}) AS {a}_net_bps"
    for t, a in (("be", "capped"), ("bes", "spread"))
)


@_query(f"""{_priced_sql(_ONE, [0.1], [1.0], _QTY)} SELECT {_head_sql(DAYS - 1)}, 1e0 AS half_life, 12e0 AS shortfall_bps, plan, {_SCORE}, {_BOTH},
    (SELECT [[max(impact) FILTER (plan = 'naive') - max(impact) FILTER (plan = 'forecast')]] FROM priced) AS improvement_bps, false AS half_life_defaulted FROM priced""")
def pov_forecast(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.pov_forecast(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, 0.1, COEF, PERM, 1.0, shortfall_bps=12.0).drop("plan_cap")


@_query(f"{_priced_sql(_ONE, [0.1], [1.0], _QTY)} SELECT plan, {_SLOT} FROM d")
def pov_forecast_slots(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.forecast_slots(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, 0.1, COEF, PERM, 1.0)


@_query(f"SELECT place, [[pow(0.5e0, {DAYS - 2} - place) / sum(pow(0.5e0, {DAYS - 2} - place)) OVER ()]] AS weight FROM range({DAYS - 1}) r(place)")
def pov_forecast_weights(spark, sf_dir):
    _, days = _sessions(spark, sf_dir)
    return plans.forecast_weights(spark, len(days) - 1, 1.0)


@_query(f"""{_priced_sql(_ONE, [*CAPS, 0.4], [0.0], _QTY)}, pts AS (SELECT *, sf = 0 AS lfl, sf <> 0 AND breakeven IS NULL AS dom, count(*) FILTER (sf <> 0) OVER (ORDER BY cap DESC) = 0 AS onward FROM be)
    SELECT {_head_sql(DAYS - 1)}, {_QTY} AS parent_qty, 0e0 AS half_life, cap, [[fu]] AS forecast_unfilled_qty, [[nu]] AS naive_unfilled_qty, [[imp]] AS improvement_bps, [[sf]] AS shortfall_qty, lfl AS like_for_like, [[breakeven]] AS breakeven_bps, dom AS dominated,
        count(*) FILTER (lfl) OVER () AS like_for_like_points, count(*) FILTER (dom) OVER () AS dominated_points, count(breakeven) OVER () AS traded_off_points, min(cap) FILTER (onward) OVER () AS like_for_like_from_cap,
        [[min(breakeven) OVER ()]] AS breakeven_min_bps, [[max(breakeven) OVER ()]] AS breakeven_max_bps FROM pts""")
def cap_sweep(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.cap_sweep(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, [*CAPS, 0.4], COEF, PERM)


_NEWEST = " + ".join(f"pow(0.5e0, {a} / hl)" for a in range(DAYS - 1))


@_query(f"""{_priced_sql(_ONE, [0.1], [0.0, *HALF_LIVES], _QTY)} SELECT {_head_sql(DAYS - 1)}, {_QTY} AS parent_qty, 1e-1 AS cap, hl AS half_life, [[1 / ({_NEWEST})]] AS newest_weight, [[imp]] AS improvement_bps, [[sf]] AS shortfall_qty, sf = 0 AS like_for_like, [[breakeven]] AS breakeven_bps,
    sf <> 0 AND breakeven IS NULL AS dominated, [[flat]] AS flat_improvement_bps, [[lo]] AS improvement_min_bps, [[hi]] AS improvement_max_bps, [[hi - lo]] AS improvement_span_bps, stable AS sign_stable, inert,
    (SELECT hl FROM be WHERE hl > 0 ORDER BY imp DESC, hl LIMIT 1) AS best_half_life, (SELECT hl FROM be WHERE hl > 0 ORDER BY imp, hl LIMIT 1) AS worst_half_life FROM be, verd WHERE hl > 0""")
def hl_sweep(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.hl_sweep(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, 0.1, HALF_LIVES, COEF, PERM)


_PARTS = "count(*) FILTER (inert) OVER {w} AS inert_caps, count(*) FILTER (stable AND NOT inert) OVER {w} AS stable_caps, count(*) FILTER (NOT stable) OVER {w} AS unstable_caps"
_GRID = f"{_priced_sql(_ONE, CAPS, [0.0, *HALF_LIVES], _QTY)}"


@_query(f"""{_GRID} SELECT {_head_sql(DAYS - 1)}, {_QTY} AS parent_qty, cap, [[flat]] AS flat_improvement_bps, [[lo]] AS improvement_min_bps, [[hi]] AS improvement_max_bps, [[hi - lo]] AS improvement_span_bps, stable AS sign_stable, inert, verdict,
    {_PARTS.format(w='()')}, bool_and(stable) OVER () AS all_sign_stable FROM verd""")
def stability(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.stability(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, CAPS, HALF_LIVES, COEF, PERM)


@_query(f"{_GRID} SELECT cap, hl AS half_life, [[imp]] AS improvement_bps FROM be WHERE hl > 0")
def stability_points(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.stability_points(rows, "session_id", days[:-1], days[-1], SLOT_NS, PARENT, CAPS, HALF_LIVES, COEF, PERM)


# per fold the caps' parts; per cap the folds' consensus; over both, on how many caps the folds agree
_AGREED = f"""agreed AS (SELECT *, {_PARTS.format(w='f')}, CASE WHEN min(verdict) OVER c = max(verdict) OVER c THEN verdict ELSE 'mixed' END AS consensus FROM verd WINDOW f AS (PARTITION BY fold), c AS (PARTITION BY cap)),
    tally AS (SELECT count(DISTINCT cap) FILTER (consensus <> 'mixed') AS agreeing_caps, bool_and(consensus <> 'mixed') AS all_agree FROM agreed)"""
_FOLD = "cap, verdict, [[flat]] AS flat_improvement_bps, inert_caps, stable_caps, unstable_caps, consensus, agreeing_caps, all_agree"


@_query(f"{_priced_sql([(i, [j for j in range(DAYS) if j != i]) for i in range(DAYS)], CAPS, [0.0, *HALF_LIVES], _QTY)}, {_AGREED} SELECT {_head_sql()}, {_QTY} AS parent_qty, fold AS held_out, {_FOLD} FROM agreed, tally")
def holdout(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.holdout(rows, "session_id", days, SLOT_NS, PARENT, CAPS, HALF_LIVES, COEF, PERM)


def _walk(n: int, window: int | None) -> list[tuple[int, list[int]]]:
    """Each input session with its history, for the SQL."""
    return [(i, list(range(0 if window is None else i - window, i))) for i in range(2 if window is None else window, n)]


@_query(f"""{_priced_sql(_walk(DAYS, None), CAPS, [0.0, *HALF_LIVES], 'psh * avg(total)', [0.1])}, {_AGREED}
    SELECT {_head_sql()}, CAST(NULL AS BIGINT) AS "window", fold + 2 AS input, 0 AS history_from, psh AS parent_share, [[q]] AS parent_qty, {_FOLD} FROM agreed, tally""")
def walk_forward(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.walk_forward(rows, "session_id", days, SLOT_NS, None, CAPS, HALF_LIVES, COEF, PERM, parent_share=0.1)


_SWEPT = [(w, i, h[0]) for w in (None, *range(2, DAYS - 1)) for i, h in _walk(DAYS, w)]
_DISTINCT = sorted({(i, h) for _, i, h in _SWEPT})
_AT = {x: k for k, x in enumerate(_DISTINCT)}
_WALK_ROWS = ", ".join(f"({w or 0}, {i}, {h}, {_AT[i, h]}, {str(i == DAYS - 1).lower()})" for w, i, h in _SWEPT)


def _swept_sql(shares: list[float]) -> str:
    return f"""{_priced_sql([(i, list(range(h, i))) for i, h in _DISTINCT], CAPS, [0.0, *HALF_LIVES], 'psh * avg(total)', shares)}, wk(win, inp, since, fold, last) AS (VALUES {_WALK_ROWS}),
    per AS (SELECT psh, win, cap, count(*) AS folds, CASE WHEN min(verdict) = max(verdict) THEN max(verdict) ELSE 'mixed' END AS consensus, max(verdict) FILTER (last) AS lv, max(flat) FILTER (last) AS lf FROM wk JOIN verd USING (fold) GROUP BY psh, win, cap),
    caps2 AS (SELECT psh, cap, min(consensus) = max(consensus) AS cs, min(lv) = max(lv) AS ls, max(lf) - min(lf) AS span, min(consensus) = max(consensus) AND max(consensus) <> 'mixed' AS settled, any_value(consensus) AS con FROM per GROUP BY psh, cap),
    ins AS (SELECT inp, cap, count(*) AS walks, count(DISTINCT since) AS n, min(verdict) = max(verdict) AS st, {_r('max(flat) - min(flat)')} AS sp FROM wk JOIN verd USING (fold) GROUP BY inp, cap)"""


_SWEEP_HEAD = f"{_head_sql()}, CAST({len(_SWEPT)} AS BIGINT) AS folds_run, CAST({len(_DISTINCT)} AS BIGINT) AS distinct_folds"


@_query(f"""{_swept_sql([0.1])}, ic AS (SELECT cap, bool_and(st) AS every, max(sp) AS wide, arg_max(inp, (sp, inp)) AS who, count(*) FILTER (n > 1) AS compared FROM ins GROUP BY cap),
    tot AS (SELECT count(*) FILTER (settled) AS settled_caps, count(*) FILTER (ls AND NOT every) AS newest_only_caps, bool_and(settled) AS all_settled FROM caps2 JOIN ic USING (cap))
    SELECT {_SWEEP_HEAD}, win AS "window", cap, folds, consensus, lv AS last_verdict, [[lf]] AS last_flat_improvement_bps, cs AS consensus_stable, ls AS last_fold_stable, [[span]] AS last_fold_span_bps, settled,
        every AS every_input_stable, [[wide]] AS widest_span_bps, who AS widest_span_input, compared AS compared_inputs, settled_caps, newest_only_caps, all_settled FROM per JOIN caps2 USING (psh, cap) JOIN ic USING (cap), tot""")
def window_sweep(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.window_sweep(rows, "session_id", days, SLOT_NS, None, CAPS, HALF_LIVES, COEF, PERM, parent_share=0.1)


@_query(f"{_swept_sql([0.1])} SELECT inp AS input, cap, walks, n AS histories, st AS verdict_stable, [[sp]] AS span_bps FROM ins")
def window_sweep_inputs(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.window_sweep_inputs(rows, "session_id", days, SLOT_NS, None, CAPS, HALF_LIVES, COEF, PERM, parent_share=0.1)


@_query(f"""{_swept_sql(SHARES)}, per_share AS (SELECT psh, cap, CASE WHEN settled THEN con END AS settled, (SELECT lv FROM per WHERE per.psh = caps2.psh AND per.cap = caps2.cap AND win = 0) AS lv FROM caps2),
    st AS (SELECT psh AS parent_share, cap, settled, lv AS last_verdict, count(settled) OVER (PARTITION BY psh) AS settled_caps, count(settled) OVER c AS settled_at, count(settled) OVER c = {len(SHARES)} AND min(settled) OVER c = max(settled) OVER c AS share_stable, min(lv) OVER c = max(lv) OVER c AS last_share_stable
        FROM per_share WINDOW c AS (PARTITION BY cap))
    SELECT {_SWEEP_HEAD}, * REPLACE (coalesce(share_stable, false) AS share_stable), (SELECT count(DISTINCT cap) FILTER (share_stable) FROM st) AS held_caps FROM st""")
def share_sweep(spark, sf_dir):
    rows, days = _sessions(spark, sf_dir)
    return plans.share_sweep(rows, "session_id", days, SLOT_NS, SHARES, CAPS, HALF_LIVES, COEF, PERM)


# readers, writers and feeds


def _back(rows: DataFrame, label: str, extension: str, read) -> DataFrame:
    """rows written as a capture and read again."""
    path = f"{new_path(rows.sparkSession, label)}{extension}"
    sources.write_ticks(rows, path)
    return read(rows.sparkSession, path)


@_query("SELECT ts_ns, 'EVT' AS product, [[price]] AS price, [[size]] AS size, side, trade_id FROM t_ticks")
def read_ticks_ndjson(spark, sf_dir):
    return _back(adapters.ticks(spark, sf_dir).drop("session_id"), "ticks", ".ndjson", sources.read_ticks)


@_query("SELECT ts_ns, 'EVT' AS product, [[price]] AS price, [[size]] AS size, side, trade_id FROM t_ticks")
def convert_ticks(spark, sf_dir):
    """Parquet to NDJSON and back."""
    a, b, c = (f"{new_path(spark, 'convert')}{x}" for x in (".parquet", ".ndjson", ".parquet"))
    sources.write_ticks(adapters.ticks(spark, sf_dir).drop("session_id"), a)
    sources.convert(spark, a, b)
    sources.convert(spark, b, c)
    return sources.read_ticks(spark, c)


@_query("SELECT ts_ns, 'EVT' AS product, [[bid]] AS bid, [[bid_size]] AS bid_size, [[ask]] AS ask, [[ask_size]] AS ask_size FROM t_quotes")
def read_quotes_parquet(spark, sf_dir):
    return _back(adapters.quotes(spark, sf_dir).drop("session_id"), "quotes", ".parquet", sources.read_quotes)


@_query("SELECT ts_ns, 'EVT' AS product, side, level, [[price]] AS price, [[size]] AS size FROM t_book")
def read_book_parquet(spark, sf_dir):
    return _back(adapters.book(spark, sf_dir).drop("session_id"), "book", ".parquet", sources.read_book)


_SAMPLED = "SELECT o_orderkey * 1000000000 AS ts_ns, 'EVT' AS product, [[1e-2 + (o_custkey % 50) / 100e0]] AS participation"


@_query(f"{_SAMPLED} FROM orders")
def read_impact_ndjson(spark, sf_dir):
    return _back(adapters.samples(spark, sf_dir).drop("realised_bps"), "impact", ".ndjson", sources.read_impact)


@_query(f"{_SAMPLED}, [[10e0 * sqrt(1e-2 + (o_custkey % 50) / 100e0) + 20e0 * (1e-2 + (o_custkey % 50) / 100e0) + ((o_orderkey % 7) - 3) * 1e-1]] AS realised_bps FROM orders")
def read_calibration_ndjson(spark, sf_dir):
    return _back(adapters.samples(spark, sf_dir), "calibration", ".ndjson", sources.read_calibration)


@_query("SELECT ts_ns, 'EVT' AS product, 'buy' AS side, [[qty]] AS qty, [[price]] AS price, [[interval_volume]] AS interval_volume FROM t_fills")
def read_fills_ndjson(spark, sf_dir):
    return _back(adapters.fills(spark, sf_dir), "fills", ".ndjson", sources.read_fills)


_TIME = "date_format(timestamp_micros(ts_ns div 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


@_query("SELECT ts_ns, 'EVT' AS product, [[price]] AS price, [[size]] AS size, side, trade_id FROM t_ticks WHERE trade_id % 10 <> 9")
def feed_trades(spark, sf_dir):
    """Messages of a feed, one in ten of another kind, to ticks."""
    kind = "if(trade_id % 10 = 9, 'heartbeat', if(trade_id % 10 = 0, 'last_match', 'match'))"
    lines = adapters.ticks(spark, sf_dir).selectExpr(f"to_json(named_struct('type', {kind}, 'trade_id', trade_id, 'side', side, 'size', string(size), 'price', string(price), 'product_id', product, 'time', {_TIME})) as value")
    return live.match_to_tick(lines)


@_query("SELECT ts_ns, 'EVT' AS product, [[bid]] AS bid, [[bid_size]] AS bid_size, [[ask]] AS ask, [[ask_size]] AS ask_size FROM t_quotes")
def feed_quotes(spark, sf_dir):
    sides = ", ".join(f"'best_{c}', string({c})" for c in ("bid", "bid_size", "ask", "ask_size"))
    lines = adapters.quotes(spark, sf_dir).selectExpr(f"to_json(named_struct('type', 'ticker', 'product_id', product, {sides}, 'time', {_TIME})) as value")
    return live.ticker_to_quote(lines.unionByName(spark.createDataFrame([('{"type": "ticker", "product_id": "EVT"}',)], "value string")))


_ARRIVALS = "event_id AS seq, CASE WHEN event_id % 7 = 3 THEN event_id - 5 ELSE event_id END AS trade_id"


@_query(f"""WITH a AS (SELECT {_NS} AS ts_ns, {_ARRIVALS} FROM events), b AS (SELECT *, max(trade_id) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a)
    SELECT ts_ns, seq, trade_id, 'EVT' AS product FROM b WHERE before IS NULL OR trade_id > before""")
def replayed_trades(spark, sf_dir):
    rows = adapters._events(spark, sf_dir).selectExpr("ts_ns", "event_id as seq", "if(event_id % 7 = 3, event_id - 5, event_id) as trade_id", "'EVT' as product")
    return live.drop_replayed(rows)


@_query(ORACLES["replayed_trades"])
def replayed_trades_stream(spark, sf_dir):
    """The same by a keyed greatest id over a stream."""
    rows = adapters._events(spark, sf_dir, stream=True).selectExpr("ts_ns", "event_id as seq", "if(event_id % 7 = 3, event_id - 5, event_id) as trade_id", "'EVT' as product")
    return to_table(trades.rising_trades(rows), mode="append")


@_query(f"""WITH a AS (SELECT {_NS} AS ts_ns, event_id AS seq FROM events), f AS (SELECT arg_min(ts_ns, seq) AS t0 FROM a), e AS (SELECT min(seq) AS stop FROM a, f WHERE ts_ns >= t0 + 3600000000000)
    SELECT ts_ns, seq, 'EVT' AS product FROM a, e WHERE (stop IS NULL OR seq < stop) AND seq < 500 + (SELECT min(seq) FROM a)""")
def capture_bounds(spark, sf_dir):
    rows = adapters._events(spark, sf_dir).selectExpr("ts_ns", "event_id as seq", "'EVT' as product")
    return live.bound_capture(rows, count=500, seconds=3600.0)


@_query(ORACLES["capture_bounds"])
def capture_bounds_stream(spark, sf_dir):
    """The same with count and end of a capture as state."""
    rows = adapters._events(spark, sf_dir, stream=True).selectExpr("ts_ns", "event_id as seq", "'EVT' as product")
    return to_table(trades.bounded(rows, count=500, seconds=3600.0), mode="append")


@_query("""SELECT event, CAST(streams AS BIGINT) AS streams, CAST(rows AS BIGINT) AS rows FROM (SELECT * FROM (VALUES ('start', 1, 0), ('complete', 1, 0)) v(event, streams, rows) UNION ALL SELECT 'progress', 1, count(*) FROM events)""")
def stream_log(spark, sf_dir):
    """What the log of a finished stream tells."""
    folder = new_path(spark, "log")
    log = events.StreamLog(spark, folder)
    spark.streams.addListener(log)
    try:
        replayed_trades_stream(spark, sf_dir)
        found = events.ended(spark, folder, 1)
    finally:
        spark.streams.removeListener(log)
    return found.groupBy("event").agg(F.count_distinct("query").alias("streams"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
