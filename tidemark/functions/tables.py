"""Reports as table functions of SQL, over a view of ticks: SELECT * FROM tidemark_bars(300000000000)."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A report is rounded as r8() does: half away from zero on the binary value.
_R8 = "if(isnan({0}) or abs({0}) >= 90071992.54740992, {0}, signum({0}) * floor(abs({0}) * 1e8 + 0.5e0) / 1e8 + 0e0)"

_BODIES = {
    "bars": (
        "bucket_ns bigint", "session string, start_ns bigint, open double, high double, low double, close double, volume double, vwap double",
        """SELECT session, ts_ns - pmod(ts_ns, bucket_ns), min_by(price, struct(ts_ns, trade_id)), max(price), min(price), max_by(price, struct(ts_ns, trade_id)), sum(size),
            try_divide(sum(price * size), sum(size)) FROM {view} GROUP BY session, ts_ns - pmod(ts_ns, bucket_ns)""",
    ),
    "vwap": ("", "session string, ticks bigint, volume double, vwap double", "SELECT session, n, v, {r8:try_divide(pv, v)} FROM (SELECT session, count(*) AS n, sum(size) AS v, sum(price * size) AS pv FROM {view} GROUP BY session)"),
    "order_flow": (
        "", "session string, buy_volume double, sell_volume double, imbalance double",
        """SELECT session, {r8:b}, {r8:s}, {r8:coalesce(try_divide(b - s, b + s), 0e0)} FROM (
            SELECT session, coalesce(sum(CASE WHEN side = 'buy' THEN size END), 0e0) AS b, coalesce(sum(CASE WHEN side = 'sell' THEN size END), 0e0) AS s FROM {view} GROUP BY session)""",
    ),
}


def _filled(body: str, view: str) -> str:
    body = body.replace("{view}", view)
    while "{r8:" in body:
        at = body.index("{r8:")
        end = body.index("}", at)
        body = body[:at] + _R8.format(f"({body[at + 4 : end]})") + body[end + 1 :]
    return body


def register(ticks: DataFrame, key: str, prefix: str = "tidemark") -> list[str]:
    """Make temporary functions <prefix>_bars(bucket_ns), <prefix>_vwap() and <prefix>_order_flow() over the ticks, sessions told apart by `key`; their names.

    They are views with parameters: Spark plans the query with the function's body in place, so filters reach the ticks, and all runs in the JVM.
    """
    spark = ticks.sparkSession
    view = f"{prefix}_ticks"
    ticks.selectExpr(f"cast(`{key}` as string) as session", "ts_ns", "price", "size", "side", "trade_id").createOrReplaceTempView(view)
    for name, (arguments, columns, body) in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({arguments}) RETURNS TABLE ({columns}) RETURN {_filled(body, view)}")
    return [f"{prefix}_{name}" for name in _BODIES]
