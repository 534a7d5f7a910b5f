"""Command line: python -m tidemark.cli VERB ...  Each report is printed as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import plans, sources
from tidemark.operators import book, fills, impact, pov, quotes, ticks
from tidemark.sources import synthetic
from tidemark.streaming import collect
from tidemark.streaming import session as streaming


def _floats(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def _sessions(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[int]]:
    """One capture file a session."""
    made = None
    for k, path in enumerate(paths):
        one = sources.read_ticks(spark, path).withColumn("session", F.lit(k))
        made = one if made is None else made.unionByName(one)
    return made, list(range(len(paths)))


def _books(spark: SparkSession, paths: list[str]) -> DataFrame:
    made = None
    for k, path in enumerate(paths):
        one = sources.read_book(spark, path).withColumn("book", F.lit(k))
        made = one if made is None else made.unionByName(one)
    return made


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *groups: str, several: bool = False) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        if "input" in groups:
            p.add_argument("--input", required=True, nargs="+" if several else None)
        if "out" in groups:
            p.add_argument("--out", required=True)
        if "bucket" in groups:
            p.add_argument("--bucket-ms", type=int, default=1000)
        if "parent" in groups:
            p.add_argument("--parent", type=float, default=1.0)
        if "cap" in groups:
            p.add_argument("--cap", type=float, default=0.25)
        if "coef" in groups:
            p.add_argument("--coef-bps", type=float, default=10.0)
            p.add_argument("--perm-coef-bps", type=float, default=0.0)
        if "caps" in groups:
            p.add_argument("--cap-grid", type=_floats, default=[0.1, 0.2, 0.3])
        if "half-lives" in groups:
            p.add_argument("--half-life-grid", type=_floats, default=[0.25, 0.5, 1.0, 2.0, 4.0])
        if "share" in groups:
            p.add_argument("--parent-share", type=float)
        if "side" in groups:
            p.add_argument("--side", choices=("buy", "sell"), default="buy")
        if "spacings" in groups:
            p.add_argument("--every", type=_floats, default=[1.0, 2.0, 5.0])
        if "arrival" in groups:
            p.add_argument("--arrival", type=float, required=True)
        return p

    for name in ("summary", "bars"):
        verb(name, "input", "bucket")
    for name in ("vwap", "twap", "flow", "book", "depth", "queue"):
        verb(name, "input")
    verb("stream", "input").add_argument("--chunk-rows", type=int, default=streaming.CHUNK_ROWS)
    for name, limit in (("ingest", "--max-trades"), ("ingest-quotes", "--max-quotes"), ("ingest-book", "--max-snapshots")):
        p = verb(name, "out")
        p.add_argument("--product", default="BTC-USD")
        p.add_argument(limit, type=int, dest="count")
        p.add_argument("--seconds", type=float)
        p.add_argument("--log")
        p.add_argument("--max-reconnects", type=int, default=5)
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--url", help="websocket of a public feed")
        source.add_argument("--replay", help="file of recorded messages, one JSON object a line")
        if name == "ingest-book":
            p.add_argument("--levels", type=int, default=10)
            p.add_argument("--every", type=float)
    verb("convert", "input", "out")
    for name in ("synth", "synth-quotes", "synth-book", "synth-calibration"):
        p = verb(name, "out")
        p.add_argument("--n", type=int, default=100 if name == "synth-book" else 200)
        p.add_argument("--seed", type=int, default=7)
        if name == "synth-book":
            p.add_argument("--levels", type=int, default=5)
    verb("book-grid", "input", "spacings")
    verb("book-grid-across", "input", "spacings", several=True)
    for name, several in (("book-grid-phase", False), ("book-grid-phase-across", True)):
        verb(name, "input", "spacings", several=several).add_argument("--phases", type=int, default=4)
    verb("sweep", "input", "side").add_argument("--size", type=float, default=1.0)
    verb("curve", "input", "side").add_argument("--sizes", type=_floats, default=[0.5, 1.0, 2.0])
    verb("impact", "input", "coef")
    p = verb("calibrate", "input")
    p.add_argument("--huber-delta", type=float)
    p.add_argument("--ridge-lambda", type=float, default=0.0)
    p.add_argument("--max-iters", type=int, default=8)
    p = verb("schedule", "coef")
    for name, kind, default in (("--slices", int, 6), ("--size", float, 3.0), ("--volume", float, 2.0), ("--sigma-bps", float, 0.0)):
        p.add_argument(name, type=kind, default=default)
    verb("shortfall", "input", "coef", "parent", "arrival")
    verb("counterfactual", "input", "coef", "arrival")
    verb("sensitivity", "input", "coef", "arrival").add_argument("--coef-grid", type=_floats, default=[10.0, 20.0, 30.0])
    verb("pov-plan", "input", "bucket", "parent", "cap", "coef")
    p = verb("pov-backtest", "input", "bucket", "parent", "cap", "coef")
    p.add_argument("--plan", required=True)
    p = verb("pov-forecast", "input", "bucket", "parent", "cap", "coef", several=True)
    p.add_argument("--half-life", type=float)
    p.add_argument("--shortfall-bps", type=float)
    verb("pov-sweep", "input", "bucket", "parent", "caps", "coef", several=True).add_argument("--half-life", type=float, default=0.0)
    verb("pov-hl-sweep", "input", "bucket", "parent", "cap", "half-lives", "coef", several=True)
    for name in ("pov-stability", "pov-holdout"):
        verb(name, "input", "bucket", "parent", "caps", "half-lives", "coef", several=True)
    for name in ("pov-walkforward", "pov-window-sweep"):
        p = verb(name, "input", "bucket", "caps", "half-lives", "coef", "share", several=True)
        p.add_argument("--parent", type=float)
        if name == "pov-walkforward":
            p.add_argument("--window", type=int)
    verb("pov-share-sweep", "input", "bucket", "caps", "half-lives", "coef", several=True).add_argument("--share-grid", type=_floats, default=[0.05, 0.1, 0.2])
    for name in ("simulate", "eval"):
        p = verb(name, "input", "bucket", "side")
        p.add_argument("--algo", choices=("pov", "twap"), default="pov")
        p.add_argument("--qty", type=float, default=1.0)
        p.add_argument("--participation", type=float, default=0.2)
        p.add_argument("--impact-bps", type=float, default=0.0)
        p.add_argument("--perm-impact-bps", type=float, default=0.0)
        p.add_argument("--impact-model", choices=fills.MODELS, default="linear")
    return top


def ingest(a: argparse.Namespace) -> int:
    """Capture from a feed, without Spark: 500 records unless --seconds bounds it."""
    feed = collect.Trades() if a.verb == "ingest" else collect.Quotes() if a.verb == "ingest-quotes" else collect.Book(a.product, a.levels, a.every)
    connect = collect.scripted(a.replay) if a.replay else collect.socket(a.url, a.product, feed.channel)
    count = 500 if a.count is None and a.seconds is None else a.count
    return collect.capture(connect, feed, a.product, a.out, count, a.seconds, collect.EventLog(a.log), a.max_reconnects)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | int:
    v, t = a.verb, sources.read_ticks
    bucket = a.bucket_ms * 1_000_000 if "bucket_ms" in a else 0
    costs = (a.coef_bps, a.perm_coef_bps) if "coef_bps" in a else ()
    if v in ("summary", "bars"):
        return getattr(ticks, v)(t(spark, a.input), bucket)
    if v in ("vwap", "twap"):
        return getattr(ticks, f"session_{v}")(t(spark, a.input))
    if v == "flow":
        return ticks.order_flow(t(spark, a.input))
    if v == "book":
        return quotes.quote_metrics(sources.read_quotes(spark, a.input))
    if v in ("depth", "queue"):
        return getattr(book, f"{v}_metrics")(sources.read_book(spark, a.input))
    if v == "stream":
        if a.input.rstrip("/").endswith(".parquet"):
            raise ValueError("a stream is read from NDJSON")
        if a.chunk_rows < 1:
            raise ValueError("chunk_rows must be >= 1")
        rows = t(spark, a.input)
        streaming.refuse_disorder(rows)
        return streaming.replay(rows, "product", a.chunk_rows)
    if v == "convert":
        return sources.convert(spark, a.input, a.out)
    if v.startswith("synth"):
        more = {"levels": a.levels} if v == "synth-book" else {}
        return sources.write_ticks(getattr(synthetic, f"synthetic_{v.partition('-')[2] or 'ticks'}")(spark, a.n, seed=a.seed, **more), a.out)
    if v == "book-grid":
        return book.book_grid_sweep(sources.read_book(spark, a.input), a.every)
    if v == "book-grid-across":
        return book.book_grid_across(_books(spark, a.input), a.every, "book")
    if v == "book-grid-phase":
        return book.book_grid_phase(sources.read_book(spark, a.input), a.every, a.phases)
    if v == "book-grid-phase-across":
        return book.book_grid_phase_across(_books(spark, a.input), a.every, a.phases, "book")
    if v == "sweep":
        return book.sweep_cost(sources.read_book(spark, a.input), a.side, a.size)
    if v == "curve":
        return book.sweep_curve(sources.read_book(spark, a.input), a.side, a.sizes)
    if v == "impact":
        return impact.impact_curve(sources.read_impact(spark, a.input), *costs)
    if v == "calibrate":
        return impact.calibrate_impact_robust(sources.read_calibration(spark, a.input), a.huber_delta, a.ridge_lambda, a.max_iters)
    if v == "schedule":
        return impact.optimal_schedule(spark, a.slices, a.size, a.volume, *costs, a.sigma_bps)
    if v == "shortfall":
        return fills.shortfall(sources.read_fills(spark, a.input), a.parent, a.arrival, *costs)
    if v == "counterfactual":
        return fills.counterfactual(sources.read_fills(spark, a.input), a.arrival, *costs)
    if v == "sensitivity":
        return fills.sensitivity(sources.read_fills(spark, a.input), a.arrival, a.coef_grid, a.perm_coef_bps)
    if v == "pov-plan":
        return pov.pov_schedule(t(spark, a.input), bucket, a.parent, a.cap, *costs)
    if v == "pov-backtest":
        return pov.pov_backtest(t(spark, a.plan), t(spark, a.input), bucket, a.parent, a.cap, *costs)
    if v == "simulate":
        common = {"side": a.side, "parent_qty": a.qty, "bucket_ns": bucket, "impact_bps": a.impact_bps, "impact_model": a.impact_model, "perm_impact_bps": a.perm_impact_bps}
        return fills.pov_fill(t(spark, a.input), participation=a.participation, **common) if a.algo == "pov" else fills.twap_fill(t(spark, a.input), **common)
    if v == "eval":
        return fills.evaluate(
            t(spark, a.input), side=a.side, parent_qty=a.qty, participation=a.participation, bucket_ns=bucket, impact_bps=a.impact_bps, impact_model=a.impact_model, perm_impact_bps=a.perm_impact_bps
        )
    rows, ids = _sessions(spark, a.input)
    history, last = ids[:-1], ids[-1]
    if v == "pov-forecast":
        return plans.pov_forecast(rows, "session", history, last, bucket, a.parent, a.cap, *costs, a.half_life or 0.0, a.shortfall_bps, a.half_life is None)
    if v == "pov-sweep":
        return plans.cap_sweep(rows, "session", history, last, bucket, a.parent, a.cap_grid, *costs, a.half_life)
    if v == "pov-hl-sweep":
        return plans.hl_sweep(rows, "session", history, last, bucket, a.parent, a.cap, a.half_life_grid, *costs)
    if v == "pov-stability":
        return plans.stability(rows, "session", history, last, bucket, a.parent, a.cap_grid, a.half_life_grid, *costs)
    if v == "pov-holdout":
        return plans.holdout(rows, "session", ids, bucket, a.parent, a.cap_grid, a.half_life_grid, *costs)
    if v == "pov-walkforward":
        return plans.walk_forward(rows, "session", ids, bucket, a.parent, a.cap_grid, a.half_life_grid, *costs, a.window, a.parent_share)
    if v == "pov-window-sweep":
        return plans.window_sweep(rows, "session", ids, bucket, a.parent, a.cap_grid, a.half_life_grid, *costs, a.parent_share)
    return plans.share_sweep(rows, "session", ids, bucket, a.share_grid, a.cap_grid, a.half_life_grid, *costs)


def main(arguments: list[str] | None = None) -> int:
    a = _parser().parse_args(arguments)
    if a.verb.startswith("ingest"):
        print(f'{{"rows": {ingest(a)}}}')
        return 0
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(spark, a)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if isinstance(out, int):
        print(f'{{"rows": {out}}}')
    else:
        for line in out.toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
