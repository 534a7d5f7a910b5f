"""Readers and writers, feeds, streams, and the driver's contract."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from tidemark import sources
from tidemark.operators import ticks
from tidemark.sources import live, synthetic
from tidemark.streaming import collect
from tidemark.streaming import session as streaming
from tidemark.streaming.state import settings


@pytest.mark.parametrize("name", ["t.parquet", "t.ndjson"])
def test_round_trip(spark, tmp_path, name):
    path = str(tmp_path / name)
    assert sources.write_ticks(X.rising_day(spark), path) == 4
    back = sources.read_ticks(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, X.rising_day(spark).collect()))
    other = str(tmp_path / ("u.ndjson" if name.endswith("parquet") else "u.parquet"))
    assert sources.convert(spark, path, other) == 4


def test_missing_field_is_an_error(spark, tmp_path):
    (tmp_path / "bad.ndjson").write_text(json.dumps({"ts_ns": 1, "product": "P", "price": 1.0, "size": 1.0, "side": "buy"}) + "\n")
    with pytest.raises(Exception, match="trade_id"):
        sources.read_ticks(spark, str(tmp_path / "bad.ndjson")).collect()


def test_synthetic_captures(spark):
    t = synthetic.synthetic_ticks(spark, 50)
    assert t.count() == 50 and t.where("size < 0.01 or size > 0.5").count() == 0
    assert [tuple(r) for r in t.collect()] == [tuple(r) for r in synthetic.synthetic_ticks(spark, 50).collect()]
    assert synthetic.synthetic_book(spark, 4, 3).count() == 24
    assert synthetic.large_ticks(spark, 1000).where("price <= 0").count() == 0


def test_feed_messages(spark):
    lines = [
        {"type": "match", "trade_id": 5, "side": "sell", "size": "0.5", "price": "10.5", "product_id": "P", "time": "2024-07-01T00:00:00.000001Z"},
        {"type": "ticker", "product_id": "P", "best_bid": "1", "best_bid_size": "2", "best_ask": "3", "best_ask_size": "4", "time": "2024-07-01T00:00:01Z"},
        {"type": "ticker", "product_id": "P", "time": "2024-07-01T00:00:01Z"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    assert [tuple(r) for r in live.match_to_tick(df).collect()] == [(1719792000000001000, "P", 10.5, 0.5, "sell", 5)]
    assert live.ticker_to_quote(df).count() == 1


def test_replayed_trades_and_bounds(spark):
    rows = [(k, "P", i, i * X.SECOND) for k, i in enumerate([1, 2, 3, 2, 3, 4])]
    df = spark.createDataFrame(rows, "seq long, product string, trade_id long, ts_ns long")
    assert [r.trade_id for r in live.drop_replayed(df).orderBy("seq").collect()] == [1, 2, 3, 4]
    assert live.bound_capture(df, count=2).count() == 2
    assert live.bound_capture(live.drop_replayed(df), seconds=2.0).count() == 2
    with pytest.raises(ValueError):
        live.bound_capture(df)


def test_l2_levels(spark):
    rows = [(1, 10, "bid", 100.0, 1.0), (2, 10, "ask", 101.0, 2.0), (3, 20, "bid", 99.0, 4.0), (4, 30, "bid", 100.0, 0.0), (5, 30, "ask", 101.0, 5.0)]
    updates = spark.createDataFrame([("P", *r) for r in rows], "product string, seq long, ts_ns long, side string, price double, size double")
    at = spark.createDataFrame([("P", 20), ("P", 30)], "product string, ts_ns long")
    got = {(r.ts_ns, r.side, r.level): (r.price, r.size) for r in live.l2_levels(updates, at, 2).collect()}
    assert got == {(20, "bid", 0): (100.0, 1.0), (20, "bid", 1): (99.0, 4.0), (20, "ask", 0): (101.0, 2.0), (30, "bid", 0): (99.0, 4.0), (30, "ask", 0): (101.0, 5.0)}


def _stream(spark, tmp_path, parts, name):
    folder = tmp_path / name
    folder.mkdir()
    rows = spark.readStream.schema(X.TICK).option("maxFilesPerTrigger", 1).json(str(folder))
    with settings(spark):
        query = streaming.stream(rows, "product").writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    try:
        for k, part in enumerate(parts):
            (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).orderBy(F.desc("rows")).first()


def test_stream_equals_batch_for_any_parts(spark, tmp_path):
    rows = [json.loads(x) for x in X.rising_day(spark).toJSON().collect()]
    batch = streaming.replay(X.rising_day(spark), "product").first()
    for name, parts in (("one", [rows]), ("two", [rows[:1], rows[1:]]), ("four", [[r] for r in rows])):
        got = _stream(spark, tmp_path, parts, name)
        assert {k: got[k] for k in batch.asDict() if k != "product"} == {k: v for k, v in batch.asDict().items() if k != "product"}


def test_stream_refuses_old_ticks(spark, tmp_path):
    rows = [json.loads(x) for x in X.rising_day(spark).toJSON().collect()]
    with pytest.raises(Exception, match="not in time order"):
        _stream(spark, tmp_path, [rows[2:], rows[:2]], "late")


@pytest.mark.parametrize("name", ["summary", "book_thin", "pov_backtest_slots", "window_sweep", "calibrate_robust_huber", "stream_session", "capture_bounds", "book_grid_phase_across", "l2_stream", "l2_stream_hourly", "replayed_trades_stream", "capture_bounds_stream", "l2_top_levels"])
def test_queries_match_their_sql(spark, name):
    from tidemark import queries

    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    plain = lambda r: tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r)
    order = lambda rows: sorted(map(plain, rows), key=repr)
    assert sorted(columns) == sorted(got.columns)
    assert order(map(tuple, got.select(columns).collect())) == order(want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name, column, folds", [("walk_forward", "input", range(2, 30)), ("holdout", "held_out", range(30)), ("pov_backtest", "input", range(1, 30))])
def test_whole_studies_reach_every_session(spark, name, column, folds):
    from tidemark import queries

    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()
    assert sorted(r[0] for r in got) == list(folds)
    test_queries_match_their_sql(spark, name)


def test_disorder_is_refused_in_batch_too(spark, tmp_path):
    rows = [json.loads(x) for x in X.rising_day(spark).toJSON().collect()]
    (tmp_path / "good.ndjson").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "bad.ndjson").write_text("".join(json.dumps(r) + "\n" for r in [rows[0], rows[2], rows[1]]))
    streaming.refuse_disorder(sources.read_ticks(spark, str(tmp_path / "good.ndjson")))
    with pytest.raises(ValueError, match="row 3"):
        streaming.refuse_disorder(sources.read_ticks(spark, str(tmp_path / "bad.ndjson")))


def _time(k):
    return f"2024-07-01T00:00:{k:02d}.000000Z"


def _match(k):
    return {"type": "match", "trade_id": k, "product_id": "P", "time": _time(k), "size": "1", "price": "10", "side": "buy"}


def test_a_trade_capture_reconnects_once_and_takes_no_trade_twice(tmp_path):
    feeds = iter([[_match(1), _match(2), None], [{**_match(2), "type": "last_match"}, _match(3), {"type": "heartbeat"}, _match(4)]])

    def connect():
        for m in next(feeds):
            if m is None:
                raise ConnectionError
            yield m

    log, out = collect.EventLog(str(tmp_path / "log")), str(tmp_path / "t.ndjson")
    assert collect.capture(connect, collect.Trades(), "P", out, count=3, log=log) == 3
    assert [json.loads(x)["trade_id"] for x in open(out)] == [1, 2, 3]
    assert [e["event"] for e in log.events] == ["ingest_start", "ingest_reconnect", "ingest_complete"] and log.events[-1]["reconnects"] == 1
    assert len(open(tmp_path / "log").readlines()) == 3


def test_captures_are_bounded(tmp_path):
    out = str(tmp_path / "t.ndjson")
    run = lambda **k: collect.capture(lambda: [_match(j) for j in range(1, 9)], collect.Trades(), "P", out, **k)
    assert run(seconds=3.0) == 3 and run(count=2, seconds=3.0) == 2 and run(count=50) == 8
    with pytest.raises(ValueError, match="count"):
        run()

    def never():
        raise ConnectionError

    with pytest.raises(ConnectionError):
        collect.capture(never, collect.Quotes(), "P", out, count=1, max_reconnects=2)


def test_book_captures(tmp_path):
    seed = {"type": "snapshot", "bids": [["10", "1"], ["9", "2"]], "asks": [["11", "1"]]}
    move = lambda k, *c: {"type": "l2update", "time": _time(k), "changes": list(c)}
    script = [seed, move(1, ["buy", "10", "3"]), move(2, ["buy", "5", "1"]), move(3, ["buy", "10", "0"]), {"type": "drop"}, {**seed, "bids": [["8", "1"]]}, move(4, ["sell", "11", "2"]), move(9, ["sell", "11", "2"])]
    (tmp_path / "feed").write_text("".join(json.dumps(m) + "\n" for m in script))
    out, log = str(tmp_path / "b.ndjson"), collect.EventLog()
    assert collect.capture(collect.scripted(str(tmp_path / "feed")), collect.Book("P", 2), "P", out, count=50, log=log) == 3
    rows = [json.loads(x) for x in open(out)]
    best = {r["ts_ns"] // X.SECOND % 60: r["price"] for r in rows if r["side"] == "bid" and r["level"] == 0}
    assert best == {1: 10.0, 3: 9.0, 4: 8.0} and log.events[-1]["unchanged"] == 2 and log.events[1]["event"] == "book_ingest_reconnect"
    assert collect.capture(collect.scripted(str(tmp_path / "feed")), collect.Book("P", 2, every=2.0), "P", out, count=50) == 3
    with pytest.raises(ValueError, match="every"):
        collect.Book("P", 2, every=0.0)
