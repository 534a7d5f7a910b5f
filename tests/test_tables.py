"""Reports from SQL, and the log of streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from tests.test_windows import ticks as some_ticks
from tidemark.functions import tables
from tidemark.operators import ticks
from tidemark.streaming import events, trades
from tidemark.streaming.state import settings


def test_reports_are_functions_of_sql(spark):
    rows = spark.createDataFrame(some_ticks(3), X.TICK).withColumn("side", F.when(F.col("trade_id") % 3 == 0, "sell").otherwise("buy"))
    assert tables.register(rows, "product") == ["tidemark_bars", "tidemark_vwap", "tidemark_order_flow"]
    take = lambda df: sorted(map(tuple, df.collect()))
    close = lambda a, b: len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))
    assert close(take(spark.sql("SELECT * FROM tidemark_bars(600000000000)")), take(ticks.bars(rows, 600 * X.SECOND, ["product"])))
    assert close(take(spark.sql("SELECT session, vwap FROM tidemark_vwap()")), take(ticks.session_vwap(rows, ["product"])))
    assert close(take(spark.sql("SELECT * FROM tidemark_order_flow()")), take(ticks.order_flow(rows, ["product"])))
    joined = spark.sql("SELECT b.session, count(*) AS bars FROM tidemark_bars(3600000000000) b JOIN tidemark_vwap() v ON b.session = v.session WHERE v.vwap > 0 GROUP BY b.session")
    assert {r.session for r in joined.collect()} == {"P", "Q"}


def test_streams_are_logged(spark, tmp_path):
    folder, schema = tmp_path / "in", "product string, trade_id long, seq long"
    folder.mkdir()

    def arrive(k, rows):
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("product", "trade_id", "seq"), r))) + "\n" for r in rows))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k,) * 2)

    def run(out=str(tmp_path / "out")):
        live = trades.rising_trades(spark.readStream.schema(schema).json(str(folder)))
        with settings(spark):
            query = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()

    log = events.StreamLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        arrive(0, [("P", 1, 0), ("P", 2, 1)])
        run()
        events.ended(spark, str(tmp_path / "log"), 1)
        arrive(1, [("P", 2, 2), ("P", 3, 3)])
        run()  # the same stream goes on from its checkpoint: the replayed trade is dropped
        found = events.ended(spark, str(tmp_path / "log"), 2)
    finally:
        spark.streams.removeListener(log)
    kinds = [r.event for r in found.where("event <> 'progress'").orderBy("ts").collect()]
    assert kinds == ["start", "complete", "reconnect", "complete"]
    assert found.where("event = 'progress'").agg(F.sum("rows")).first()[0] == 4 and found.select("query").distinct().count() == 1 and found.select("run").distinct().count() == 2
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()] == [0, 1, 3]
