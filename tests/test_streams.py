"""Streams with state: what they hold, what they refuse, and that batches and chunks don't show in their answers."""

import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import fixtures as X
from tidemark.streaming import book, session, trades
from tidemark.streaming.state import settings, to_table

S = X.SECOND


def source(spark, tmp_path, name, parts, schema):
    """A stream of JSON files, one in each micro-batch."""
    folder = tmp_path / name
    folder.mkdir()
    for k, part in enumerate(parts):
        (folder / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(folder / f"{k}.json", (1_700_000_000 + k,) * 2)  # files are taken by their age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def ticks(n, sessions=1, seed=0):
    rng = random.Random(seed)
    return [{"ts_ns": k * S // 7 * (k % 3 > 0) + k * S, "product": f"P{k % sessions}", "price": 100 + rng.random(), "size": 1 + rng.random(), "side": rng.choice(["buy", "sell"]), "trade_id": k} for k in range(n)]


def test_a_million_rows_are_held_a_chunk_at_a_time(spark, tmp_path):
    path = str(tmp_path / "ticks")
    rows = spark.range(0, 1_000_000, 1, 1).selectExpr("id * 1000 as ts_ns", "'P' as product", "100 + id % 97 as price", "1e0 + id % 5 as size", "if(id % 3 = 0, 'buy', 'sell') as side", "id as trade_id")
    rows.write.parquet(path)
    live = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    got = session.to_end(session.stream(live, "product", 4096), 4096).first()
    assert got.rows == 1_000_000 and got.rows_held <= got.peak_rows_in_memory == 4097
    want = session.replay(spark.read.parquet(path), "product", 4096).first()
    assert {k: v for k, v in got.asDict().items() if k not in ("session", "rows_held")} == {k: v for k, v in want.asDict().items() if k != "product"}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_neither_chunks_nor_batches_change_a_session(spark, tmp_path, chunk):
    rows = ticks(40, 3)
    live = source(spark, tmp_path, f"c{chunk}", [rows[:7], rows[7:8], rows[8:]], X.TICK)
    got = {r.session: r for r in session.to_end(session.stream(live, "product", chunk), chunk).collect()}
    for want in session.replay(spark.createDataFrame([tuple(r.values()) for r in rows], X.TICK), "product", chunk).collect():
        r = got[want.product]
        assert all(r[c] == want[c] for c in ("rows", "first_ts_ns", "last_ts_ns", "volume", "notional", "vwap", "twap", "buy_volume", "sell_volume", "imbalance", "chunks", "peak_rows_in_memory"))
        assert 1 <= r.rows_held <= r.peak_rows_in_memory


def test_disorder_is_refused_within_a_batch_between_batches_and_between_micro_batches(spark, tmp_path):
    rows = ticks(10)
    swapped = [*rows[:4], rows[5], rows[4], *rows[6:]]
    for name, parts, chunk in (("within", [swapped], 1000), ("between", [swapped], 5), ("later", [rows[5:], rows[:5]], 1000)):
        with pytest.raises(Exception, match="not in time order at row"):
            session.to_end(session.stream(source(spark, tmp_path, name, parts, X.TICK), "product", chunk), chunk)


def test_a_stream_without_rows(spark, tmp_path):
    live = source(spark, tmp_path, "none", [[]], X.TICK)
    assert session.to_end(session.stream(live, "product")).count() == 0
    with pytest.raises(ValueError, match="chunk_rows"):
        session.stream(live, "product", 0)


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with settings(spark, 7):
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


UPDATE = "product string, seq long, ts_ns long, side string, price double, size double, snapshot boolean"


def message(seq, second, *levels, snapshot=False):
    return [{"product": "P", "seq": seq, "ts_ns": second * S, "side": s, "price": p, "size": z, "snapshot": snapshot} for s, p, z in levels]


def plain_book(messages, levels, every=None):
    """The same, over plain dictionaries."""
    book, last_at, last, out = {"bid": {}, "ask": {}}, None, None, []
    for m in messages:
        if m[0]["snapshot"]:
            book = {"bid": {}, "ask": {}}
        for u in m:
            if u["size"]:
                book[u["side"]][u["price"]] = u["size"]
            else:
                book[u["side"]].pop(u["price"], None)
        if m[0]["snapshot"] or not book["bid"] or not book["ask"]:
            continue
        top = {"bid": sorted(book["bid"].items(), reverse=True)[:levels], "ask": sorted(book["ask"].items())[:levels]}
        at = m[0]["ts_ns"]
        if every is not None and last_at is not None and at - last_at < every * S or every is None and top == last:
            continue
        last_at, last = at, top
        out += [(at, s, i, p, z) for s in ("ask", "bid") for i, (p, z) in enumerate(top[s])]
    return sorted(out)


@pytest.mark.parametrize("levels, every", [(1, None), (3, None), (2, 2.5), (1, 1.0)])
def test_l2_stream_against_plain_dictionaries(spark, tmp_path, levels, every):
    rng = random.Random(levels)
    messages = []
    for k in range(120):
        if k % 40 == 0:
            messages.append(message(k, k, ("bid", 100.0, 1.0), ("ask", 101.0, 1.0), snapshot=True))
        else:
            side = rng.choice(["bid", "ask"])
            messages.append(message(k, k, *{p: (side, p, float(rng.randint(0, 3))) for p in (100.0 + rng.randint(-4, 0) if side == "bid" else 101.0 + rng.randint(0, 4) for _ in range(2))}.values()))
    parts = [[u for m in messages[a:b] for u in m] for a, b in ((0, 1), (1, 50), (50, 51), (51, 120))]
    for part in parts:
        rng.shuffle(part)  # a message's rows and a micro-batch's messages come in any order
    got = to_table(book.l2_stream(source(spark, tmp_path, "l2", parts, UPDATE), levels, every), mode="append").collect()
    assert sorted((r.ts_ns, r.side, r.level, r.price, r.size) for r in got) == plain_book(messages, levels, every)


def test_l2_stream_refuses(spark, tmp_path):
    seed = message(5, 1, ("bid", 100.0, 1.0), ("ask", 101.0, 1.0), snapshot=True)
    live = source(spark, tmp_path, "old", [seed, message(4, 2, ("bid", 99.0, 1.0))], UPDATE)
    with pytest.raises(ValueError, match="every"):
        book.l2_stream(live, every=0.0)
    with pytest.raises(ValueError, match="levels"):
        book.l2_stream(live, 0)
    with pytest.raises(Exception, match="update 4 of P follows 5"):
        to_table(book.l2_stream(live), mode="append")


def test_replayed_trades_are_dropped_however_late(spark, tmp_path):
    schema = "product string, trade_id long, seq long"
    parts = [[("P", 1, 0), ("P", 2, 1), ("Q", 9, 2)], [("P", 2, 3), ("P", 3, 4), ("P", 1, 5)], [("Q", 9, 6), ("Q", 10, 7), ("P", 3, 8)]]
    live = source(spark, tmp_path, "t", [[dict(zip(("product", "trade_id", "seq"), r)) for r in p] for p in parts], schema)
    assert sorted(r.seq for r in to_table(trades.rising_trades(live), mode="append").collect()) == [0, 1, 2, 4, 7]


def test_a_capture_ends_at_its_bounds(spark, tmp_path):
    schema = "product string, ts_ns long, seq long"
    parts = [[("P", k * S, k) for k in a] for a in ((0, 1), (2, 3), (4, 5, 6))]
    for name, bounds, want in (("count", {"count": 3}, 3), ("time", {"seconds": 3.5}, 4), ("both", {"count": 2, "seconds": 60}, 2), ("first", {"seconds": 0.5}, 1)):
        live = source(spark, tmp_path, name, [[dict(zip(("product", "ts_ns", "seq"), r)) for r in p] for p in parts], schema)
        assert sorted(r.seq for r in to_table(trades.bounded(live, **bounds), mode="append").collect()) == list(range(want))
    with pytest.raises(ValueError, match="count"):
        trades.bounded(live)


def blocked_messages():
    """Rising messages whose blocks of four end with a seed, with an empty side, or with neither."""
    rng, out = random.Random(4), []
    for k in range(61):
        if k % 20 == 3:
            out.append(message(k, k, ("bid", 100.0, 1.0), ("ask", 101.0, 1.0), snapshot=True))
        elif k % 12 in (6, 7, 8):  # one side has no levels for a while, over the end of a block
            out.append(message(k, k, *[("ask", 101.0 + d, 0.0) for d in range(3)]))
        else:
            out.append(message(k, k, (rng.choice(["bid", "ask"]), 0.0, 1.0)))
            out[-1][0]["price"] = (101.0 if out[-1][0]["side"] == "ask" else 98.0) + rng.randint(0, 2)
            out[-1][0]["size"] = float(rng.randint(1, 2))
    return out


def blocked_book(spark, tmp_path, monkeypatch, every):
    from tidemark.streaming import order

    monkeypatch.setattr(order, "BLOCK", 4)
    messages = blocked_messages()
    parts = [[u for m in messages[a:b] for u in m] for a, b in ((0, 30), (30, 61))]
    for part in parts:
        random.Random(1).shuffle(part)
    got = to_table(book.l2_stream(source(spark, tmp_path, "blocks", parts, UPDATE), 2, every), mode="append").collect()
    assert sorted((r.ts_ns, r.side, r.level, r.price, r.size) for r in got) == plain_book(messages, 2, every)


def test_a_book_is_folded_in_blocks_of_messages(spark, tmp_path, monkeypatch):
    blocked_book(spark, tmp_path, monkeypatch, None)


@pytest.mark.parametrize("every", [2.5, 9.0])
def test_a_grid_of_time_goes_on_from_block_to_block(spark, tmp_path, monkeypatch, every):
    blocked_book(spark, tmp_path, monkeypatch, every)


def test_rising_trades_are_found_in_blocks(spark, tmp_path, monkeypatch):
    from tidemark.streaming import order

    monkeypatch.setattr(order, "BLOCK", 3)
    rng, schema = random.Random(8), "product string, trade_id long, seq long"
    rows = [("PQ"[k % 5 == 0], k + rng.randint(-4, 2), k) for k in range(-5, 60)]
    parts = [rows[:31], rows[31:]]
    want, newest = [], {}
    for product, at, seq in rows:
        if at > newest.get(product, -100):
            want.append(seq)
            newest[product] = at
    for part in parts:
        rng.shuffle(part)
    live = source(spark, tmp_path, "blocks", [[dict(zip(("product", "trade_id", "seq"), r)) for r in p] for p in parts], schema)
    assert sorted(r.seq for r in to_table(trades.rising_trades(live), mode="append").collect()) == want


def test_a_capture_ends_in_any_block(spark, tmp_path, monkeypatch):
    from tidemark.streaming import order

    monkeypatch.setattr(order, "BLOCK", 3)
    rows = [("P", k * S, k) for k in range(20)]
    for name, bounds, want in (("n", {"count": 7}, 7), ("s", {"seconds": 7.5}, 8), ("sn", {"count": 11, "seconds": 10}, 10), ("ns", {"count": 9, "seconds": 10}, 9), ("late", {"seconds": 15}, 15)):
        parts = [[dict(zip(("product", "ts_ns", "seq"), r)) for r in p] for p in (rows[:12][::-1], rows[12:])]
        live = source(spark, tmp_path, name, parts, "product string, ts_ns long, seq long")
        assert sorted(r.seq for r in to_table(trades.bounded(live, **bounds), mode="append").collect()) == list(range(want))


def block_of_messages(n, rng, seeds):
    """A block's table of n updates, some of one message, in which sides fall empty."""
    seq = sorted(rng.randrange(n) for _ in range(n))
    first = {q: (rng.random() < seeds, q * 5 + rng.randrange(40)) for q in seq}
    rows = [(q, first[q][1], rng.choice(["bid", "ask"]), float(rng.randrange(4)), float(rng.choice([0, 0, 1])), first[q][0]) for q in seq]
    return pa.table(dict(zip(("seq", "ts_ns", "side", "price", "size", "snapshot"), map(list, zip(*rows)))))


def test_when_a_block_writes_last_is_what_its_fold_says():
    rng, wrote = random.Random(5), 0
    for k in range(300):
        table = block_of_messages(rng.randint(1, 40), rng, (0, 0.05, 0.3)[k % 3])
        before = [(s, float(p), 1.0) for s in ("bid", "ask") for p in range(4) if rng.random() < 0.4]
        every, last = rng.choice([0, 1, 30, 10**6]), rng.choice([None, 0, 60])
        want = [ts for ts, _ in book._fold(2, every, table, before, last, None)]
        assert book._last_written(every, table, before, last) == (want[-1] if want else last)
        wrote += bool(want)
    assert wrote > 100


def test_the_step_that_blocks_take_one_after_the_other_is_short():
    table = block_of_messages(200_000, random.Random(6), 0.001)
    began = time.perf_counter()
    book._last_written(3600 * S, table, [], None)
    serial = time.perf_counter() - began
    assert sum(1 for _ in book._fold(3, 3600 * S, table, [], None, None)) > 0
    assert serial < (time.perf_counter() - began - serial) / 3


def test_a_task_sends_on_no_more_than_a_capture_may_take(spark, monkeypatch):
    came = []

    def seen(rows, *_):
        came.append(rows.groupBy("product").agg(F.count("*"), F.min("seq"), F.max("seq")).sort("product").collect())
        raise InterruptedError

    monkeypatch.setattr(trades, "blocks", seen)
    rows = spark.range(0, 250_000, 1, 2).selectExpr("if(id % 5 = 0, null, if(id % 5 < 3, 'P', 'Q')) as product", "id as ts_ns", "249999 - id as seq")
    with pytest.raises(InterruptedError):
        trades.bounded(rows, count=7, seconds=60)
    want = {r.product: sorted(x for x in r.seqs)[:7] for r in rows.groupBy("product").agg(F.collect_list("seq").alias("seqs")).collect()}
    assert [r[0] for r in came[0]] == [None, "P", "Q"]
    assert all(7 <= n <= 14 and first == want[product][0] for product, n, first, _ in came[0])


@pytest.mark.parametrize("held", [4, 100])
def test_what_a_task_sends_on_holds_all_that_a_capture_may_take(monkeypatch, held):
    monkeypatch.setattr(trades, "_HELD", held)
    rng = random.Random(held)
    rows = [(rng.choice(["P", "Q", "R", None]), k) for k in range(200)]
    rng.shuffle(rows)
    batches = [pa.RecordBatch.from_pydict({"product": [p for p, _ in rows[a : a + 9]], "seq": [s for _, s in rows[a : a + 9]]}) for a in range(0, 200, 9)]
    for count in (1, 3, 500):
        got = [(r["product"], r["seq"]) for b in trades._foremost(iter(batches), count) for r in b.to_pylist()]
        assert len(set(got)) == len(got) and set(got) <= set(rows)
        for product in ("P", "Q", "R", None):
            first = sorted(s for p, s in rows if p == product)[:count]
            assert sorted(s for p, s in got if p == product)[: len(first)] == first
    assert list(trades._foremost(iter([]), 3)) == []
