"""A session folded as it arrives: the summary's figures from a few numbers of state per session.

The same report has two forms.  replay() is the batch form: partial aggregates whose memory is bounded already.  stream() is
Structured Streaming.  Each task of a micro-batch folds the rows it reads in their order of arrival, an Arrow batch at a time, into one piece
per session, and carries one tick of each session from batch to batch.  State of a few numbers per session then joins the pieces of
the micro-batch to what was folded before.  No task gathers a session's rows, be it one of a thousand rows or of a
thousand millions, and a hot session leaves its readers as one row each.

A tick older than the one before it is an error, not a late row to drop: within a batch, between the batches of a task, between the tasks of a
micro-batch (whose pieces must not overlap in time) and between micro-batches.

chunk_rows bounds the rows that a task holds at once.  chunks says how many such a session takes, and peak_rows_in_memory what a reader holds
at most of it: a chunk and the tick before it.  rows_held is counted while folding, and a fold that held more than that bound fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import r8, safe_div
from tidemark.operators.ticks import _elapsed
from tidemark.streaming.state import latest, to_table

CHUNK_ROWS = 4096
#: Sessions of which a task carries a tick; where more are open at once, all pieces are sent on.
OPEN_SESSIONS = 10_000
_SUMS = "rows long, first_ts long, first_price double, last_ts long, last_price double, pv double, buy double, sell double, num double, den double, held long"
#: Pieces say where they were read, and the first tick that is older than the one before it: its place, its time and the time before.
_PIECE = f"session string, {_SUMS}, part long, nth long, late_at long, late_ts long, late_after long"


def _report(key: Column, chunk_rows: int) -> list[Column]:
    """The report from the sums of a session: rows, first_ts, last_ts, pv, buy, sell, num, den."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be >= 1")
    v, rows, chunk = F.col("buy") + F.col("sell"), F.col("rows"), F.lit(chunk_rows).cast("long")
    chunks = F.ceil(rows / chunk)
    balance = F.coalesce(safe_div(F.col("buy") - F.col("sell"), v), F.lit(0.0))
    return [
        key, rows, F.col("first_ts").alias("first_ts_ns"), F.col("last_ts").alias("last_ts_ns"), r8(v).alias("volume"), r8("pv").alias("notional"), r8(safe_div(F.col("pv"), v)).alias("vwap"),
        r8(safe_div("num", "den")).alias("twap"), r8("buy").alias("buy_volume"), r8("sell").alias("sell_volume"), r8(balance).alias("imbalance"),
        chunk.alias("chunk_rows"), chunks.cast("long").alias("chunks"), (F.least(rows, chunk) + (chunks > 1).cast("long")).alias("peak_rows_in_memory"),
    ]


def replay(ticks: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per session: what stream() reports at its end."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("size"))), F.lit(0.0))
    sums = ticks.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"), F.sum(F.col("price") * F.col("size")).alias("pv"), side("buy").alias("buy"), side("sell").alias("sell")
    )
    return sums.join(_elapsed(ticks, [key]).select(key, "num", "den"), key).select(*_report(F.col(key), chunk_rows))


def refuse_disorder(ticks: DataFrame) -> None:
    """Raise ValueError where a tick is older than the one before it in the order of reading; a row per task comes to the driver."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, last, bad = 0, None, None, None
        for df in batches:
            ts, seq = df["ts_ns"].to_numpy(), df["seq"].to_numpy()
            if not ts.size:
                continue
            steps = np.diff(ts, prepend=ts[0] if last is None else last) < 0
            if bad is None and steps.any():
                k = int(steps.argmax())
                bad = (n + k + 1, int(ts[k]), int(ts[k - 1] if k else last))
            first, last, n = int(ts[0]) if first is None else first, int(ts[-1]), n + ts.size
            part = int(seq[0]) >> 33
        if n:
            yield pd.DataFrame([(part, n, first, last, *(bad or (0, 0, 0)))], columns=["part", "n", "first", "last", "at", "ts", "before"])

    rows = ticks.select("ts_ns", F.monotonically_increasing_id().alias("seq")).mapInPandas(scan, "part long, n long, first long, last long, at long, ts long, before long").collect()
    done, last = 0, None
    for r in sorted(rows):
        if last is not None and r["first"] < last:
            raise ValueError(f"replay is not in time order at row {done + 1}: {r['first']} follows {last}")
        if r["at"]:
            raise ValueError(f"replay is not in time order at row {done + r['at']}: {r['ts']} follows {r['before']}")
        done, last = done + r["n"], r["last"]


def _fold_batch(now: dict | None, ts: np.ndarray, price: np.ndarray, size: np.ndarray, bought: np.ndarray, rows_held: int) -> dict:
    """A session's rows of one batch, in order of arrival, added to its sums; the last tick of `now` is what is carried."""
    steps, late = np.diff(ts), None
    if now is not None and ts[0] < now["last_ts"]:
        late = (now["rows"] + 1, int(ts[0]), now["last_ts"])
    elif (steps < 0).any():
        k = int((steps < 0).argmax()) + 1
        late = ((now["rows"] if now else 0) + k + 1, int(ts[k]), int(ts[k - 1]))
    held = steps.astype(float)
    made = {
        "rows": len(ts), "first_ts": int(ts[0]), "first_price": float(price[0]), "last_ts": int(ts[-1]), "last_price": float(price[-1]), "pv": float((price * size).sum()),
        "buy": float(size[bought].sum()), "sell": float(size[~bought].sum()), "num": float((price[:-1] * held).sum()), "den": float(held.sum()), "held": rows_held, "late": late,
    }
    return made if now is None else _joined(now, made)


def _joined(a: dict, b: dict) -> dict:
    """The sums of two runs of ticks, b right after a: a's last tick stands until b's first."""
    gap = float(b["first_ts"] - a["last_ts"])
    sums = {k: a[k] + b[k] for k in ("rows", "pv", "buy", "sell", "num", "den")}
    sums["num"], sums["den"] = sums["num"] + a["last_price"] * gap, sums["den"] + gap
    return sums | {k: a[k] for k in ("first_ts", "first_price")} | {k: b[k] for k in ("last_ts", "last_price")} | {"held": max(a["held"], b["held"]), "late": a.get("late") or b.get("late")}


def _pieces(chunk_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session, ts_ns, price, size, bought) in order of arrival to a piece per session."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in _PIECE.split(", ")]
    part, nth, open_ = TaskContext.get().partitionId(), 0, {}

    def sent() -> pa.RecordBatch:
        nonlocal nth
        rows = [{"session": s, **p, "part": part, "nth": nth, **dict(zip(("late_at", "late_ts", "late_after"), p["late"] or (None,) * 3))} for s, p in open_.items()]
        nth += 1
        open_.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    for batch in batches:
        for lo in range(0, batch.num_rows, chunk_rows):
            rows = batch.slice(lo, chunk_rows)
            session = rows.column(0).dictionary_encode()
            ts, price, size, bought = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            code = session.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []:
                name = session.dictionary[int(code[at[0]])].as_py()
                now = open_.get(name)
                # what is in memory of this session: its rows of the whole batch that Arrow brought, and the tick carried
                in_batch = len(at) if batch.num_rows <= chunk_rows else batch.num_rows
                open_[name] = _fold_batch(now, ts[at], price[at], size[at], bought[at].astype(bool), in_batch + (now is not None))
        if len(open_) > OPEN_SESSIONS:
            yield sent()
    yield sent()


class _Session(StatefulProcessor):
    """One session: its sums so far, to which a micro-batch's pieces are joined in order of time."""

    def __init__(self, chunk_rows: int):
        self.chunk_rows = chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in _SUMS.split(", ")]
        pieces = pd.concat(list(rows)).sort_values(["first_ts", "last_ts", "part", "nth"])  # a row for each task
        now = dict(zip(names, self.sums.get())) if self.sums.exists() else None
        for p in pieces.itertuples(index=False):
            done = now["rows"] if now else 0
            if not pd.isna(p.late_at):
                raise ValueError(f"replay is not in time order at row {done + int(p.late_at)}: {int(p.late_ts)} follows {int(p.late_after)}")
            if now is not None and p.first_ts < now["last_ts"]:
                raise ValueError(f"replay is not in time order at row {done + 1}: {p.first_ts} follows {now['last_ts']}")
            made = {n: getattr(p, n) for n in names}
            now = made if now is None else _joined(now, made)
        whole = {"long": int, "double": float}
        state = tuple(whole[c.split()[1]](now[c.split()[0]]) for c in _SUMS.split(", "))
        if now["held"] > min(now["rows"], self.chunk_rows) + (now["rows"] > self.chunk_rows):
            raise ValueError(f"{now['held']} rows were in memory; chunk_rows is {self.chunk_rows}: start the stream within settings()")
        self.sums.update(state)
        yield pd.DataFrame([(str(key[0]), *state)], columns=["session", *names])

    def close(self) -> None:
        pass


def stream(ticks: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A streaming table of ticks to a stream of reports, the newest of each session in update mode.  Start it within
    state.settings(spark, chunk_rows), as to_end() does."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be >= 1")
    rows = ticks.select(F.col(key).cast("string").alias("session"), "ts_ns", F.col("price").cast("double"), F.col("size").cast("double"), (F.col("side") == "buy").alias("bought"))
    pieces = rows.mapInArrow(lambda batches: _pieces(chunk_rows, batches), _PIECE)
    sums = pieces.groupBy("session").transformWithStateInPandas(_Session(chunk_rows), f"session string, {_SUMS}", "Update", "None")
    return sums.select(*_report(F.col("session"), chunk_rows), F.col("held").alias("rows_held"))


def to_end(reports: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last report of each session, once the stream has taken all that its source has."""
    return latest(to_table(reports, chunk_rows), "session", "rows")
