"""Trades and quotes as they arrive: what a reconnect sends again is dropped, and a capture ends at its bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.order import blocks, in_order, unfolded, unpacked

_LOWEST = np.iinfo(np.int64).min
#: Rows that a task holds while it looks for the foremost.
_HELD = 100_000
_RISING = "product string, block long, packed binary, before long"
_BOUNDED = "product string, block long, packed binary, take long"


def _rising(table: pa.Table) -> tuple[pa.Table, dict]:
    """The trades of a block whose id is above all before them in it."""
    ids = table["trade_id"].to_numpy().astype(np.int64)
    before = np.maximum.accumulate(np.concatenate([[_LOWEST], ids]))
    return table.filter(pa.array(ids > before[:-1])), {"top": int(before[-1])}


class _Rising(StatefulProcessor):
    """One product: the greatest trade_id so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "trade_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = self.newest.get()[0] if self.newest.exists() else _LOWEST
        for b in in_order(rows):
            if b.top > newest:
                yield pd.DataFrame([(key[0], b.block, b.packed, newest)], columns=["product", "block", "packed", "before"])
                newest = int(b.top)
        self.newest.update((newest,))

    def close(self) -> None:
        pass


class _Bounds(StatefulProcessor):
    """One product: how many rows were taken, when the first was, and whether the capture is over."""

    def __init__(self, count: int | None, span_ns: int | None):
        self.count, self.span_ns = count, span_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "rows long, first_ns long, over boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, first, over = self.taken.get() if self.taken.exists() else (0, None, False)
        if over:
            return
        for b in in_order(rows):
            first, take = int(b.first_ns) if first is None else first, int(b.n)
            if self.span_ns is not None and b.most_ns >= first + self.span_ns:
                take, over = int((unpacked(b.packed)["ts_ns"].to_numpy() >= first + self.span_ns).argmax()), True
            if self.count is not None:
                take = min(take, self.count - done)
            done += take
            over = over or done == self.count
            yield pd.DataFrame([(key[0], b.block, b.packed, take)], columns=["product", "block", "packed", "take"])
            if over:
                break
        self.taken.update((done, first, over))

    def close(self) -> None:
        pass


def _first(table: pa.Table, count: int) -> pa.Table:
    table = table.sort_by([("product", "ascending"), ("seq", "ascending")])
    product = table["product"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    begins = np.flatnonzero(np.diff(product, prepend=-1))
    place = np.arange(len(product)) - np.repeat(begins, np.diff(np.append(begins, len(product))))
    return table.filter(pa.array(place < count))


def _foremost(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """Of a task's rows, those that no `count` others of their product come before: a capture can't reach the rest.  Where there are so many
    products that these pass the rows held, they go on as they are, and the task begins anew."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            held = _first(pa.Table.from_batches(held), count).combine_chunks().to_batches()
            if 2 * sum(b.num_rows for b in held) > _HELD:
                yield from held
                held = []
    if held:
        yield from _first(pa.Table.from_batches(held), count).to_batches()


def rising_trades(trades: DataFrame) -> DataFrame:
    """A streaming table of trades (product, trade_id, seq, any others) without those whose id is not above all before them, per product, however
    long ago that was: no watermark, one number of state a product.  seq is the order of arrival; a micro-batch's rows of a product
    are put in order in blocks of it.  Start it within state.settings(), in append mode."""
    found = blocks(trades, _rising, "top long").groupBy("product").transformWithStateInPandas(_Rising(), _RISING, "Append", "None")
    return unfolded(found, lambda b, rows: iter(rows.filter(pc.greater(rows["trade_id"], b["before"])).to_batches()), trades.schema)


def bounded(rows: DataFrame, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """A streaming table's first rows of each product in order of seq, by count and/or exchange time; the first row at or past the end isn't taken,
    and nothing after it.  Start it within state.settings(), in append mode."""
    if count is None and seconds is None:
        raise ValueError("a capture needs a count, a number of seconds, or both")

    def describe(table: pa.Table) -> tuple[pa.Table, dict]:
        table = table if count is None else table.slice(0, count)  # of a block, no more can be taken
        return table, {"n": table.num_rows, "first_ns": table["ts_ns"][0].as_py(), "most_ns": pc.max(table["ts_ns"]).as_py()}

    schema = rows.schema
    if count is not None:  # no task sends on more than a capture may take of it
        rows = rows.mapInArrow(lambda batches: _foremost(batches, count), schema)
    state = _Bounds(count, None if seconds is None else round(seconds * 1e9))
    found = blocks(rows, describe, "n long, first_ns long, most_ns long").groupBy("product").transformWithStateInPandas(state, _BOUNDED, "Append", "None")
    return unfolded(found, lambda b, table: iter(table.slice(0, b["take"]).to_batches()), schema)
