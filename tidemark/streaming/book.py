"""A level-2 book kept as state while its updates arrive."""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.ladder import ladders
from tidemark.streaming.order import blocks, in_order, unfolded, unpacked

_OUT = "ts_ns long, product string, side string, level long, price double, size double"
#: Rows that a fold gives on at once.
_SENT = 100_000
_BLOCK = "product string, block long, packed binary, levels string, written_ns long, written string"


def _describe(table: pa.Table) -> tuple[pa.Table, dict]:
    """A block's updates, and the last size of each level that they leave from their newest snapshot on, or else from any book before."""
    seq, seeds = table["seq"].to_numpy(), table["snapshot"].to_numpy(zero_copy_only=False)
    since = int(np.searchsorted(seq, seq[seeds][-1])) if seeds.any() else 0
    last = table.select(["side", "price", "size"]).slice(since).to_pandas().drop_duplicates(["side", "price"], keep="last")
    said = {"first_seq": int(seq[0]), "last_seq": int(seq[-1]), "seeded": bool(seeds.any()), "seeds_last": bool(seeds[np.searchsorted(seq, seq[-1])]), "levels": json.dumps(last.values.tolist())}
    return table, said


def _messages(table: pa.Table) -> Iterator[tuple]:
    """(ts_ns, seeds, its first row, the row after its last) of each message; rows of one seq are one."""
    seq, ts, seeds = table["seq"].to_numpy(), table["ts_ns"].to_numpy(), table["snapshot"].to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.diff(seq, prepend=seq[0] - 1))
    return zip(ts[begins].tolist(), seeds[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(seq)])


def _updates(table: pa.Table) -> tuple[list, list, list]:
    return table["side"].to_pylist(), table["price"].to_numpy().tolist(), table["size"].to_numpy().tolist()


def _fold(levels: int, every_ns: int | None, table: pa.Table, book: list, written_ns: int | None, written: dict | None) -> Iterator[tuple]:
    """(ts_ns, top levels) of each message of a block that is written, from the book that stands before it and what was written last."""
    sides = ladders()
    for side, price, size in book:
        sides[side].put(price, size)
    side, price, size = _updates(table)
    for ts, seeds, begin, end in _messages(table):
        if seeds:  # the whole book anew, after a connection was lost
            sides = ladders()
        for k in range(begin, end):
            sides[side[k]].put(price[k], size[k])
        if seeds or not sides["bid"].order or not sides["ask"].order:
            continue
        if every_ns is not None and written_ns is not None and ts - written_ns < every_ns:
            continue
        tops = {s: sides[s].top(levels) for s in ("bid", "ask")}
        if every_ns is None and tops == written:
            continue
        written_ns, written = ts, tops
        yield ts, tops


def _last_written(every_ns: int, table: pa.Table, book: list, written_ns: int | None) -> int | None:
    """When a block writes last, on a grid of time: only which sides have levels matters.  The one step that a product's blocks take one after the
    other, so it goes by arrays, and from one written message to the next."""
    seq, ts, seeds = table["seq"].to_numpy(), table["ts_ns"].to_numpy(), table["snapshot"].to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.diff(seq, prepend=seq[0] - 1))
    ts, seeds, ends = ts[begins], seeds[begins], np.append(begins[1:], len(seq)) - 1
    # the book before counts as updates too; from each seed on, levels are others
    n = len(book)
    bid = np.concatenate([np.array([s == "bid" for s, _, _ in book], bool), pc.equal(table["side"], "bid").to_numpy()])
    price = np.concatenate([np.array([p for _, p, _ in book], float), table["price"].to_numpy()])
    held = np.concatenate([np.ones(n, bool), table["size"].to_numpy() != 0])
    epoch = np.zeros(n + len(seq), np.int64)
    epoch[n + begins[seeds]] = 1
    epoch = np.cumsum(epoch)
    at = np.lexsort((price, bid, epoch))  # a level's updates in a row, in order
    same = np.concatenate([[False], (np.diff(epoch[at]) == 0) & (bid[at][1:] == bid[at][:-1]) & (price[at][1:] == price[at][:-1])])
    moved = np.empty(len(at), np.int64)
    moved[at] = held[at].astype(np.int64) - (same & np.roll(held[at], 1))
    both = ~seeds
    for side in (bid, ~bid):
        count = np.concatenate([[0], np.cumsum(moved * side)])
        since = count[np.concatenate([[0], n + begins[seeds]])]
        both &= count[n + ends + 1] > since[epoch[n + ends]]
    ts = ts[both]
    newest, k = np.maximum.accumulate(ts).tolist(), 0
    while k < len(newest):
        # all before a written message are earlier than it, so the newest so far tell which is next
        k = k if written_ns is None else bisect_left(newest, written_ns + max(every_ns, 1), k)
        if k < len(newest):
            written_ns = int(ts[k])
    return written_ns


def _read(said: str | None) -> dict | None:
    return None if said is None else {s: [tuple(x) for x in tops] for s, tops in json.loads(said).items()}


class _Book(StatefulProcessor):
    """One product: its levels in a map, and in a value the newest message, and when and what was written last.

    It is given a row for each block of updates, and gives each on with the book that stands before it and what was written last by then."""

    def __init__(self, levels: int, every_ns: int | None):
        self.levels, self.every_ns = levels, every_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getMapState("book", "side string, price double", "size double")
        self.mark = handle.getValueState("mark", "seq long, written_ns long, written string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, written_ns, written = self.mark.get() if self.mark.exists() else (None, None, None)
        held = {(s, p): z for (s, p), (z,) in self.book.iterator()} if self.book.exists() else {}
        now = dict(held)
        for b in in_order(rows):
            if seq is not None and b.first_seq <= seq:
                raise ValueError(f"update {b.first_seq} of {key[0]} follows {seq}")
            before = [(s, p, z) for (s, p), z in now.items()]
            yield pd.DataFrame({"product": [key[0]], "block": [b.block], "packed": [b.packed], "levels": [json.dumps(before)], "written_ns": pd.array([written_ns], "Int64"), "written": [written]})
            if b.seeded:
                now = {}
            for s, p, z in json.loads(b.levels):
                if z:
                    now[s, p] = z
                else:
                    now.pop((s, p), None)
            seq = int(b.last_seq)
            if self.every_ns is not None:
                written_ns = _last_written(self.every_ns, unpacked(b.packed), before, written_ns)
            else:
                written = self._said(b, before, now, written)
        for level in held.keys() - now.keys():
            self.book.removeKey(level)
        for level, size in now.items():
            if held.get(level) != size:
                self.book.updateValue(level, (size,))
        self.mark.update((seq, written_ns, written))

    def _said(self, b: tuple, before: list, now: dict, written: str | None) -> str | None:
        """The top levels that stand as written after a block: those it ends with, or where its last message is none to write, those of the last that is."""
        bids, asks = ([(p, z) for (s, p), z in now.items() if s == side] for side in ("bid", "ask"))
        if bids and asks and not b.seeds_last:
            return json.dumps({"bid": heapq.nlargest(self.levels, bids), "ask": heapq.nsmallest(self.levels, asks)})
        for _, tops in _fold(self.levels, None, unpacked(b.packed), before, None, _read(written)):
            written = json.dumps(tops)
        return written

    def close(self) -> None:
        pass


def _rows(levels: int, every_ns: int | None, b: dict, table: pa.Table) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [c.split() for c in _OUT.split(", ")]

    def sent() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(fields)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])

    for ts, tops in _fold(levels, every_ns, table, json.loads(b["levels"]), b["written_ns"], _read(b["written"])):
        out += [(ts, b["product"], s, i, p, z) for s in ("bid", "ask") for i, (p, z) in enumerate(tops[s])]
        if len(out) >= _SENT:
            yield sent()
    yield sent()


def l2_stream(updates: DataFrame, levels: int = 10, every: float | None = None) -> DataFrame:
    """A streaming table of level-2 updates to a stream of book rows (ts_ns, product, side, level, price, size), in append mode.

    updates: product, seq, ts_ns, side bid/ask, price, size (0 removes the level), snapshot (true: the message holds the whole book and seeds it
    anew; such a message is not written).  Rows of one seq are one message.  Every message moves the book.  Without `every`
    the top `levels` are written after each message that changed them; with it, at the first message that comes `every` seconds or more of
    exchange time after the last one written, changed or not.  Nothing is written while a side is empty.

    A message whose seq is not above all before it is an error.  The state of a product is its book; a micro-batch's updates of a
    product are put in order and folded in blocks of seq, each in a task of its own from the book that stands before it.  Start it within state.settings().
    """
    if levels < 1:
        raise ValueError("levels must be >= 1")
    if every is not None and not every > 0:
        raise ValueError("every must be a positive number of seconds")
    rows = updates.select("product", "seq", "ts_ns", "side", F.col("price").cast("double"), F.col("size").cast("double"), F.coalesce("snapshot", F.lit(False)).alias("snapshot"))
    every_ns = None if every is None else round(every * 1e9)
    described = "first_seq long, last_seq long, seeded boolean, seeds_last boolean, levels string"
    found = blocks(rows, _describe, described, ["snapshot"]).groupBy("product").transformWithStateInPandas(_Book(levels, every_ns), _BLOCK, "Append", "None")
    return unfolded(found, lambda b, table: _rows(levels, every_ns, b, table), _OUT)
