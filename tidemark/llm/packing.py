"""Packing of documents into sequences of a fixed number of tokens, by best-fit decreasing.

A document longer than a sequence is first cut into full windows, which need no search.  What is
left of it, and every shorter document, is placed in order of falling length into the open window
whose remaining room is the smallest that suffices; a segment tree over the possible rooms finds it
in the logarithm of the sequence length.

Each input partition is tokenised and packed on its own, in one pass and without a shuffle.  Only
lengths and ids of documents are held, at most BLOCK at a time; a lost task is simply run again
and gives the same sequences.  Windows of which less than FULL is used are opened again: their pieces, a few windows' worth of rows from
each partition, are packed anew by as few tasks as BLOCK allows, so that small partitions don't cost padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash, text_of

#: Tails packed together; bounds a worker's memory.
BLOCK = 200_000
#: A window counts as full from this share of it on; others are packed again across partitions.
FULL = 0.995
#: Characters handed to the tokenizer at a time; a longer text is cut at white space.
CHARS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class RoomTree:
    """Open windows by remaining room; best() is the smallest room of at least `need` that has one."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def put(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, room: int) -> int:
        k = room + self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return self.windows[room].pop()

    def best(self, need: int) -> int | None:
        count, k = self.count, need + self.leaves
        if count[k]:
            return need
        # up until a right sibling has a window, then down to its smallest room
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, all at most `size`; windows are numbered from 0."""
    tree, placed, opened = RoomTree(size), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[k]
        room = tree.best(need)
        if room is None:
            window, room, opened = opened, size, opened + 1
        else:
            window = tree.take(room)
        placed[k] = (window, size - room)
        if room > need:
            tree.put(room - need, window)
    return placed


def _chunks(text: str) -> Iterator[str]:
    """The text in parts of about CHARS characters, cut between words."""
    while len(text) > CHARS:
        cut = max(text.rfind(" ", 0, CHARS), text.rfind("\n", 0, CHARS))
        if cut <= 0:
            break
        yield text[:cut]
        text = text[cut:]
    yield text


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from tidemark.llm.wordbpe import shared

    bpe, end = shared(tokenizer), end_id.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 33
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
    out: list[tuple] = []
    tails: list[tuple] = []

    def rows(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], columns)

    def place() -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        placed = best_fit_decreasing([t[2] for t in tails], size)
        used: dict[int, int] = {}
        for t, (w, _) in zip(tails, placed):
            used[w] = used.get(w, 0) + t[2]
        done = [(*t[:5], sequence + w, at, used[w], *t[5:]) for t, (w, at) in zip(tails, placed)]
        sequence += 1 + max((w for w, _ in placed), default=-1)
        tails.clear()
        for lo in range(0, len(done), 20_000):
            yield rows(done[lo : lo + 20_000])

    def documents() -> Iterator[tuple[int | None, bytes]]:
        ids: list[int | None] = []
        texts: list[str] = []
        chars = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text) > CHARS:
                    yield doc, b"".join(x for c in _chunks(text) for x in bpe.encode_batch([c]))
                    continue
                ids.append(doc)
                texts.append(text)
                chars += len(text)
                if chars > CHARS:
                    yield from zip(ids, bpe.encode_batch(texts))
                    ids, texts, chars = [], [], 0
        yield from zip(ids, bpe.encode_batch(texts))

    for doc, tokens in documents():
        tokens += end
        n = len(tokens) // 4
        for start in range(0, n, size):
            part = tokens[4 * start : 4 * (start + size)]
            length = len(part) // 4
            row = (doc, start, length, zlib.crc32(part), n)
            if length == size:
                out.append((*row, sequence, 0, size, *[part] * with_ids))
                sequence += 1
            else:
                tails.append((*row, *[part] * with_ids))
        if len(out) >= 20_000 // (1 + 19 * with_ids):
            yield rows(out)
            out.clear()
        if len(tails) >= BLOCK // (1 + 19 * with_ids):
            yield from place()
    if out:
        yield rows(out)
    yield from place()


def _repack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces with new sequence_id and offset, BLOCK of them at a time."""
    sequence, held, rows = (1 << 62) | (TaskContext.get().partitionId() << 33), [], 0

    def place() -> pa.RecordBatch:
        nonlocal sequence
        some = pa.Table.from_batches(held).combine_chunks()
        # in an order of their own, whatever order the files were read in
        some = some.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(some["length"].to_pylist(), size)
        for name, values in (("sequence_id", [sequence + w for w, _ in placed]), ("offset", [at for _, at in placed])):
            some = some.set_column(some.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        sequence += 1 + max(w for w, _ in placed)
        return some.to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= BLOCK:
            yield place()
            held, rows = [], 0
    if held:
        yield place()


def pack(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 1,
    text: str = "text",
    doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of packed documents, a row each.

    doc_id, start (the document's tokens before the piece), length, ids_crc32 (of the little-endian
    unsigned 32-bit ids), doc_tokens (with the end id), sequence_id, offset (where the piece
    stands in its sequence); with_ids adds the ids themselves as binary.  Each id of each document
    lies in exactly one piece.  A null text is empty: its one token is the end id.  Null and
    repeated doc_ids are packed like others.  An empty table gives no rows.  sequence_id is
    unique over the whole result; it isn't dense.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = SCHEMA + ", ids binary" * with_ids
    first = stash(rows.mapInArrow(lambda batches: _pack(batches, tokenizer, size, end_id, with_ids), SCHEMA + ", used long" + ", ids binary" * with_ids), "pieces")
    is_open = F.col("used") < FULL * size
    opened = first.where(is_open).drop("used")
    tasks = 1 + first.where(is_open).count() // BLOCK
    # fewer tasks than files: coalesce() reads several files in one task, without a shuffle
    return first.where(~is_open).drop("used").unionByName(opened.coalesce(tasks).mapInArrow(lambda batches: _repack(batches, size), schema))
