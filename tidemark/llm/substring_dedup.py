"""Substring deduplication by content-defined chunking.

A gear hash rolls over each text's bytes.  A chunk ends before a word whose hash is the least among
its REACH neighbours on either side, so cut points depend on the text around them only: after an
insertion, or in another document, the same passage is cut at the same words again.  Chunks are
deduplicated by digest; a run of chunks that all occur elsewhere is a repeated passage if it has MIN_WORDS words.

Moved: a digest and a row number for each chunk, twice, and the texts once, to cut the passages
out.  A digest that very many documents share is one combined row in the count, and in the join back
Spark splits its partition (both sides are plain exchanges).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stash
from tidemark.llm.near_dedup import _SPACE, _mix, _powers, row_keys

#: A cut stands before the word with the least hash among so many words before and after; some 7 words a chunk.
REACH = 3
#: A shorter run of repeated chunks is no passage.
MIN_WORDS = 16

_GEAR = _mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cut_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of a text's UTF-8 bytes start (0 first), and where its words do."""
    gap = _SPACE[data]
    words = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1]))) if data.size else np.zeros(0, np.int64)
    # hash at i = sum of gear[byte i - j] << j over 32 bytes, doubled up in five steps
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h[:-step] << np.uint32(step)
        h[step:] += shifted
    at = h[words[1:] - 1]
    least = np.ones(at.size, bool)
    for k in range(1, REACH + 1):
        least[k:] &= at[k:] < at[:-k]
        least[:-k] &= at[:-k] <= at[k:]
    return np.concatenate(([0], words[1:][least])), words


def chunk_digests(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit digests of the chunks, of their bytes without white space at the end."""
    forth, back = _powers(max(20, int(data.size).bit_length()))
    solid = ~_SPACE[data]
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[: data.size], out=sums[1:])
    last = np.maximum.accumulate(np.where(solid, np.arange(1, data.size + 1), 0))
    ends = np.maximum(last[np.concatenate((starts[1:], [data.size])) - 1], starts)
    return _mix((sums[ends] - sums[starts]) * back[starts]).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for text in batch.column(1):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            lists.append(chunk_digests(data, cut_points(data)[0]) if data.size else np.zeros(0, np.int64))
        ends = np.cumsum([0, *(x.size for x in lists)], dtype=np.int32)
        digests = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), digests], ["o", "k1", "digests"])


def _runs(flags: np.ndarray, starts: np.ndarray, words: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Byte spans of runs of flagged chunks with enough words."""
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    bounds = np.append(starts, size)
    spans = [(int(bounds[a]), int(bounds[b])) for a, b in zip(edges[::2], edges[1::2])]
    return [(a, b) for a, b in spans if np.searchsorted(words, b) - np.searchsorted(words, a) >= least]


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, hits, digests, mine in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            raw = text.as_buffer().to_pybytes()
            if not hits.is_valid:
                out.append((doc, raw.decode(), 0, 0, [], []))
                continue
            data = np.frombuffer(raw, np.uint8)
            starts, words = cut_points(data)
            known, later = np.zeros(starts.size, bool), np.zeros(starts.size, bool)
            at = hits.values.to_numpy()
            # the first place of a digest stays: in the first document that has it, its first chunk
            kept = np.zeros(at.size, bool)
            kept[np.unique(digests.values.to_numpy(), return_index=True)[1]] = True
            known[at], later[at] = True, ~(kept & np.array(mine.as_py(), bool))
            seen = _runs(known, starts, words, data.size, least)
            # of a repeated passage, what stands here first stays
            gone = [s for a, b in seen for s in _runs(later & (starts >= a) & (starts < b), starts, words, data.size, least)]
            count = lambda spans: int(sum(np.searchsorted(words, b) - np.searchsorted(words, a) for a, b in spans))
            kept_bytes, end = [], 0
            for a, b in gone:
                kept_bytes.append(raw[end:a])
                end = b
            kept_bytes.append(raw[end:])
            chars = lambda b: len(raw[:b].decode())
            out.append((doc, b"".join(kept_bytes).decode(), count(seen), count(gone), [chars(a) for a, _ in gone], [chars(b) for _, b in gone]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "text", "repeated_words", "removed_words", "removed_from", "removed_to"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, text without the passages that stand elsewhere before, repeated_words (in passages
    that stand elsewhere too, before or after), removed_words, removed_from and removed_to (their places in characters).

    Before is a smaller doc_id (null comes last; of equal ids, the lesser hash of id and text).  Null text becomes empty.  Rows that repeat id and text
    count as one document and stay as they are to each other.  At the edges of a passage up to some ten words
    may remain, where its chunks reach beyond it.  Other columns are ignored.
    """
    # where a document stands: its id, and a hash of id and text, equal for rows that repeat both only
    rows = row_keys(docs, text, doc_id).select("id", "body", "k1", F.coalesce("id", F.lit(2**63 - 1)).alias("o"))
    chunked = stash(rows.select("o", "body", "k1").mapInArrow(_chunks, "o long, k1 long, digests array<long>"), "chunks")
    again = chunked.groupBy("o", "k1").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("o", "k1")
    if not again.isEmpty():  # of rows that repeat id and text, one is looked at
        again = stash(again, "again")
        several = chunked.join(again, ["o", "k1"], "left_semi").dropDuplicates(["o", "k1"])
        chunked = stash(chunked.join(again, ["o", "k1"], "left_anti").unionByName(several), "chunks-once")
    places = chunked.select("o", "k1", F.posexplode("digests").alias("at", "digest"))
    shared = places.groupBy("digest").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("o", "k1")).alias("first")).where("places > 1")
    shared = stash(shared.select("digest", "first"), "shared")
    met = places.join(shared, "digest").select("o", "k1", "at", "digest", (F.struct("o", "k1") == F.col("first")).alias("mine"))
    # a document's chunks: bounded by its length
    hits = met.groupBy("o", "k1").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "mine"))).alias("hits"))
    one = lambda field: F.transform("hits", lambda h: h[field]).alias(field)
    hits = stash(hits.select("o", "k1", one("at"), one("digest"), one("mine")), "hits")
    joined = rows.join(hits, ["o", "k1"], "left").select("id", "body", "at", "digest", "mine")
    return joined.mapInArrow(
        lambda b: _cut(b, min_words), "doc_id long, text string, repeated_words long, removed_words long, removed_from array<long>, removed_to array<long>"
    )
