"""Katz backoff scoring with Good-Turing discounts.

Words are lower-cased runs between white space; a text ends in one more token, the end.  The model backs off
from bigrams to unigrams to one class for all unseen words:

    P(w | h) = d(c(h, w)) * c(h, w) / c(h)      for bigrams seen in training, be it once
             = alpha(h) * P(w)                  else, with alpha(h) such that the probabilities of h sum to one exactly
    P(w)     = d(c(w)) * c(w) / N               for seen words; what the discounts leave belongs to the unseen class

The log probability of a text is evaluated as a sum over its tokens of log P(w) and log alpha(h), and of a gain
log P(w | h) - log P(w) - log alpha(h) for each bigram that has an entry.

Words travel as 64-bit hashes.  A task sorts the tokens of a chunk of documents and sends each partition of the tables one
packed row: the sorted keys as byte planes of their differences, and for each key its count or the documents in which it
stands.  So counting and scoring move some bytes for each distinct key of a chunk and two for each token, not a row for each token.
Tables are written Parquet: words by a hash of the word, bigrams beside the count of their word.  A bigram meets its word where
the words of that hash are counted, and its history where those of that hash are; the tokens to be scored are sent there too, so gains
are added up where they are made, and no table is joined by sorting.

Skew: a word that has its share of a whole partition, of which there can be no more than partitions, is known to every
task; its bigrams are dealt by their own hash instead of by the word's, and the sums of such a history are aggregated on the map side.
Keys that have one in HOT of all tokens, no more than HOT, are evaluated where they stand and never sent.  Partitions
follow the number of tokens, so none grows with the data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, stash, text_of
from tidemark.llm.near_dedup import _K1, _mix, _texts, word_hashes

#: Counts up to this have Good-Turing discounts; larger ones lose half a count.
GOOD_TURING = 5
#: Tokens and documents of a chunk; bounds a task's memory.
TOKENS, DOCUMENTS = 1_000_000, 60_000
#: Tokens of a partition of the tables, and most keys whose values every task is given (some 3 MB).
PART_TOKENS, HOT = 2_000_000, 100_000

END, BOS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

#: A packed row: what it is (a chunk's name, or one of the kinds below), and up to five arrays.
_ROW = "p int, chunk long, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["p", "chunk", "a", "b", "c", "d", "e"]
_KINDS = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
WORDS, ENTRIES, BACKOFFS = -1, -2, -3


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal weight side by side, so that what is mostly zero compresses away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(x.size, x.itemsize).T).tobytes()


def _unplane(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _deltas(sorted_keys: np.ndarray) -> bytes:
    return _planes(np.diff(sorted_keys, prepend=np.uint64(0)))


def _undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplane(raw, np.uint64), dtype=np.uint64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of uniformly distributed keys: ranges of their upper half, so sorting by key sorts by partition."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _joint(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(history * _K1 + word)


class Chunk:
    """Tokens of some documents: word, history and document of each; and of each document id, length and whether it trains."""

    def __init__(self, ids: list, trains: list, lengths: list, words: list[np.ndarray], partition: int, number: int):
        self.ids, self.trains, self.lengths = ids, np.array(trains, bool), np.array(lengths, np.int64)
        self.words = np.concatenate(words)
        self.docs = np.repeat(np.arange(len(ids), dtype=np.uint16), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        self.history = np.concatenate(([BOS], self.words[:-1]))
        self.history[first] = BOS
        # a name that another composition of chunks wouldn't give
        mark = zlib.crc32(repr((ids[0], ids[-1], len(ids), int(self.lengths.sum()))).encode())
        place = _mix(np.array([(partition << 32) | number], np.uint64)) + np.uint64(mark)
        self.name = int(_mix(place)[0] >> np.uint64(1))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Columns of batches: doc_id, trains, text with white space at its end."""
    partition, number = TaskContext.get().partitionId(), 0
    ids, trains, lengths, words, total = [], [], [], [], 0
    for batch in batches:
        id_list, train_list = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, data, offsets in _texts(batch, 2):
            starts, hashes = word_hashes(data)
            first = np.searchsorted(starts, offsets)
            for k in range(hi - lo):
                mine = hashes[first[k] : first[k + 1]]
                ids.append(id_list[lo + k])
                trains.append(train_list[lo + k])
                lengths.append(mine.size + 1)
                words += [mine, np.array([END])]
                total += mine.size + 1
                if total >= TOKENS or len(ids) >= DOCUMENTS:
                    yield Chunk(ids, trains, lengths, words, partition, number)
                    number, total = number + 1, 0
                    ids, trains, lengths, words = [], [], [], []
    if ids:
        yield Chunk(ids, trains, lengths, words, partition, number)


def _row(p: int, chunk: int, *arrays: bytes | None) -> pa.RecordBatch:
    values = [p, chunk, *arrays, *[None] * (5 - len(arrays))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _KINDS)], _NAMES)


def _spans(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of equal parts."""
    if parts.size:
        at = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
        yield from zip(parts[at].tolist(), at.tolist(), np.append(at[1:], parts.size).tolist())


class Known:
    """Sorted keys with a value each (or several), looked up by key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the keys, and whether each is really there."""
        at = np.minimum(np.searchsorted(self.keys, wanted), max(self.keys.size - 1, 0))
        return at, self.keys[at] == wanted if self.keys.size else np.zeros(wanted.size, bool)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Where each new key of a sorted array begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.zeros(0, np.int64)


def _dealt(keys: np.ndarray, joint: np.ndarray, often: Known, parts: int) -> np.ndarray:
    """The partition of bigrams: that of their key (word or history), or their own if the key is one of those that stand too often."""
    return np.where(often.find(keys)[1], _part(joint, parts), _part(keys, parts))


def _send_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Words of training text and how often each stands in the chunk."""
    for chunk in _chunks(batches):
        words = np.sort(chunk.words[chunk.trains[chunk.docs]])
        at = _distinct(words)
        times, words = np.diff(np.append(at, words.size)).astype(np.uint64), words[at]
        for p, lo, hi in _spans(_part(words, parts)):
            yield _row(p, chunk.name, _deltas(words[lo:hi]), _planes(times[lo:hi]))


def _send_pairs(batches: Iterator[pa.RecordBatch], parts: int, often: Known) -> Iterator[pa.RecordBatch]:
    """Bigrams of training text, by word, and how often each stands in the chunk."""
    for chunk in _chunks(batches):
        keep = chunk.trains[chunk.docs]
        words, history = chunk.words[keep], chunk.history[keep]
        joint = _joint(history, words)
        order = np.argsort(joint)
        at = _distinct(joint[order])
        times, first = np.diff(np.append(at, order.size)).astype(np.uint64), order[at]
        words, history = words[first], history[first]
        where = _dealt(words, joint[first], often, parts)
        order = np.lexsort((words, where))
        for p, lo, hi in _spans(where[order]):
            some = order[lo:hi]
            yield _row(p, chunk.name, _deltas(words[some]), _planes(history[some]), _planes(times[some]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of the words: (p, word, n), and rows (p = -1, word = r, n) of how many words have count r."""
    part, keys, counts = -1, [], []
    for batch in batches:
        for row in batch.to_pylist():
            part = row["p"]
            keys.append(_undelta(row["a"]))
            counts.append(_unplane(row["b"], np.uint64))
    merged, n, _ = _merge(keys, counts)
    seen, how_many = np.unique(n[n <= GOOD_TURING + 1], return_counts=True)
    columns = [np.append(np.full(n.size, part, np.int32), np.full(seen.size, -1, np.int32)), np.append(merged.view(np.int64), seen), np.append(n, how_many)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["p", "word", "n"])


def _words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of words as packed rows."""
    for batch in batches:
        p, words, n = (batch.column(k).to_numpy() for k in range(3))
        order = np.lexsort((words.view(np.uint64), p))
        for part, lo, hi in _spans(p[order].astype(np.int64)):
            some = order[lo:hi]
            yield _row(part, WORDS, _deltas(words.view(np.uint64)[some]), _planes(n[some].astype(np.uint64)))


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[dict]], list[dict]]:
    """The rows of one partition: table rows by kind, and rows of chunks."""
    tables: dict[int, list[dict]] = {}
    chunks: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] < 0:
                tables.setdefault(row["chunk"], []).append(row)
            else:
                chunks.append(row)
    return tables, chunks


def _table(rows: list[dict], kind: type) -> Known:
    keys = [_undelta(r["a"]) for r in rows]
    values = [_unplane(r["b"], kind) for r in rows]
    return Known(np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(values) if values else np.zeros(0, kind))


def _value(wanted: np.ndarray, *tables: Known) -> np.ndarray:
    """The value of each key in the first table that has it; every key is in one."""
    out = None
    for t in reversed(tables):
        at, there = t.find(wanted)
        found = t.values[at] if t.keys.size else np.zeros(wanted.size, t.values.dtype)
        out = found if out is None else np.where(there, found, out)
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch], often: Known) -> Iterator[pa.RecordBatch]:
    """One partition of the bigrams, by word: (kind = 0, history, word, n, c: the word's count), and rows (kind = 1, word = r, n) of how many have count r."""
    tables, chunks = _gather(batches)
    words, history = ([f(r[k]) for r in chunks] for k, f in (("a", _undelta), ("b", lambda x: _unplane(x, np.uint64))))
    merged, n, place = _merge([_joint(h, w) for h, w in zip(history, words)], [_unplane(r["c"], np.uint64) for r in chunks])
    seen, how_many = np.unique(n[n <= GOOD_TURING + 1], return_counts=True)
    word, before = (np.concatenate(x)[place] if x else np.zeros(0, np.uint64) for x in (words, history))
    order = np.argsort(word, kind="stable")  # equal words side by side: the table compresses
    word, before, n = word[order], before[order], n[order]
    count = _value(word, often, _table(tables.get(WORDS, []), np.uint64)).astype(np.int64)
    none = np.zeros(seen.size, np.int64)
    columns = [np.append(np.zeros(n.size, np.int32), np.ones(seen.size, np.int32)), np.append(before.view(np.int64), none), np.append(word.view(np.int64), seen), np.append(n, how_many), np.append(count, none)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "history", "word", "n", "c"])


def _send_entries(batches: Iterator[pa.RecordBatch], parts: int, often: Known) -> Iterator[pa.RecordBatch]:
    """The bigrams of a table's partition, by history: their keys, counts, and their words' counts."""
    columns = [[], [], [], []]
    for batch in batches:
        for k in range(4):
            columns[k].append(batch.column(k).to_numpy())
    if columns[0]:
        history, word, n, c = (np.concatenate(x).view(np.uint64) for x in columns)
        joint = _joint(history, word)
        where = _dealt(history, joint, often, parts)
        order = np.lexsort((history, where))
        for p, lo, hi in _spans(where[order]):
            some = order[lo:hi]
            yield _row(p, ENTRIES, _deltas(history[some]), _planes(joint[some]), _planes(n[some]), _planes(c[some]))


def _off(n: np.ndarray, d: list[float]) -> np.ndarray:
    """d(n) * n; a count beyond GOOD_TURING loses half a count, so that every history leaves something for other words."""
    n = n.astype(np.int64)
    return np.where(n <= GOOD_TURING, np.array(d)[np.minimum(n, GOOD_TURING)] * n, n - 0.5)


def _log_alpha(follows: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """What a history leaves to the words that don't follow it, over what these have among all words."""
    return np.log10((1 - kept / follows) / (1 - covered))


def _score_pairs(batches: Iterator[pa.RecordBatch], parts: int, d1: list[float], d2: list[float], total: int, often: Known) -> Iterator[pa.RecordBatch]:
    """One partition of the histories: the gains of its bigrams, summed over the tokens that chunks sent, and log alpha of each history.

    often has, for each history that stands too often for one partition, its count and the sums of its bigrams.
    """
    tables, chunks = _gather(batches)
    words, entries = _table(tables.get(WORDS, []), np.uint64), tables.get(ENTRIES, [])
    gains = Known(np.zeros(0, np.uint64), np.zeros(0))
    if entries:
        history = np.concatenate([_undelta(r["a"]) for r in entries])
        joint, n, c = (np.concatenate([_unplane(r[k], np.uint64) for r in entries]) for k in "bcd")
        entries.clear()
        kept, p_word = _off(n, d2), _off(c, d1) / total
        own, which = np.unique(history, return_inverse=True)
        at, common = often.find(own)
        pick = lambda column: often.values[at, column] if often.keys.size else np.zeros(own.size)
        follows = np.where(common, pick(0), _value(own, words).astype(float))
        log_alpha = _log_alpha(follows, np.where(common, pick(1), np.bincount(which, kept, minlength=own.size)), np.where(common, pick(2), np.bincount(which, p_word, minlength=own.size)))
        gains = Known(joint, np.log10(kept / follows[which]) - np.log10(p_word) - log_alpha[which])
        del history, joint, n, c, kept, p_word, which
        own, log_alpha = own[~common], log_alpha[~common]
        for p, lo, hi in _spans(_part(own, parts)):
            yield _row(p, BACKOFFS, _deltas(own[lo:hi]), _planes(log_alpha[lo:hi]))
    for chunk, sums in _applied(gains, np.zeros(1), chunks, True):
        yield _row(0, chunk, None, *sums)


def _sums(docs: np.ndarray, score: np.ndarray, base: np.ndarray | None, hits: np.ndarray | None) -> list[bytes]:
    """Packed sums per document: the documents, score, base, hits."""
    touched = np.unique(docs)
    total = lambda x: np.bincount(docs, x, minlength=int(touched[-1]) + 1)[touched] if touched.size else np.zeros(0)
    none = np.zeros(0)
    # documents by their differences, which are mostly one
    return [_planes(np.diff(touched, prepend=0).astype(np.uint16)), _planes(total(score)), _planes(total(base) if base is not None else none), _planes((total(hits.astype(float)) if hits is not None else none).astype(np.uint32))]


def _send_scoring(batches: Iterator[pa.RecordBatch], parts: int, hot: Known, often: Known | None = None) -> Iterator[pa.RecordBatch]:
    """The tokens of all text by word, or with `often` by bigram to where its history's bigrams are priced, with the document of each; hot keys come as
    sums.  hot has the base's log, log P and log alpha of a word, or the gain of a bigram."""
    bigrams = often is not None
    for chunk in _chunks(batches):
        keys = _joint(chunk.history, chunk.words) if bigrams else chunk.words
        at, there = hot.find(keys)
        if there.any():
            values, docs = hot.values[at[there]], chunk.docs[there].astype(np.int64)
            sums = _sums(docs, values, None, None) if bigrams else _sums(docs, values[:, 1] + values[:, 2], values[:, 0], np.ones(docs.size))
            yield _row(chunk.name % parts, chunk.name, None, *sums)
        keys, docs, history = keys[~there], chunk.docs[~there], chunk.history[~there]
        where = _dealt(history, keys, often, parts) if bigrams else _part(keys, parts)
        order = np.lexsort((keys, where)) if bigrams else np.argsort(keys, kind="stable")
        at = _distinct(keys[order])  # equal keys go to one partition
        times, own, bounds = np.diff(np.append(at, keys.size)).astype(np.uint32), keys[order[at]], np.append(at, keys.size)
        for p, lo, hi in _spans(where[order[at]]):
            yield _row(p, chunk.name, _deltas(own[lo:hi]), _planes(times[lo:hi]), _planes(docs[order[bounds[lo] : bounds[hi]]]))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their counts, and a place of each in the concatenated keys."""
    if not keys or not sum(k.size for k in keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(all_keys, kind="stable")
    at = _distinct(all_keys[order])
    return all_keys[order[at]], np.add.reduceat(all_counts[order], at), order[at]


def _word_values(words: np.ndarray, n: np.ndarray, alpha: np.ndarray, d1: list[float], total: int, types: int) -> np.ndarray:
    """The base's log, log P and log alpha of words with their counts."""
    return np.stack([np.log10((n + 0.5) / (total + 0.5 * (types + 1))), np.log10(_off(n, d1) / total), alpha], axis=1)


def _applied(known: Known, missing: np.ndarray, chunks: list[dict], bigrams: bool) -> Iterator[tuple[int, list[bytes]]]:
    """Each row of a chunk with its sums per document: its keys' values, `missing` for those without one.  Rows of sums pass as they are."""
    value = np.concatenate((known.values, missing))
    for row in chunks:
        out = [row[k] for k in "bcde"]
        if row["a"] is not None:
            at, there = known.find(_undelta(row["a"]))
            each = np.repeat(np.where(there, at, known.keys.size), _unplane(row["b"], np.uint32))
            docs = _unplane(row["c"], np.uint16).astype(np.int64)
            if bigrams:  # most bigrams of unseen text have no gain
                docs, each = docs[each < known.keys.size], each[each < known.keys.size]
            out = _sums(docs, value[each], None, None) if bigrams else _sums(docs, value[each, 1] + value[each, 2], value[each, 0], each < known.keys.size)
        yield row["chunk"], out


def _apply_words(batches: Iterator[pa.RecordBatch], words: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], unseen: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Sums per chunk and document of a partition's words; `words` makes their values of the tables, and `unseen` has base and log P of a word
    without a row."""
    tables, chunks = _gather(batches)
    counts, backoffs = _table(tables.get(WORDS, []), np.uint64), _table(tables.get(BACKOFFS, []), np.float64)
    at, there = backoffs.find(counts.keys)
    alpha = np.where(there, backoffs.values[at], 0.0) if backoffs.keys.size else np.zeros(counts.keys.size)
    known = Known(counts.keys, words(counts.keys, counts.values.astype(np.int64), alpha)) if counts.keys.size else Known(counts.keys, np.zeros((0, 3)))
    for chunk, sums in _applied(known, np.array([[unseen[0], unseen[1], 0.0]]), chunks, False):
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.array([x], pa.binary()) for x in sums]], ["chunk", "docs", "score", "base", "hits"])


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _chunks(batches):
        out = [pa.array([c.name], pa.int64()), pa.array([c.ids], pa.list_(pa.int64())), pa.array([c.trains.tolist()]), pa.array([c.lengths.tolist()])]
        yield pa.RecordBatch.from_arrays(out, ["chunk", "ids", "trains", "lengths"])


def _total(table: pa.Table) -> pa.Table:
    """All partial sums of one chunk, and its documents, to a row for each document."""
    sums = table.filter(pa.compute.is_valid(table["docs"])).to_pylist()
    about = table.filter(pa.compute.is_valid(table["ids"])).to_pylist()
    if len(about) != 1:
        raise RuntimeError("the documents were read in different chunks by different passes")
    n = len(about[0]["ids"])
    score, base, hits = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for row in sums:
        at = np.cumsum(_unplane(row["docs"], np.uint16), dtype=np.int64)
        score[at] += _unplane(row["score"], np.float64)
        if row["base"]:
            base[at] += _unplane(row["base"], np.float64)
            hits[at] += _unplane(row["hits"], np.uint32)
    held = ~np.array(about[0]["trains"], bool)
    columns = [pa.array(about[0]["ids"], pa.int64()), pa.array(held), pa.array(about[0]["lengths"], pa.int64()), pa.array(hits), pa.array(base), pa.array(score)]
    return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def discounts(counts: dict[int, int]) -> list[float]:
    """d(r) for r = 0 to GOOD_TURING: r* / r with r* = (r + 1) n(r + 1) / n(r) where that lies in (0, 1), else (r - 0.5) / r."""
    out = [0.0]
    for r in range(1, GOOD_TURING + 1):
        star = (r + 1) * counts.get(r + 1, 0) / counts[r] / r if counts.get(r) else 0.0
        out.append(star if 0 < star < 1 else (r - 0.5) / r)
    return out


def _discounted(n: Column, d: list[float]) -> Column:
    """_off() as a column."""
    return F.when(n <= GOOD_TURING, F.element_at(F.array(*[F.lit(x) for x in d]), (n + 1).cast("int")) * n).otherwise(n - 0.5)


@contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete a query's shuffle files when the query ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score(docs: DataFrame, trains: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    trains tells which rows the model learns from; by default those whose crc32 of the id as text leaves another remainder by 5
    than 1 (a null id counts as the empty text).  A null text is empty: its one token is the end.  n_known counts tokens seen in training.
    The base is an add-half unigram model.  Nothing to learn from: only the unseen class has probability, and score is 0.  Repeated
    rows give repeated rows, each counted; other columns are ignored.  docs is read several times and has to come in the same order
    each time, as a written table does; where it doesn't, this raises.
    """
    spark = docs.sparkSession
    with _files_cleaned(spark):
        return _score(spark, docs, trains, text, doc_id)


def _score(spark: SparkSession, docs: DataFrame, trains: Column | None, text: str, doc_id: str) -> DataFrame:
    id_ = F.col(doc_id).cast("long")
    learn = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 != 1 if trains is None else F.coalesce(trains, F.lit(False))
    given = docs.select(id_.alias("doc_id"), learn.alias("trains"), F.concat(text_of(text), F.lit(" ")).alias("body"))
    meta = stash(given.mapInArrow(_meta, "chunk long, ids array<long>, trains array<boolean>, lengths array<long>"), "documents")
    tokens = meta.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    most = HOT
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(tokens) // PART_TOKENS))

    def packed(rows: DataFrame, f: Callable) -> DataFrame:
        return rows.mapInArrow(f, _ROW)

    def deal(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
        return rows.repartitionById(parts, "p").mapInArrow(f, schema)

    found = stash(deal(packed(given, lambda b: _send_words(b, parts)), _count_words, "p int, word long, n long"), "words")
    small = {r["word"]: r["n"] for r in found.where("p < 0").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each small count
    unigrams, d1 = found.where("p >= 0"), discounts(small)
    end = F.col("word") == int(END.view(np.int64))
    total, types, ends, mass = unigrams.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(end, F.col("n"))), F.sum(_discounted(F.col("n"), d1))).first()
    total, types, ends = int(total or 0), int(types or 0), int(ends or 0)
    spare = 1.0 - float(mass) / total if total else 1.0
    unseen = (math.log10(0.5 / (total + 0.5 * (types + 1))), math.log10(spare))
    # no more than `parts` words have a partition's share of the tokens, and no more than `most` one in so many of them
    hot_rows = unigrams.where(F.col("n") * max(most, parts) >= total).select("word", "n").collect()
    hot_words = Known(np.array([r["word"] for r in hot_rows], np.int64).view(np.uint64), np.array([r["n"] for r in hot_rows], np.uint64))
    share = hot_words.values.astype(float) * parts >= total
    often = Known(hot_words.keys[share], hot_words.values[share])
    table = packed(unigrams.select("p", "word", "n"), _words_out)

    pairs = packed(given, lambda b: _send_pairs(b, parts, often)).unionByName(table)
    entries = stash(deal(pairs, lambda b: _count_pairs(b, often), "kind int, history long, word long, n long, c long"), "entries")
    few = {r["word"]: r["n"] for r in entries.where("kind = 1").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row for each small count
    d2, entries = discounts(few), entries.where("kind = 0").drop("kind")
    # histories that stand too often for one partition, the start, which is followed as often as texts end, and those of hot words
    follows = {int(k): int(n) for k, n in zip(hot_words.keys.view(np.int64), hot_words.values) if k != END} | {int(BOS.view(np.int64)): ends}
    listed = F.broadcast(spark.createDataFrame([(h,) for h in follows], "history long"))
    p_word = _discounted(F.col("c"), d1) / max(total, 1)
    sums = entries.join(listed, "history").groupBy("history").agg(F.sum(_discounted(F.col("n"), d2)).alias("kept"), F.sum(p_word).alias("covered")).toArrow()  # a row for each of those
    heavy = sums["history"].to_numpy()
    facts = np.stack([np.array([follows[int(h)] for h in heavy], float), sums["kept"].to_numpy(), sums["covered"].to_numpy()], axis=1)
    alphas = Known(heavy.view(np.uint64), _log_alpha(facts[:, 0], facts[:, 1], facts[:, 2]))
    many = (facts[:, 0] * parts >= total) | (heavy == BOS.view(np.int64))
    common = Known(heavy[many].view(np.uint64), facts[many])

    # bigrams with one in `most` of all tokens; their histories stand at least as often
    top = entries.where(F.col("n") * most >= total).toArrow()
    history, word, n, c = (top[k].to_numpy().view(np.uint64) for k in ("history", "word", "n", "c"))
    at, there = alphas.find(history)
    hot_follows = np.array([follows[int(h)] for h in history.view(np.int64)], float)
    hot_gain = np.log10(_off(n, d2) / hot_follows) - np.log10(_off(c, d1) / total) - alphas.values[at] if history.size else np.zeros(0)
    hot_pairs = Known(_joint(history, word), hot_gain)
    at, there = alphas.find(np.array([BOS]))
    start = float(alphas.values[at[0]]) if there[0] else 0.0

    # tokens go to where the bigrams of their history are priced: gains are never written or sent.  They come first in the union, as chunks
    # are named by their partition
    dealt = packed(given, lambda b: _send_scoring(b, parts, hot_pairs, common))
    dealt = dealt.unionByName(packed(entries.select("history", "word", "n", "c"), lambda b: _send_entries(b, parts, common))).unionByName(table)
    priced = stash(deal(dealt, lambda b: _score_pairs(b, parts, d1, d2, total, common), _ROW), "pair-sums")
    drop_stash(entries)
    sparse = "chunk long, docs binary, score binary, base binary, hits binary"
    by_pairs = priced.where("chunk >= 0").select("chunk", *[F.col(a).alias(b) for a, b in zip("bcde", ("docs", "score", "base", "hits"))])

    def values(words: np.ndarray, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        return _word_values(words, n, alpha, d1, total, types)

    at, there = alphas.find(hot_words.keys)
    hot_alpha = np.where(there, alphas.values[at], 0.0) if alphas.keys.size else np.zeros(hot_words.keys.size)
    hot = Known(hot_words.keys, values(hot_words.keys, hot_words.values.astype(np.int64), hot_alpha) if total else np.zeros((0, 3)))
    tokens_by_word = packed(given, lambda b: _send_scoring(b, parts, hot)).unionByName(table).unionByName(priced.where(F.col("chunk") == BACKOFFS))
    by_words = stash(deal(tokens_by_word, lambda b: _apply_words(b, values, unseen), sparse), "word-sums")

    none = [F.lit(None).cast(t).alias(n) for n, t in (("ids", "array<long>"), ("trains", "array<boolean>"), ("lengths", "array<long>"))]
    nothing = [F.lit(None).cast("binary").alias(n) for n in ("docs", "score", "base", "hits")]
    parts_ = by_pairs.unionByName(by_words).select("*", *none).unionByName(meta.select("chunk", *nothing, "ids", "trains", "lengths"))
    scored = parts_.groupBy("chunk").applyInArrow(_total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + start).alias("score"))
