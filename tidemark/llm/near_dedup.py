"""MinHash near-deduplication.

1. One pass computes each document's set of word shingles (as 64-bit hashes) and from it the minima
   of HASHES universal hash functions, folded into band keys, and one mixed bit of each minimum.
2. Documents with equal sets form a class; only its representative goes on, so copies
   never meet as pairs.
3. In each bucket (representatives that share a band key) the members are paired with one hub only: the
   member that shares the most buckets with others, which is where near copies have their original.  Pairs whose sizes or
   signature bits rule the threshold out go; the rest are confirmed on the full shingle sets.  Confirmed links are joined to components.
4. Buckets whose members still lie in different components may hold links that the star missed.  Their members'
   shingles are ordered by rarity among them.  Sets with enough in common share one of their first shingles, so members of different
   components meet there (in blocks of BUCKET_BLOCK where many do), and unless sizes, signatures or the place of that
   shingle rule a link out, they are confirmed in the same way.  After that every pair that shares a bucket is in one
   component or known not to be a link, and no group is expanded into all pairs.
5. Components by alternating large-star and small-star.

What can be lost is a link whose documents share no bucket (with 32 bands of 4 rows at similarity 0.8: probability 5e-8) or whose
signature bits agree in too few places (under 1e-8); a link counts only if it joins components that nothing else joins.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, keep_rows_once, stash, text_of
from tidemark.llm.components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Of 128 bits, so many agree between documents at similarity 0.8 but with a probability under 1e-8 (mean 115, deviation 3.4).
BITS_AGREE = 92
#: Members that meet at a frequent shingle and are compared with each other at a time.
BUCKET_BLOCK = 256
#: Bytes of text turned into shingles at a time; a longer text is taken alone.
BYTES = 1 << 20
#: Null doc_ids are numbered from here, after all others.
NULL_IDS = 1 << 62

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    forth, back = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    forth[0] = back[0] = 1
    return np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of UTF-8 bytes starts, and its 64-bit hash with A-Z in lower case."""
    forth, back = _powers(max(20, int(data.size).bit_length()))
    gap = _SPACE[data]
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_LOWER[data] * forth[: data.size], out=sums[1:])
    return starts, _mix((sums[ends] - sums[starts]) * back[starts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; text i is data[offsets[i]:offsets[i + 1]] and ends in white space."""
    starts, hashes = word_hashes(data[: offsets[-1]])
    first = np.searchsorted(starts, offsets)
    fold = hashes[: max(0, hashes.size - words + 1)].copy()
    for k in range(1, words):
        fold = _mix(fold * _K1 + hashes[k : k + fold.size])
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= words:
            yield np.unique(fold[lo : hi - words + 1])
        elif hi == lo:
            yield hashes[:0]
        else:
            whole = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                whole = _mix(whole * _K2 + hashes[k : k + 1])
            yield whole


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1)[:, None], rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


#: One salt for each minimum, beside its 32 bits.
_SALTS = np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)


def signature_bits(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, from a mixed hash: its own low bit is the element's, but for a constant, so few elements make them agree or differ together."""
    return (_mix(least.astype(np.uint64) | _SALTS) >> np.uint64(63)).astype(np.uint8)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function a*x + b mod 2**32 over a set."""
    a, b = _functions()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, x.size, 4096):
        np.minimum(least, (a * x[lo : lo + 4096] + b).min(axis=1), out=least)
    return least


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a batch, their UTF-8 bytes and offsets, about BYTES at a time."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    salts = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        sizes, digests, bands, bits = [], [], [], []
        for _, _, data, offsets in _texts(batch, 2):
            for s in shingle_sets(data, offsets, words):
                sizes.append(s.size)
                # two independent sums of mixed elements: 128 bits of the set
                digests.append(np.array([_mix(s).sum(), _mix(s + _BASE).sum()], np.uint64).tobytes())
                least = minima(s)
                pairs = least.view(np.uint64).reshape(BANDS, ROWS // 2)
                bands.append(_mix(_mix(pairs[:, 0] + salts) + pairs[:, 1]).view(np.int64))
                bits.append(np.packbits(signature_bits(least)).view(np.int64))
        n = len(sizes)
        bits = np.concatenate(bits) if n else np.zeros(0, np.int64)
        band = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(np.concatenate(bands) if n else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), band, pa.array(bits[::2]), pa.array(bits[1::2])],
            ["k1", "k2", "node", "n", "digest", "bands", "b0", "b1"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in _texts(batch, 1):
            sets = list(shingle_sets(data, offsets, words))
            ends = np.cumsum([0, *(s.size for s in sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))],
                ["node", "shingles"],
            )


def row_keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """k1, k2 (128 bits of id and text), id and body; the same for a row whenever it is read."""
    id_, body = F.col(doc_id).cast("long"), text_of(text)
    return docs.select(F.xxhash64(id_, body).alias("k1"), F.xxhash64(body, id_, F.lit(7)).alias("k2"), id_.alias("id"), body.alias("body"))


def _sets_of(nodes: DataFrame, signed: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, from their texts: one shuffle of texts."""
    keys = signed.join(nodes, "node").select("k1", "k2", "node").distinct()
    texts = rows.join(keys, ["k1", "k2"]).select("node", F.concat("body", F.lit(" ")).alias("body"))
    return stash(texts.mapInArrow(lambda b: _sets(b, words), "node long, shingles array<long>"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", F.size("a").alias("m"), F.size("b").alias("n"), F.size(F.array_intersect("a", "b")).alias("common"))
    return stash(both.where(100 * F.col("common") >= percent * (F.col("m") + F.col("n") - F.col("common"))).select("u", "v").distinct(), "links")


def _alike(percent: int) -> str:
    """Signature verification as SQL on sizes and bits of two members l and r."""
    return (
        f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
        f" and bit_count(l.b0 ^ r.b0) + bit_count(l.b1 ^ r.b1) <= {HASHES - BITS_AGREE}"
    )


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the row's keys k1, k2.

    Words are maximal runs of characters other than space and U+0009..U+000D, A-Z in lower case.  A
    document's set has its distinct shingles of `words` words; a shorter one has its whole word
    sequence as one.  Documents are linked when 100 * common >= percent * together (percent from 80 up).  A text without
    words, or null, is linked with nothing.  component_id is the smallest doc_id reachable,
    kept whether it is the document's own.  Rows that share a doc_id count as one document and stay or go
    together.  Null doc_ids are documents of their own, after all others; a component that has
    only such has a null component_id and keeps one of them.  Other columns are ignored.  ValueError for less than 80 percent: the
    bands would lose links.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    rows = row_keys(docs, text, doc_id)
    given = rows.select("k1", "k2", F.concat("body", F.lit(" ")).alias("body"), F.coalesce("id", F.lit(NULL_IDS) + F.monotonically_increasing_id()).alias("node"))
    signed = stash(
        given.mapInArrow(lambda b: _sign(b, words), "k1 long, k2 long, node long, n long, digest binary, bands array<long>, b0 long, b1 long"), "signatures"
    )
    worded = signed.where("n > 0")
    classes = stash(worded.groupBy("digest").agg(F.min("node").alias("least")), "classes")
    heads = stash(
        worded.join(classes, "digest").where("node = least").select("k1", "k2", "node", "n", "b0", "b1", "bands").dropDuplicates(["node", "k1", "k2"]), "heads"
    )
    facts = heads.select("node", "n", "b0", "b1")
    members = heads.select("node", F.explode("bands").alias("band"))
    buckets = stash(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = stash(members.join(buckets, "band").select("band", "size", "node"), "shared")
    weights = stash(shared.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    hubs = shared.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("back"))).alias("top"))
    hubs = stash(hubs.select("band", (-F.col("top.back")).alias("hub")), "hubs")
    members = stash(shared.join(hubs, "band").select("band", "size", "hub", "node"), "members")
    for table in (buckets, shared, weights, hubs):
        drop_stash(table)
    stars = members.where("hub <> node").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    met = stars.alias("p").join(facts.alias("l"), F.expr("l.node = p.u")).join(facts.alias("r"), F.expr("r.node = p.v")).where(_alike(percent))
    stars = stash(met.select("p.u", "p.v").distinct(), "stars")
    ends = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct()
    sets = _sets_of(ends, heads, rows, words)
    links = _confirm(stars, sets, percent)
    drop_stash(sets)
    found = stash(components(links), "components")

    # members, but for the hub that is compared with all, of buckets that the links so far leave in parts
    rest = members.where("size > 2 and hub <> node").join(found, "node", "left").select("band", "size", "node", F.coalesce("component", "node").alias("component"))
    parted = rest.groupBy("band").agg((F.min("component") != F.max("component")).alias("parted")).where("parted").select("band")
    pool = stash(rest.join(parted, "band").select("node", "component").distinct(), "parted")
    sets = _sets_of(pool.select("node"), heads, rows, words)
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    places = stash(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("places")), "places")
    # a set's rarest shingles first: two sets with enough in common share one of these, early in both
    order = Window.partitionBy("node").orderBy("places", "shingle")
    early = each.join(places, "shingle").withColumn("rank", F.row_number().over(order) - 1).where("places > 1")
    early = early.join(pool, "node").join(facts, "node").where(f"100 * (n - rank) >= {percent} * n")
    blocks = F.ceil(F.col("places") / BUCKET_BLOCK)
    early = early.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    one = early.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    two = early.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "block")))
    met = one.alias("l").join(
        two.alias("r"), F.expr(
            f"l.shingle = r.shingle and l.i = r.i and l.j = r.j and l.component <> r.component and (l.i < l.j or l.node < r.node) and {_alike(percent)}"
            # no shingle before this one is common, so what follows it bounds what is
            f" and {100 + percent} * least(l.n - l.rank, r.n - r.rank) >= {percent} * (l.n + r.n)"
        )
    )
    more = stash(met.select(F.least("l.node", "r.node").alias("u"), F.greatest("l.node", "r.node").alias("v")).distinct(), "rest")
    if not more.isEmpty():
        further = _confirm(more, sets, percent)
        found = stash(components(links.unionByName(further)), "components")
    for table in (members, sets, pool, places, heads, stars, links, more):
        drop_stash(table)

    named = classes.join(found, classes["least"] == found["node"], "left").select("digest", F.coalesce("component", "least").alias("component"))
    out = signed.select("k1", "k2", "node", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    # a text without words has no class: it travels under a key of its own
    out = out.withColumn("key", F.coalesce("digest", F.col("node").cast("string").cast("binary"))).drop("digest")
    out = out.join(stash(named, "named").withColumnRenamed("digest", "key"), "key", "left").withColumn("component", F.coalesce("component", "node"))
    real = lambda c: F.when(F.col(c) < NULL_IDS, F.col(c))
    return out.select(
        real("node").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"), "k1", "k2"
    )


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that near_groups() keeps; rows that repeat id and text stay once (see keep_rows_once())."""
    kept = near_groups(docs, words, percent, text, doc_id).where("kept").select("k1", "k2")
    return keep_rows_once(docs, stash(kept, "kept"), text, doc_id)
