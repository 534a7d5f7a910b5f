"""Hard negatives by a vector-approximation file.

Every dimension is cut into CELLS cells, and a row's approximation is the cell of each of its components, a byte each.  For a block of
anchors and a part of the rows, tables of the cells' middles and half widths give a lower and an upper bound of every score; only rows
whose bounds leave them a place among the wanted ones are scored exactly.  Two such searches follow one another: an anchor's positives
among the rows of its label, then the negatives in the window that each positive's score opens.

Rows meet anchors in blocks: a row goes to each block of anchors once, an anchor to each part of the rows, and both sides' blocks are
bounded in rows.  Each part keeps its foremost few, which are ranked again over all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stash

#: Cells of a dimension: an approximation has a byte for each.
CELLS = 256
#: Numbers in a block of anchors and in a part of the rows, and in one step's matrix of bounds.  They bound memory, not results.
ANCHOR_NUMBERS, ROW_NUMBERS, STEP = 1 << 21, 1 << 22, 1 << 20
#: Rows of a part at least, where there are enough tasks already.
LEAST_ROWS = 2048
#: Rows up to which the table of labels is broadcast; beyond it Spark joins by shuffle.
FEW = 20_000
#: Up to here a double holds integers exactly, and so 0.5 below it.
EXACT = 2**52


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def quantised(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and vec (floor(256 * x) of each component), of rows in which nothing is null or not finite."""
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    out = out.where("vec_id is not null and label is not null and x is not null").where(F.forall("x", _finite))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return out.select("vec_id", moved.alias("label"), F.transform("x", lambda x: F.floor(256 * x)).alias("vec"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as float64 rows; shorter ones end in zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy().astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec) to (dim, low, high): the range of each dimension over a task's rows."""
    low = high = np.zeros(0, np.int64)
    for batch in batches:
        column = batch.column(0)
        lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
        if not len(flat):
            continue
        dims = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        more = max(0, int(lengths.max()) - len(low))
        low, high = np.pad(low, (0, more), constant_values=2**63 - 1), np.pad(high, (0, more), constant_values=-(2**63))
        np.minimum.at(low, dims, flat)
        np.maximum.at(high, dims, flat)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["dim", "low", "high"])


class Cells:
    """The cells of all dimensions: equal widths between a dimension's least and greatest component, and zero, which ends short vectors."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = np.minimum(low, 0).astype(np.float64)
        self.width = np.maximum(1, -(-(np.maximum(high, 0) - np.minimum(low, 0) + 1) // CELLS)).astype(np.float64)
        first = self.low[:, None] + self.width[:, None] * np.arange(CELLS)
        #: The middle of each cell's integers, and how far they reach from it.
        self.middle, self.reach = first + (self.width[:, None] - 1) / 2, np.broadcast_to((self.width[:, None] - 1) / 2, first.shape)
        most = np.maximum(np.abs(low), np.abs(high)).astype(object) + self.width.astype(object)
        self.most = int((most * most).sum()) if len(most) else 0
        #: What rounding can add to a bound: nothing where all sums are exact.
        self.slack = 0.0 if self.most < EXACT else (len(low) + 4) * 2.0**-52 * self.most

    def of(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.low) // self.width).astype(np.uint8)

    def bounds(self, anchors: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the first anchor, lower bounds, upper bounds) for some anchors at a time, anchors by rows."""
        dims = np.arange(len(self.low))
        middle, reach = self.middle[dims, cells].T, self.reach[dims, cells].T  # the look-up, once for each row
        step = max(1, STEP // max(1, len(cells)))
        for lo in range(0, len(anchors), step):
            some = anchors[lo : lo + step]
            score, off = some @ middle, np.abs(some) @ reach + self.slack
            yield lo, score - off, score + off


def _exact(rows: np.ndarray, anchor: np.ndarray, cells: Cells) -> np.ndarray:
    if cells.most < EXACT:
        return (rows @ anchor).astype(np.int64)
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def _foremost(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _positives(cells: Cells, count: int, key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The `count` best rows of a part for each anchor of a block, both of one label."""
    a, b = _matrix(anchors["vec"], len(cells.low)), _matrix(rows["vec"], len(cells.low))
    a_key, b_key = anchors["rid"].to_numpy(), rows["rid"].to_numpy()
    a_id, b_id = anchors["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    out = []
    for lo, lower, upper in cells.bounds(a, cells.of(b)):
        for i in range(len(lower)):
            low = lower[i]
            others = b_key != a_key[lo + i]
            known = low[others]
            least = np.partition(known, len(known) - count)[len(known) - count] if len(known) > count else -np.inf
            maybe = np.flatnonzero(others & (upper[i] >= least))
            scores = _exact(b[maybe], a[lo + i], cells)
            best = _foremost(scores, b_id[maybe], count)
            out.append((np.full(len(best), a_key[lo + i]), np.full(len(best), a_id[lo + i]), b_key[maybe[best]], b_id[maybe[best]], scores[best]))
    return _table(out, ["anchor", "anchor_id", "positive", "positive_id", "positive_score"])


def _table(out: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def window(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """The least and greatest integer s with low * score <= 100 * s <= high * score."""
    return -(-percent[0] * score // 100), percent[1] * score // 100


def _negatives(cells: Cells, count: int, percent: tuple[int, int], key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """For each anchor of a block and each of its positives, the `count` best rows of a part in the positive's window."""
    a, b = _matrix(anchors["vec"], len(cells.low)), _matrix(rows["vec"], len(cells.low))
    a_key, a_label, a_id = anchors["rid"].to_numpy(), anchors["label"].to_numpy(), anchors["vec_id"].to_numpy()
    b_label, b_id = rows["label"].to_numpy(), rows["vec_id"].to_numpy()
    asked = [[(p["positive"], p["positive_id"], p["positive_score"], *window(p["positive_score"], percent)) for p in own] for own in anchors["positives"].to_pylist()]
    asked = [[w for w in own if w[3] <= w[4]] for own in asked]
    floor = np.array([min((w[3] for w in own), default=np.inf) for own in asked], float)
    ceiling = np.array([max((w[4] for w in own), default=-np.inf) for own in asked], float)
    out = []
    for lo, lower, upper in cells.bounds(a, cells.of(b)):
        some = slice(lo, lo + len(lower))
        # what may lie in any window of the anchor
        reached = (upper >= floor[some, None]) & (lower <= ceiling[some, None]) & (b_label[None, :] != a_label[some, None])
        for i in np.flatnonzero(reached.any(axis=1)):
            there = np.flatnonzero(reached[i])
            low, high, own = lower[i, there], upper[i, there], asked[lo + i]
            maybe = np.zeros(len(there), bool)
            for *_, first, last in own:
                sure = low[(low >= first) & (high <= last)]
                least = np.partition(sure, len(sure) - count)[len(sure) - count] if len(sure) >= count else first
                maybe |= (high >= max(least, first)) & (low <= last)
            there = there[maybe]
            scores = _exact(b[there], a[lo + i], cells)
            for key_, id_, score, first, last in own:
                inside = np.flatnonzero((scores >= first) & (scores <= last))
                best = inside[_foremost(scores[inside], b_id[there[inside]], count)]
                n = len(best)
                out.append((np.full(n, a_key[lo + i]), np.full(n, a_id[lo + i]), np.full(n, key_), np.full(n, id_), np.full(n, score), b_id[there[best]], scores[best]))
    return _table(out, ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"])


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to `negatives` rows for each anchor and positive.

    Components become floor(256 * x); the label of a row whose vec_id is divisible by 7 becomes (label + 1) % 10.  Anchors are rows whose
    vec_id is divisible by `every`.  A score is the integer inner product with the anchor; higher ones come first, then smaller
    vec_ids.  An anchor's positives are its first `positives` other rows of the same label; a positive's negatives are the first rows
    of different labels whose score lies between percent[0] and percent[1] hundredths of the positive's, both included.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part.  Vectors shorter than the longest
    count as ending in zeros.  A repeated row is a row of its own: it may be another's positive, and as an anchor gives its rows again.
    Anchors without positives, and positives without negatives, give no row; neither does an empty table.  ValueError where 95 scores
    together wouldn't fit 63 bits.  Other columns are not read.
    """
    if every < 1 or positives < 1 or negatives < 1 or not 0 <= percent[0] <= percent[1] <= 100:
        raise ValueError("every, positives and negatives must be positive, and percent rise within 0..100")
    known = stash(quantised(rows, vec_id, vector, label).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # a row for each dimension
    ranges = known.select("vec").mapInArrow(_ranges, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    cells = Cells(np.array([r["low"] for r in ranges], np.int64), np.array([r["high"] for r in ranges], np.int64))
    dims = max(1, len(ranges))
    if 100 * cells.most >= 2**63:
        raise ValueError("components are too large: scores would not fit a long")
    kind = "smallint" if cells.most < 2**28 else "bigint"
    known = known.withColumn("vec", F.col("vec").cast(f"array<{kind}>"))

    is_anchor = F.col("vec_id") % every == 0
    spark = rows.sparkSession
    total, all_anchors = known.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    part_rows = max(1, min(ROW_NUMBERS // dims, max(LEAST_ROWS, total // (4 * spark.sparkContext.defaultParallelism))))
    block_rows = max(1, ANCHOR_NUMBERS // dims)
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    labels = known.groupBy("label").agg(cut(F.count(F.lit(1)), part_rows).alias("parts"), cut(F.count(F.when(is_anchor, 1)), block_rows).alias("blocks"))
    if labels.count() <= FEW:
        labels = F.broadcast(labels)
    spread = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    met = known.join(labels, "label")
    left = met.where(is_anchor).select("label", spread(F.col("blocks"), 1).alias("block"), each(F.col("parts")).alias("part"), "rid", "vec_id", "vec")
    right = met.select("label", each(F.col("blocks")).alias("block"), spread(F.col("parts"), 2).alias("part"), "rid", "vec_id", "vec")
    keys = ["label", "block", "part"]
    left = left.toDF(*left.columns)  # of attributes of its own: both sides come from one table
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda key, a, b: _positives(cells, positives, key, a, b), "anchor long, anchor_id long, positive long, positive_id long, positive_score long"
    )
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive"))
    found = found.withColumn("place", place).where(F.col("place") <= positives)
    windows = found.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))  # `positives` of them at most
    anchors = stash(known.where(is_anchor).join(windows, F.col("rid") == F.col("anchor")).select("rid", "vec_id", "label", "vec", "positives"), "anchors")

    parts, blocks = max(1, -(-total // part_rows)), max(1, -(-all_anchors // block_rows))
    left = anchors.select(spread(F.lit(blocks), 3).alias("block"), each(F.lit(parts)).alias("part"), "rid", "vec_id", "label", "vec", "positives")
    right = known.select(each(F.lit(blocks)).alias("block"), spread(F.lit(parts), 4).alias("part"), "vec_id", "label", "vec")
    out = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        lambda key, a, b: _negatives(cells, negatives, percent, key, a, b),
        "anchor long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
