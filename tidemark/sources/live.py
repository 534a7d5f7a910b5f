"""Recorded feeds as tables: messages to rows, duplicate trades, level-2 books, bounds of a capture."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ladder import ladders

_MATCH = "type string, trade_id long, side string, size string, price string, product_id string, time string"
_TICKER = "type string, product_id string, best_bid string, best_bid_size string, best_ask string, best_ask_size string, time string"


def iso_to_ns(text: Column) -> Column:
    """Nanoseconds of an ISO 8601 time, exact to its microseconds."""
    return F.unix_micros(F.to_timestamp(text)) * 1000


def match_to_tick(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trades of a feed, with the side as the message has it.  Other messages fall out."""
    m = lines.select(F.from_json(column, _MATCH).alias("m")).where(F.col("m.type").isin("match", "last_match")).select("m.*")
    return m.select(iso_to_ns(F.col("time")).alias("ts_ns"), F.col("product_id").alias("product"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), "side", "trade_id")


def ticker_to_quote(lines: DataFrame, column: str = "value") -> DataFrame:
    """Best bid and ask of a feed; messages without a bid fall out."""
    m = lines.select(F.from_json(column, _TICKER).alias("m")).where("m.type = 'ticker' and m.best_bid is not null").select("m.*")
    number = lambda c: F.col(c).cast("double")
    return m.select(
        iso_to_ns(F.col("time")).alias("ts_ns"), F.col("product_id").alias("product"), number("best_bid").alias("bid"), number("best_bid_size").alias("bid_size"),
        number("best_ask").alias("ask"), number("best_ask_size").alias("ask_size"),
    )


#: Rows of a block and length of a stretch: what is ordered in one task.
BLOCK, STRETCH_NS = 1_000_000, 3_600_000_000_000


def drop_replayed(ticks: DataFrame) -> DataFrame:
    """Trades whose id is above all before them in arrival order (`seq`), per product: a reconnect replays old ones.

    Ordered within blocks of seq; between blocks only each block's greatest id is carried.
    """
    rows = ticks.withColumn("block_", F.floor(F.col("seq") / BLOCK))
    tops = rows.groupBy("product", "block_").agg(F.max("trade_id").alias("top_"))
    earlier = Window.partitionBy("product").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("product", "block_", F.max("top_").over(earlier).alias("before_"))
    inside = Window.partitionBy("product", "block_").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(tops, ["product", "block_"]).withColumn("last_", F.greatest("before_", F.max("trade_id").over(inside)))
    return met.where("last_ is null or trade_id > last_").select(*ticks.columns)


_BOOK = "ts_ns long, product string, side string, level long, price double, size double"
#: Rows that a stretch is folded from, in this order at one time: what it takes over, its updates, the times asked for.
_TAKEN_OVER, _UPDATE, _ASKED = 0, 1, 2


def _fold_stretch(levels: int, rows: pa.Table) -> pa.Table:
    """The top levels at the times asked for in a stretch of one product."""
    rows = rows.sort_by([("kind_first", "ascending"), ("ts_ns", "ascending"), ("kind", "ascending"), ("seq", "ascending")])
    book, out, product = ladders(), [], rows["product"][0].as_py()
    for kind, ts, side, price, size in zip(*(rows[c].to_pylist() for c in ("kind", "ts_ns", "side", "price", "size"))):
        if kind == _ASKED:
            out += [(ts, product, s, i, p, z) for s in ("bid", "ask") for i, (p, z) in enumerate(book[s].top(levels))]
        else:
            book[side].put(price, size)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [c.split() for c in _BOOK.split(", ")]
    return pa.table([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def l2_levels(updates: DataFrame, at: DataFrame, levels: int = 10) -> DataFrame:
    """Top levels of a book at given times: updates (product, seq, ts_ns, side bid/ask, price, size; size 0 removes) folded up to each of `at`.

    at has product and ts_ns; times may repeat.  seq rises with ts_ns.  Returns book rows: ts_ns, product, side, level, price, size; a
    product without levels at a time has no row there.

    A stretch of time is folded by itself, from the levels that stand when it begins: the last size of each in the stretches before.  So what is
    moved are the updates and, for each stretch that is asked about, the levels that it takes over; no snapshot copies a book.
    """
    stretch = F.expr(f"ts_ns div {STRETCH_NS}").alias("stretch")
    asked = at.select("product", "ts_ns", stretch).distinct()
    feed = updates.select("product", "ts_ns", stretch, "seq", "side", F.col("price").cast("double"), F.col("size").cast("double"))

    # stretches in order, and how many of those asked about come up to each
    wanted = asked.select("product", "stretch").distinct().withColumn("is_asked", F.lit(1))
    known = feed.select("product", "stretch").distinct().join(wanted, ["product", "stretch"], "full")
    w = Window.partitionBy("product").orderBy("stretch")
    place = F.sum(F.coalesce("is_asked", F.lit(0))).over(w)
    known = known.withColumn("place", place).withColumn("places", F.max("place").over(Window.partitionBy("product")))

    # a level's last size in a stretch stands from the next stretch on, up to the one that touches the level again
    ends = feed.groupBy("product", "side", "price", "stretch").agg(F.max_by("size", "seq").alias("size")).join(known, ["product", "stretch"])
    again = F.lead("place").over(Window.partitionBy("product", "side", "price").orderBy("stretch"))
    held = ends.withColumn("until", F.coalesce(again, "places")).where("size > 0 and until > place")
    held = held.select("product", "side", "price", "size", F.explode(F.sequence(F.col("place") + 1, "until")).alias("place"))
    starts = known.where("is_asked = 1").select("product", "stretch", "place")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    columns = ["product", "stretch", "kind", "kind_first", "ts_ns", "seq", "side", "price", "size"]
    kind = lambda k: [F.lit(k).alias("kind"), F.lit(min(k, _UPDATE)).alias("kind_first")]
    rows = held.join(starts, ["product", "place"]).select("product", "stretch", *kind(_TAKEN_OVER), none("ts_ns", "long"), none("seq", "long"), "side", "price", "size").select(columns)
    rows = rows.unionByName(feed.join(wanted, ["product", "stretch"], "left_semi").select("*", *kind(_UPDATE)).select(columns))
    rows = rows.unionByName(asked.select("*", *kind(_ASKED), none("seq", "long"), none("side", "string"), none("price", "double"), none("size", "double")).select(columns))
    return rows.groupBy("product", "stretch").applyInArrow(lambda table: _fold_stretch(levels, table), _BOOK)


def bound_capture(rows: DataFrame, count: int | None = None, seconds: float | None = None) -> DataFrame:
    """The first rows of each product, by count and/or exchange time; the first record at or past the end isn't taken."""
    if count is None and seconds is None:
        raise ValueError("a capture needs a count, a number of seconds, or both")
    out = rows
    if seconds is not None:
        first = rows.groupBy("product").agg(F.min_by("ts_ns", "seq").alias("first_"))
        past = F.when(F.col("ts_ns") >= F.col("first_") + int(seconds * 1e9), F.col("seq"))
        stop = rows.select("product", "seq", "ts_ns").join(F.broadcast(first), "product").groupBy("product").agg(F.min(past).alias("stop_"))  # a row per product
        out = out.join(F.broadcast(stop), "product").where("stop_ is null or seq < stop_")
    if count is not None:  # Spark keeps the first rows of each task before it deals them
        out = out.withColumn("place_", F.row_number().over(Window.partitionBy("product").orderBy("seq"))).where(F.col("place_") <= count)
    return out.select(*rows.columns)
