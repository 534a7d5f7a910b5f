"""A micro-batch's rows of a product in order of seq, without gathering them in a task.

Rows meet in blocks of a range of seq, each ordered in a task of its own and packed into one row; so a product's state sees a row for each
block, in order, and says what stands when the block begins.  Each block is then unpacked and folded, again in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import bucket_of

#: How far seq runs within a block: what is ordered and folded at once.
BLOCK = 200_000
_PACKED = "product string, block long, packed binary"


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def blocks(rows: DataFrame, describe: Callable[[pa.Table], tuple[pa.Table, dict]], described: str, order: list[str] = []) -> DataFrame:
    """product, block, packed and the columns `described`, a row per block: what describe() leaves of its rows, ordered by seq and, at one seq, with those first
    that have one of `order`, and what it says of them."""
    schema = f"{_PACKED}, {described}"
    columns = rows.columns

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(columns).sort_by([("seq", "ascending"), *[(c, "descending") for c in order]])
        left, said = describe(table)
        values = {"product": key[0].as_py(), "block": key[1].as_py(), "packed": packed(left), **said}
        return pa.Table.from_pylist([values], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return rows.withColumn("block_", bucket_of("seq", BLOCK)).groupBy("product", "block_").applyInArrow(one, schema)


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The blocks that a product's state is given, from the first one; a row for each block."""
    return pd.concat(list(rows)).sort_values("block").itertuples(index=False)


def unfolded(found: DataFrame, fold: Callable[[dict, pa.Table], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """What fold() makes of each block: of its row and of the rows packed in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from fold(row, unpacked(row.pop("packed")))

    return found.repartition(F.col("product"), F.col("block")).mapInArrow(run, schema)
