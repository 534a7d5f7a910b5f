"""How streams with state are started and run to their end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import new_path

_STORE, _BATCH = "spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, chunk_rows: int | None = None) -> Iterator[None]:
    """Settings under which a stream is started, which keeps them: state in RocksDB, and Arrow batches of chunk_rows at most.  The
    session has its own again afterwards."""
    wanted = {_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({_BATCH: str(chunk_rows)} if chunk_rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_table(rows: DataFrame, chunk_rows: int | None = None, mode: str = "update") -> DataFrame:
    """What a stream gives until it has taken all that its source has, as a written table.  The table and the stream's own
    checkpoint are in the shared folder, so a lost executor costs a micro-batch, and a batch that is run again replaces its rows."""
    spark = rows.sparkSession
    out, mark = new_path(spark, "streamed"), new_path(spark, "stream")
    spark.createDataFrame([], rows.schema).write.parquet(f"{out}/batch=-1")  # a stream without rows has a table too
    with settings(spark, chunk_rows):
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
        query = query.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


def latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """Of an updated table, the newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
