"""What the operators of this subpackage share: written intermediate tables and safe columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Column names of our own beside a caller's columns.
K1, K2, COPY = "__tidemark_k1", "__tidemark_k2", "__tidemark_copy"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir, or the context's checkpoint folder.  Where neither is set, a folder of
    our own is set if all tasks run in this very process; on a cluster that is an error, as no folder here is shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it.

    This cuts the lineage: what reads the result never computes df again, so names and row keys
    made with monotonically_increasing_id() are fixed from here on, and a lost executor costs only
    the running stage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """df, a small table, in at most as many partitions as there are cores, whatever the number of shuffle partitions.

    Hadoop's local writer starts processes for every file, and until such a process runs its own program it counts with its executor's
    whole memory.  The stage that makes df keeps its tasks; adaptive execution joins small partitions and splits large ones.
    """
    return df.hint("rebalance", df.sparkSession.sparkContext.defaultParallelism)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stash(), or part of one, that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def refuse_reserved(docs: DataFrame) -> None:
    """ValueError where docs has a column named as one of our own."""
    taken = {c.lower() for c in docs.columns} & {K1, K2, COPY}
    if taken:
        raise ValueError(f"reserved column names: {sorted(taken)}")


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with 128 bits of a row's id and text as K1 and K2, the same whenever a row is read."""
    refuse_reserved(docs)
    id_, body = F.col(doc_id).cast("long"), text_of(text)
    return docs.select("*", F.xxhash64(id_, body).alias(K1), F.xxhash64(body, id_, F.lit(7)).alias(K2))


def drop_rows(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs, all columns, less the rows whose keys are in rows (k1, k2)."""
    gone = rows.select(F.col("k1").alias(K1), F.col("k2").alias(K2))
    return keyed(docs, text, doc_id).join(gone, [K1, K2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_rows_once(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row of docs, all columns, for each of rows' keys (k1, k2).  Of rows that repeat id and text it is the one that sorts first by
    the rest of its columns."""
    wanted = rows.select(F.col("k1").alias(K1), F.col("k2").alias(K2)).distinct()
    met = keyed(docs, text, doc_id).join(wanted, [K1, K2], "left_semi")
    return first_copies(met, docs.columns, text, doc_id)


def first_copies(rows: DataFrame, columns: list[str], text: str, doc_id: str) -> DataFrame:
    """Of rows that share K1 and K2, and with them id and text, the one whose other columns hash least (any, if those are equal too)."""
    rest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in columns if c not in (text, doc_id)], F.lit(0))
    order = Window.partitionBy(K1, K2).orderBy(COPY)
    first = rows.withColumn(COPY, rest).withColumn(COPY, F.row_number().over(order)).where(F.col(COPY) == 1)
    return first.select(*[F.col(f"`{c}`") for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def after_scheme(url: Column) -> Column:
    """What follows the first '://'; empty for null or where there is none."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    """The host at the start of after_scheme()'s result, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
