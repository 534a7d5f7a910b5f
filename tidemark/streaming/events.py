"""A log of what streams do: a row for each start, progress, restart and end, told by Spark to a listener."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "ts double, event string, query string, run string, batch long, rows long, error string"


class StreamLog(StreamingQueryListener):
    """Writes a JSON line for each event of the session's streams to a folder that Spark can reach.

    start: a stream runs for the first time; reconnect: it runs again from its checkpoint; progress: a micro-batch is done, with its number and rows read;
    complete: it ended; failed: it ended by an error.  A restart is told by the stream's id, which its checkpoint keeps.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._known = spark, folder.rstrip("/"), set()
        if self._there().exists(self._path("")):
            self._known = {r["query"] for r in read_log(spark, folder).select("query").distinct().collect()}  # a row for each stream

    def _path(self, name: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def _there(self):
        return self._path("").getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _write(self, event: str, query: object, run: object, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        line = json.dumps({"ts": time.time(), "event": event, "query": str(query), "run": str(run), "batch": batch, "rows": rows, "error": error}) + "\n"
        out = self._there().create(self._path(f"{time.time_ns()}-{uuid.uuid4().hex}.json"))
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._write("reconnect" if str(event.id) in self._known else "start", event.id, event.runId)
        self._known.add(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._write("progress", p.id, p.runId, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._write("failed" if event.exception else "complete", event.id, event.runId, error=event.exception)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)


def ended(spark: SparkSession, folder: str, runs: int, seconds: float = 60.0) -> DataFrame:
    """The log, once it tells of the end of `runs` runs: listeners hear of things a little later."""
    until = time.time() + seconds
    while True:
        log = read_log(spark, folder)
        if log.where("event in ('complete', 'failed')").count() >= runs or time.time() > until:
            return log
        time.sleep(0.2)
