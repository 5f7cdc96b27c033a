"""Progress of streams as rows: started, every micro-batch, ended.

A ``ProgressLog`` listens to all streams of a session and appends a row for each
event to a JSON folder that readers poll (``follow``), as a job page does.  Rows
are small and as many as there are events; nothing is kept in the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "run_id string, name string, state string, batch_id long, rows long, rows_per_second double, seconds double, at string, error string"
ENDED = ("done", "failed")


class ProgressLog(StreamingQueryListener):
    """``with ProgressLog(spark, path):`` or ``spark.streams.addListener(log)``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.names: dict[str, str | None] = {}  # of running streams

    def _write(self, *row: object) -> None:
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        run = str(event.runId)
        self.names[run] = event.name
        self._write(run, event.name, "running", None, 0, None, None, event.timestamp, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = p.processedRowsPerSecond
        self._write(str(p.runId), p.name, "running", p.batchId, p.numInputRows, float(rate) if rate is not None else None, p.batchDuration / 1000, p.timestamp, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._write(run, self.names.pop(run, None), "failed" if event.exception else "done", None, 0, None, None, None, (event.exception or "")[:2000] or None)

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *exc: object) -> None:
        self.spark.streams.removeListener(self)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """All rows so far; none where nothing was written."""
    try:
        return spark.read.schema(PROGRESS).json(path)
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


def summary(progress: DataFrame) -> DataFrame:
    """One row per run: state, batches, rows, seconds, error.  An end outweighs
    all else; a batch reported twice counts once."""
    once = Window.partitionBy("run_id", "batch_id", "state").orderBy("at")
    p = progress.withColumn("_r", F.row_number().over(once)).filter("_r = 1 or batch_id is null")
    return p.groupBy("run_id").agg(
        F.max("name").alias("name"), F.coalesce(F.max(F.when(F.col("state").isin(*ENDED), F.col("state"))), F.lit("running")).alias("state"),
        F.count("batch_id").alias("batches"), F.sum("rows").alias("rows"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.max("error").alias("error"))


def follow(spark: SparkSession, path: str, run_id: str, ticks: int = 300, wait: float = 1.0) -> Iterator[dict]:
    """The summary of a run at every tick until it has ended, ``ticks`` times at most."""
    for _ in range(ticks):
        row = summary(read_progress(spark, path).filter(F.col("run_id") == run_id)).first()
        if row is not None:
            yield row.asDict()
            if row.state in ENDED:
                return
        time.sleep(wait)
