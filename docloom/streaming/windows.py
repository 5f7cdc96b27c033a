"""Event-time windows over a stream, with late rows on a side output.

Two steps, each a streaming query of its own:

1. ``split_late`` deals every micro-batch into rows on time (``ontime``) and rows
   older than the watermark (``late``), and writes the batch's latest time to
   ``clock``.  The watermark of a batch comes from the clocks of earlier batch
   ids, so a replayed batch deals its rows as before and overwrites its folders.
2. ``tumbling`` and ``sessions`` aggregate ``ontime``.  They see a part of the rows
   step 1 saw, so their own watermark is never ahead of it and drops nothing: a
   row is either in a window or in ``late``.

Rows without a time belong to no window and go to ``late``; an empty batch moves no
clock.  Both aggregates also take a batch DataFrame, over which they give all windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watermark(spark: SparkSession, root: str, delay: str, before: int | None = None) -> Column:
    """Latest time of the batches ``before`` an id (of all batches: None), less
    ``delay``; null where there is none."""
    try:
        clock = spark.read.parquet(f"{root}/clock")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return F.lit(None).cast("timestamp")
    latest = (clock if before is None else clock.filter(F.col("batch") < before)).agg(F.max("latest")).first()[0]  # one row
    return F.lit(latest).cast("timestamp") - F.expr(f"interval {delay}")


def split_late(events: DataFrame, root: str, delay: str, time_col: str = "ts") -> StreamingQuery:
    """Deals what is available of the stream ``events`` into ``ontime`` and ``late``
    under ``root``, one folder for each batch."""

    def deal(rows: DataFrame, batch_id: int) -> None:
        mark = watermark(rows.sparkSession, root, delay, batch_id)
        fresh = F.coalesce(F.col(time_col) >= F.coalesce(mark, F.col(time_col)), F.lit(False))
        rows.filter(fresh).write.mode("overwrite").parquet(f"{root}/ontime/batch={batch_id}")
        rows.filter(~fresh).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        rows.agg(F.max(time_col).alias("latest")).filter("latest is not null").write.mode("overwrite").parquet(f"{root}/clock/batch={batch_id}")

    return events.writeStream.foreachBatch(deal).option("checkpointLocation", f"{root}/_split").trigger(availableNow=True).start()


def on_time(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows on time, as a stream."""
    return spark.readStream.schema(schema).parquet(f"{root}/ontime/batch=*")


def late(spark: SparkSession, root: str) -> DataFrame:
    """The rows set aside, with the ``batch`` that met them."""
    return spark.read.parquet(f"{root}/late")


def _watched(events: DataFrame, time_col: str, delay: str) -> DataFrame:
    return events.withWatermark(time_col, delay) if events.isStreaming else events.filter(F.col(time_col).isNotNull())


def tumbling(events: DataFrame, width: str, keys: Sequence[str], aggs: Sequence[Column], delay: str, time_col: str = "ts", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggs) of windows of ``width``, overlapping
    where ``slide`` is shorter.  A hot key is combined before the shuffle."""
    w = _watched(events, time_col, delay).groupBy(F.window(time_col, width, slide).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in w.columns if c != "w"])


def sessions(events: DataFrame, gap: str, keys: Sequence[str], aggs: Sequence[Column], delay: str, time_col: str = "ts") -> DataFrame:
    """(window_start, window_end, keys, aggs) of sessions: rows of one key whose
    times are at most ``gap`` apart; a session ends ``gap`` after its last row."""
    w = _watched(events, time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(*aggs)
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in w.columns if c != "w"])


def write_closed(windows: DataFrame, root: str, name: str) -> StreamingQuery:
    """Appends windows to ``root/name`` once the watermark has passed their end."""
    w = windows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/{name}")
    return w.option("checkpointLocation", f"{root}/_{name}").trigger(availableNow=True).start()
