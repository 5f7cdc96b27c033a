"""Request workers: JSON messages in, replies out, as Structured Streaming.

A message is ``{request_id, reply_topic, payload}``; a reply is ``{request_id,
ok, result, error}``.  Unparsable messages are dropped, failures become
``ok = false`` replies, and a request redelivered within ``remember`` is
answered once, whichever micro-batches its copies fall into."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as tx
from docloom.sources.schemas import REQUESTS

Handler = Callable[[DataFrame], DataFrame]  # (request_id, payload) -> (request_id, result, error)


def read_requests(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """Text files of JSON lines; ``files_per_trigger`` bounds work in flight."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_requests(raw)


def parse_requests(raw: DataFrame) -> DataFrame:
    m = raw.select(F.from_json("value", REQUESTS, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    return m.filter(F.col("request_id").isNotNull())


def chunk_handler(requests: DataFrame) -> DataFrame:
    """Fixed-window chunk service: payload ``{text, chunk_size, overlap}``."""
    p = F.from_json("payload", "text string, chunk_size int, overlap int")
    d = requests.select("request_id", p.alias("p")).select("request_id", "p.*")
    size, ov = F.coalesce("chunk_size", F.lit(512)), F.coalesce("overlap", F.lit(0))
    bad = F.when(F.col("text").isNull(), "missing text").when(size <= 0, "chunk_size must be positive")
    d = d.withColumn("w", tx.words("text")).withColumn("error", bad)
    step = F.greatest(F.lit(1), size - ov)
    starts = F.when(F.col("error").isNull() & (F.size("w") > 0), F.sequence(F.lit(0), F.size("w") - 1, step)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("starts", starts).withColumn("size", size)
    chunks = F.transform("starts", lambda s: F.struct(F.array_join(F.slice("w", s + 1, F.col("size")), " ").alias("text"), s.alias("token_start"),
                                                      F.least(s + F.col("size"), F.size("w")).alias("token_end")))
    return d.select("request_id", F.when(F.col("error").isNull(), F.to_json(chunks)).alias("result"), "error")


def replies(handled: DataFrame) -> DataFrame:
    return handled.select("request_id", F.col("error").isNull().alias("ok"), "result", "error")


def serve(requests: DataFrame, handler: Handler, out: str, checkpoint: str, once: bool = True, remember: str = "7 days") -> StreamingQuery:
    """Answer requests micro-batch by micro-batch.  The batch id names the
    output folder, so a replayed batch overwrites its own replies.  Answered ids
are stream state, partitioned by id and dropped ``remember`` after arrival."""
    first = requests.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    first = first.dropDuplicatesWithinWatermark(["request_id"]).drop("_arrived")

    def batch(df: DataFrame, batch_id: int) -> None:
        replies(handler(df)).write.mode("overwrite").json(f"{out}/batch={batch_id}")

    w = first.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
