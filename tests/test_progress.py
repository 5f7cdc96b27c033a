"""Progress rows of streams."""

import time

from pyspark.sql import functions as F

from docloom.streaming import progress, requests


def wait_for(check, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not check():
        time.sleep(0.5)
    assert check()


def test_serve_leaves_progress_rows(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    ask = spark.createDataFrame([(f'{{"request_id": "r{i}", "reply_topic": "t", "payload": "{{\\"text\\": \\"a b c\\"}}"}}',) for i in range(5)], "value string")
    ask.repartition(3).write.text(src)
    assert progress.read_progress(spark, log).count() == 0
    with progress.ProgressLog(spark, log):
        q = requests.serve(requests.read_requests(spark, src, 1), requests.chunk_handler, str(tmp_path / "out"), str(tmp_path / "cp"))
        run = str(q.runId)
        q.awaitTermination()
        wait_for(lambda: progress.read_progress(spark, log).filter("state = 'done'").count() == 1)
    s = progress.summary(progress.read_progress(spark, log)).first()
    assert (s.run_id, s.state, s.rows, s.error) == (run, "done", 5, None) and s.batches >= 3
    seen = list(progress.follow(spark, log, run, wait=0.1))
    assert len(seen) == 1 and seen[0]["state"] == "done"
    assert list(progress.follow(spark, log, "no such run", ticks=2, wait=0.1)) == []


def test_failures_are_told(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.range(3).write.parquet(src)
    with progress.ProgressLog(spark, log):
        bad = spark.readStream.schema("id long").parquet(src).withColumn("x", F.raise_error(F.lit("no good")))
        q = bad.writeStream.queryName("bad").foreachBatch(lambda df, i: df.collect()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:  # noqa: BLE001
            pass
        wait_for(lambda: progress.read_progress(spark, log).filter("state = 'failed'").count() == 1)
    s = progress.summary(progress.read_progress(spark, log)).first()
    assert (s.name, s.state, s.batches) == ("bad", "failed", 0) and s.error
