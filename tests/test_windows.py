"""Event-time windows and the rows that come too late for them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.streaming import windows as ew

SCHEMA = "event_id long, ts timestamp, user string"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def feed(spark, root, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, at(m), u) for k, m, u in rows], SCHEMA).coalesce(1).write.parquet(f"{root}/inbox/part={i}")
        ew.split_late(spark.readStream.schema(SCHEMA).parquet(f"{root}/inbox/part=*"), root, "10 minutes").awaitTermination()


def test_every_row_is_in_a_window_or_late(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, root, [[(1, 5, "a"), (2, 30, "a")], [(3, 19, "a"), (4, 20, "a"), (5, None, "b"), (6, 65, "b")], [], [(7, 54, "a"), (8, 55, "a"), (9, 300, None), (9, 300, None)]])
    late = {(r.event_id, r.batch) for r in ew.late(spark, root).collect()}
    assert late == {(3, 1), (5, 1), (7, 3)}  # 19 < 30 - 10, no time, 54 < 65 - 10; 20 and 55 are in time
    stream = ew.tumbling(ew.on_time(spark, root, SCHEMA), "1 hour", ["user"], [F.count("*").alias("n")], "10 minutes")
    ew.write_closed(stream, root, "hours").awaitTermination()
    got = {(r.window_start, r.user): r.n for r in spark.read.schema(stream.schema).parquet(f"{root}/hours").collect()}
    assert got == {(at(0), "a"): 4, (at(60), "b"): 1}  # the hour at 300 is still open
    batch = ew.tumbling(spark.read.schema(SCHEMA).parquet(f"{root}/ontime"), "1 hour", ["user"], [F.count("*").alias("n")], "10 minutes")
    assert {(r.window_start, r.user): r.n for r in batch.collect()} == {**got, (at(300), None): 2}


def test_a_replayed_batch_deals_the_same_rows(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, root, [[(1, 60, "a")], [(2, 49, "a"), (3, 200, "a")]])
    assert spark.read.parquet(f"{root}/clock").count() == 2
    # the mark of batch 1 does not see batch 1's own clock, nor later ones
    mark = spark.range(1).select(ew.watermark(spark, root, "10 minutes", 1).alias("m")).first().m
    assert mark == at(50)
    assert spark.range(1).select(ew.watermark(spark, root, "10 minutes", 0).alias("m")).first().m is None


def test_sessions_close_after_the_gap(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, root, [[(1, 0, "a"), (2, 4, "a"), (3, 20, "a"), (4, 22, "b")], [(5, 90, "b")]])
    s = ew.sessions(ew.on_time(spark, root, SCHEMA), "5 minutes", ["user"], [F.count("*").alias("n")], "10 minutes")
    ew.write_closed(s, root, "sessions").awaitTermination()
    got = {(r.user, r.window_start, r.window_end, r.n) for r in spark.read.schema(s.schema).parquet(f"{root}/sessions").collect()}
    assert got == {("a", at(0), at(9), 2), ("a", at(20), at(25), 1), ("b", at(22), at(27), 1)}


def test_no_events(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, root, [[]])
    assert ew.late(spark, root).count() == 0
    batch = spark.createDataFrame([], SCHEMA)
    assert ew.sessions(batch, "5 minutes", ["user"], [F.count("*").alias("n")], "1 hour").count() == 0
