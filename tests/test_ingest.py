"""The growing index against one built from scratch."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import indexing as ix
from docloom.operators import retrieval as rt
from docloom.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_scratch(spark, root, units, ask):
    got, want = ingest.open_bm25(spark, root), ix.bm25_index(units)
    assert rows(got["postings"].select("doc_idx", "doc_len", "term", "tf")) == rows(want["postings"].select("doc_idx", "doc_len", "term", "tf"))
    assert rows(got["vocab"].select("term", "df", F.round("idf", 9))) == rows(want["vocab"].select("term", "df", F.round("idf", 9)))
    q = ask("red fox", "blue", "fox fox")
    assert rows(rt.bm25(q, got, 5)) == rows(rt.bm25(q, want, 5))


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_idx long, text string")


def test_batches_replace_delete_and_replay(spark, tmp_path, ask):
    root = str(tmp_path / "ix")
    ingest.append(frame(spark, (1, "red fox"), (2, "blue fox fox"), (3, None), (4, "gone")), 0, root)
    ingest.append(frame(spark, (5, "green"), (2, "Blue bird")), 3, root, deleted=frame(spark, (4, ""), (99, "")))
    same_as_scratch(spark, root, frame(spark, (1, "red fox"), (2, "blue bird"), (3, None), (5, "green")), ask)
    before = rows(ingest.open_bm25(spark, root)["vocab"])
    ingest.append(frame(spark, (5, "other text")), 3, root)  # committed: a replay changes nothing
    assert rows(ingest.open_bm25(spark, root)["vocab"]) == before
    ingest.append(frame(spark, (2, "back fox"), (4, "red again")), 4, root)
    now = frame(spark, (1, "red fox"), (2, "back fox"), (3, None), (4, "red again"), (5, "green"))
    same_as_scratch(spark, root, now, ask)
    assert rows(ingest.live_units(spark, root)) == rows(now)
    assert rows(ingest.open_bm25(spark, root, at=0)["vocab"].select("term", "df")) == [("blue", 1), ("fox", 2), ("gone", 1), ("red", 1)]
    with pytest.raises(ValueError):
        ingest.append(now, 2, root)
    small = str(tmp_path / "small")
    assert ingest.compacted(spark, root, small) == 4
    same_as_scratch(spark, small, now, ask)
    ingest.append(frame(spark, (1, "blue")), 5, small)
    same_as_scratch(spark, small, frame(spark, (1, "blue"), (2, "back fox"), (3, None), (4, "red again"), (5, "green")), ask)


def test_a_batch_that_died_is_invisible_and_can_be_replayed(spark, tmp_path, ask):
    root = str(tmp_path / "ix")
    ingest.append(frame(spark, (1, "red fox")), 0, root)
    frame(spark, (7, "half")).write.parquet(f"{root}/units/batch=1")
    spark.createDataFrame([("half", 1)], ingest.SCHEMAS["terms"]).write.parquet(f"{root}/terms/batch=1")
    same_as_scratch(spark, root, frame(spark, (1, "red fox")), ask)
    ingest.append(frame(spark, (7, "half"), (7, "half more")), 1, root)
    same_as_scratch(spark, root, frame(spark, (1, "red fox"), (7, "half more")), ask)


def test_odd_units(spark, tmp_path, ask):
    root = str(tmp_path / "ix")
    ingest.append(frame(spark), 0, root)
    assert ingest.open_bm25(spark, root)["postings"].count() == 0
    wide = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 6, "y")], "doc_idx long, text string, version int, term string")
    ingest.append(wide, 1, root)
    assert [(r.doc_idx, r.text) for r in ingest.live_units(spark, root).collect()] == [(1, "b")]
    with pytest.raises(Exception, match="without doc_idx"):
        ingest.append(frame(spark, (None, "x")), 2, root)
    same_as_scratch(spark, root, frame(spark, (1, "b")), ask)


def test_stream_feeds_the_index(spark, tmp_path, ask):
    src, root = str(tmp_path / "in"), str(tmp_path / "ix")
    parts = [[(1, "red fox"), (2, "blue")], [(3, "fox den")], [(2, "red red"), (4, None)]]
    for i, p in enumerate(parts):
        frame(spark, *p).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema("doc_idx long, text string").option("maxFilesPerTrigger", 1).parquet(src)
        ingest.ingest(s, root, str(tmp_path / "cp")).awaitTermination()
    assert len(ingest.committed(spark, root)) == 3
    same_as_scratch(spark, root, frame(spark, (1, "red fox"), (2, "red red"), (3, "fox den"), (4, None)), ask)
