"""Rows are dealt to tasks by their number, whatever the files' row groups."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import extraction as xt
from docloom.sources.io import by_key, spread
from docloom.workloads import inputs as inp


def dealt(df):
    return [n for n in df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path, small_splits):
    spark.range(20000).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert df.rdd.getNumPartitions() >= 4 and len(dealt(df)) == 1
    out = spread(df)
    assert len(dealt(out)) >= 4 and max(dealt(out)) < 10000
    assert sorted(r.id for r in out.collect()) == list(range(20000))


def test_tasks_follow_the_rows(spark, tmp_path):
    spark.range(8000).repartition(4).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert max(dealt(spread(df, rows=500))) <= 600
    assert len(dealt(by_key(df, "id", rows=500))) == 16
    empty = df.filter("id < 0")
    assert spread(empty).count() == 0 and by_key(empty, "id").count() == 0


def test_a_scan_dealt_well_is_left_alone(spark, tmp_path, small_splits):
    spark.range(8000).repartition(16).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert spread(df) is df


def test_documents_of_one_row_group(spark, tmp_path, small_splits):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(dealt(inp.documents(spark, str(tmp_path)))) >= 4


def test_sections_of_many_lines(spark, monkeypatch):
    lines = spark.range(400).select((F.col("id") / 10).cast("long").alias("document_id"), (F.col("id") % 10).alias("element_id"), F.lit(0).alias("page_number"),
                                    F.when(F.col("id") % 10 == 0, "Medications:").otherwise("Take metformin.").alias("text"))
    monkeypatch.setattr(xt, "by_key", lambda df, *c: by_key(df, *c, rows=20))
    out = xt.assign_sections(lines)
    assert out.rdd.getNumPartitions() == 20 and out.filter("section_name = 'medications'").count() == 400
