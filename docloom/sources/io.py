"""Table reading and writing with the storage conventions of the engine."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.filters import compile_filters


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).  Only a session
    of one local JVM that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="docloom-")
    return _LOCAL["dir"]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a zstd Parquet table in the shared folder and reread:
    what follows neither recomputes it nor depends on the executors that made it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    filters: dict[str, Any] | None = None,
    required: bool = False,
) -> DataFrame:
    """Parquet scan with filter push-down.  A missing path is an empty relation
    of ``schema`` unless ``required``."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
    except AnalysisException:
        if required or schema is None:
            raise FileNotFoundError(path) from None
        df = spark.createDataFrame([], schema)
    return df.filter(compile_filters(filters, columns=df.columns)) if filters else df


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    cluster_by: list[str] | None = None,
) -> None:
    """Zstd Parquet, overwrite.  ``cluster_by`` adds a rebalance on those
    columns, so rows of one key land together, hot keys are split by AQE and
    files come out evenly sized."""
    if cluster_by:
        df = df.hint("rebalance", *cluster_by)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report CSV, or an empty relation when there is none."""
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, values: dict[str, Any], path: str) -> None:
    """One-row JSON manifest next to the tables it describes."""
    row = spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first().value)


ROWS = 2**15  # rows of a table that a task of costly per-row work takes
LINES = 2**18  # the same for rows made of them


def spread(df: DataFrame, factor: int = 2, rows: int = ROWS) -> DataFrame:
    """Deal the rows of a scan to tasks by their number, at most about ``rows`` to each
    and to every core.  Splits of a scan go by bytes, and a row group is read by one
    task whatever it holds.  A scan that is dealt well already is returned untouched
    (no shuffle); the rows of its splits are counted from the files' footers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    split = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    found = split.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if not found["n"] or found["most"] <= rows and found["most"] * cores <= 1.5 * found["n"]:
        return df
    return df.repartition(max(cores * factor, -(-found["n"] // rows)))


def by_key(df: DataFrame, *cols: str, rows: int = LINES) -> DataFrame:
    """Hash-partition for grouping on ``cols`` when costly per-row work follows, with
    a partition for every ``rows`` rows at least.
    A partition count given by hand is kept by AQE (it would merge small but
    CPU-heavy partitions) and the grouping that follows needs no exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *cols)


def list_strategies(df: DataFrame, col: str = "strategy_name") -> DataFrame:
    return df.select(col).distinct()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on the folder all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
