"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.io import checkpoint as cut
from docloom.sources.io import shared_folder, stored

__all__ = ["aside", "cut", "held_out", "shared_folder", "small_batches", "stored", "table", "with_small"]

BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch of whole texts can hold in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def with_small(df: DataFrame, side: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow ``side``: broadcast when its counted rows are within
    the bound, a shuffle join beyond it."""
    small = side.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(side) if small else side, on, how)


def aside(docs: DataFrame, *used: str, more: dict[str, Column] | None = None, **renamed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its ``used`` columns as they are, those of ``renamed``
    (name=column) under that name, all others under names no operator gives, so
    that columns an operator adds meet none of them, and ``more`` (made from the
    columns of ``docs``); and a function that gives a result the columns of
    ``docs`` back, less those of ``without``, then ``added`` (a column of
    ``docs`` of such a name is left out)."""
    inner = {**{c: c for c in used}, **{c: n for n, c in renamed.items()}}
    names = [inner.get(c, f"__aside_{i}") for i, c in enumerate(docs.columns)]

    def back(out: DataFrame, without: tuple[str, ...] = (), **added: Column) -> DataFrame:
        own = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c not in without and c not in added]
        return out.select(*own, *[v.alias(n) for n, v in added.items()])

    more = more or {}
    return docs.select("*", *more.values()).toDF(*names, *more), back


def held_out(doc_id: str | Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
