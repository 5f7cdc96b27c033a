"""Ranking building blocks: rounding, top-k, min-max, reciprocal rank fusion,
range joins and interval islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantize(c: Column, digits: int = 6) -> Column:
    """Half-up rounding in plain double arithmetic (same on any IEEE engine)."""
    m = float(10**digits)
    return F.floor(c * m + 0.5) / m


def topk(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    k: int | None,
    rank_col: str = "rank",
) -> DataFrame:
    """Rank inside ``part`` and keep the first ``k``.  ``row_number() <= k``
    lets Spark prune to k rows per map task before the shuffle, so a hot
    partition never travels whole."""
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.filter(F.col(rank_col) <= k) if k is not None else out


def minmax(c: Column, part: Sequence[str], invert: bool = False) -> Column:
    """Min-max scaling per partition; a constant partition maps to 1 when its
    value is positive, else 0."""
    w = Window.partitionBy(*part)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    x = F.when(hi <= lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((c - lo) / (hi - lo))
    return 1.0 - x if invert else x


def rrf(
    ranked: DataFrame,
    key: Sequence[str],
    top_k: int | None = None,
    k: int = 60,
    weight: Column | None = None,
    query: str = "query_id",
    tie: Sequence[str] = ("doc_idx",),
    digits: int = 6,
) -> DataFrame:
    """Reciprocal rank fusion over a long table of ranked lists.

    ``ranked`` has one row per (query, list, item) with its ``rank`` inside the
    list.  One aggregation sums ``weight / (k + rank)``; map-side combine keeps
    the shuffle at one row per item and task."""
    w = weight if weight is not None else F.lit(1.0)
    fused = ranked.groupBy(query, *key).agg(
        quantize(F.sum(w / (F.lit(float(k)) + F.col("rank"))), digits).alias("score")
    )
    return topk(fused, [query], [F.desc("score"), *[F.asc(t) for t in tie]], top_k)


def range_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    l_start: str,
    l_end: str,
    r_start: str,
    r_end: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Half-open interval overlap join as an equi-join on fixed-width bins.

    Both sides explode to the bins they touch.  A pair is kept only in the bin
    where the later of the two starts falls, so no distinct is needed."""
    if how not in ("inner", "left"):
        raise ValueError("range_join supports inner and left")

    def bins(s: str, e: str) -> Column:
        last = F.greatest(F.col(e) - 1, F.col(s))
        return F.explode(
            F.sequence(F.floor(F.col(s) / width).cast("bigint"), F.floor(last / width).cast("bigint"))
        )

    r = right.filter(F.col(r_end) > F.col(r_start)).withColumn("_bin", bins(r_start, r_end))
    l_cols = left.columns
    l = left.filter(F.col(l_end) > F.col(l_start)).withColumn("_bin", bins(l_start, l_end))
    home = F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width).cast("bigint")
    hit = (
        l.join(r, [*on, "_bin"], "inner")
        .filter((F.col(r_end) > F.col(l_start)) & (F.col(r_start) < F.col(l_end)))
        .filter(home == F.col("_bin"))
        .drop("_bin")
    )
    if how == "inner":
        return hit
    extra = [c for c in right.columns if c not in on]
    return left.join(hit.select(*l_cols, *extra), l_cols, "left")


def islands(df: DataFrame, part: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge touching or overlapping intervals: running max of ends, a new
    island where the start passes it, then one aggregate per island."""
    w = Window.partitionBy(*part).orderBy(start, end)
    prev = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(prev.isNull() | (F.col(start) > prev), 1).otherwise(0))
    grouped = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*part, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end)
    ).drop("_island")
