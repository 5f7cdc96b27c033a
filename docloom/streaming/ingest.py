"""Incremental ingestion: an index that grows by micro-batches.

Under one root every relation has a folder per batch, ``<relation>/batch=<n>``:

=============  ==============================================================
``units``      units of the batch (``doc_idx``, its other columns, ``text``)
``postings``   ``doc_idx, doc_len, term, tf``
``terms``      document-frequency deltas ``term, df``
``totals``     deltas of the number of units and of their summed length
``replaced``   versions that the batch ends: ``doc_idx, in_batch``
``commits``    one row, written last
=============  ==============================================================

A unit that comes again replaces its former version, an id in ``deleted`` ends
it: the batch writes negative deltas out of the stored postings of what it ends,
so statistics are plain sums and nothing is recomputed over the corpus.  A batch
reads only batches committed before it and overwrites its own folders, so a
replayed one changes nothing, and one that died half-way is invisible until it
is replayed.  Readers see committed batches only.

``compacted`` writes what is live into a new root as one batch with the last
number, from which later batches go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as tx
from docloom.operators.indexing import Relations, doc_records

# Columns of the relations whose layout does not depend on the units.
SCHEMAS = {
    "postings": "doc_idx long, doc_len long, term string, tf long",
    "terms": "term string, df long",
    "totals": "n_docs long, total_len long",
    "replaced": "doc_idx long, in_batch long",
    "commits": "n_units long",
}


def committed(spark: SparkSession, root: str, before: int | None = None) -> list[int]:
    """Numbers of the committed batches, a row each in ``commits``."""
    rows = _read(spark, root, "commits", None).select("batch").distinct().collect()
    return sorted(r.batch for r in rows if before is None or r.batch < before)


def _read(spark: SparkSession, root: str, name: str, batches: Sequence[int] | None, schema: str | None = None) -> DataFrame:
    """A relation over the given batches (pruned by folder), with its batch."""
    schema = schema or SCHEMAS[name]
    full = f"{schema}, batch long"
    try:
        df = spark.read.schema(full).parquet(f"{root}/{name}")
    except AnalysisException:  # no folder yet
        df = spark.createDataFrame([], full)
    return df if batches is None else df.filter(F.col("batch").isin(list(batches)))


def _live(rows: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rows whose version no later batch has ended."""
    ended = replaced.select(F.col("doc_idx").alias("_d"), F.col("in_batch").alias("_b"))
    return rows.join(ended, (F.col("doc_idx") == F.col("_d")) & (F.col("batch") == F.col("_b")), "left_anti")


def unit_postings(units: DataFrame) -> DataFrame:
    """(doc_idx, doc_len, term, tf) in one tokenising pass."""
    toks = units.select("doc_idx", tx.tokens("text").alias("_t"))
    ex = toks.select("doc_idx", F.size("_t").cast("bigint").alias("doc_len"), F.explode("_t").alias("term"))
    return ex.groupBy("doc_idx", "doc_len", "term").agg(F.count("*").alias("tf"))


def append(units: DataFrame, batch_id: int, root: str, deleted: DataFrame | None = None) -> None:
    """Add one batch of units (``doc_idx, text, ...``) to the index at ``root``.

    Of several rows of one id in a batch the greatest by (``version`` if there
    is one, text) is taken.  A null id is refused, as nothing could replace it;
    a null text is a unit without terms.  ``deleted`` (``doc_idx``) ends units.
    A batch already committed is left as it is."""
    spark = units.sparkSession
    done = committed(spark, root)
    if batch_id in done:
        return
    if done and batch_id < done[-1]:
        raise ValueError(f"batch {batch_id} comes after {done[-1]}")
    order = [F.col(c).desc_nulls_last() for c in ("version", "text") if c in units.columns]
    one = units.withColumn("_r", F.row_number().over(Window.partitionBy("doc_idx").orderBy(*order))).filter("_r = 1").drop("_r")
    one = one.withColumn("doc_idx", F.when(F.col("doc_idx").isNotNull(), F.col("doc_idx").cast("bigint")).otherwise(F.raise_error(F.lit("a unit without doc_idx"))))
    folder = lambda name: f"{root}/{name}/batch={batch_id}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(folder(name))
        return spark.read.schema(df.schema).parquet(folder(name))

    new = write(one, "units")
    posts = write(unit_postings(new.select("doc_idx", "text")), "postings")

    # what the batch ends, by the narrow id columns of earlier batches
    ids = new.select("doc_idx")
    if deleted is not None:
        ids = ids.unionByName(deleted.select(F.col("doc_idx").cast("bigint").alias("doc_idx"))).distinct()
    earlier = _live(_read(spark, root, "units", done, "doc_idx long"), _read(spark, root, "replaced", done))
    ended = write(earlier.join(ids, "doc_idx", "left_semi").select("doc_idx", F.col("batch").alias("in_batch")), "replaced")
    old = _read(spark, root, "postings", done).join(ended.withColumnRenamed("in_batch", "batch"), ["doc_idx", "batch"], "left_semi")

    change = posts.select("term", F.lit(1).alias("s")).unionByName(old.select("term", F.lit(-1).alias("s")))
    write(change.groupBy("term").agg(F.sum("s").alias("df")).filter("df <> 0"), "terms")
    length = lambda df: F.coalesce(df.groupBy().agg(F.sum("tf").alias("n")).scalar(), F.lit(0))
    count = lambda df: df.groupBy().agg(F.count("*").alias("n")).scalar()
    write(spark.range(1).select((count(new) - count(ended)).alias("n_docs"), (length(posts) - length(old)).alias("total_len")), "totals")
    write(spark.range(1).select(count(new).alias("n_units")), "commits")


def open_bm25(spark: SparkSession, root: str, at: int | None = None) -> Relations:
    """The relations BM25 reads, as of the last committed batch or of batch ``at``."""
    done = [b for b in committed(spark, root) if at is None or b <= at]
    units = spark.read.parquet(f"{root}/units").filter(F.col("batch").isin(done))
    replaced = _read(spark, root, "replaced", done)
    stats = _read(spark, root, "totals", done).agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_len") / F.sum("n_docs")).alias("avg_doc_len"))
    n = stats.select("n_docs").scalar()
    vocab = _read(spark, root, "terms", done).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return {"docs": doc_records(_live(units, replaced).drop("batch")), "postings": _live(_read(spark, root, "postings", done), replaced).drop("batch"),
            "vocab": vocab.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "stats": stats}


def live_units(spark: SparkSession, root: str) -> DataFrame:
    """The current version of every unit."""
    done = committed(spark, root)
    units = spark.read.parquet(f"{root}/units").filter(F.col("batch").isin(done))
    return _live(units, _read(spark, root, "replaced", done)).drop("batch")


def compacted(spark: SparkSession, root: str, into: str) -> int:
    """Write the live state of ``root`` to the new root ``into`` as one batch;
    returns its number.  Writers and readers then move to ``into``."""
    done = committed(spark, root)
    if not done:
        raise ValueError(f"nothing is committed at {root}")
    if committed(spark, into):
        raise ValueError(f"{into} holds an index already")
    r = open_bm25(spark, root)
    put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{into}/{name}/batch={done[-1]}")
    put(live_units(spark, root), "units")
    put(r["postings"].hint("rebalance", "term"), "postings")
    put(r["vocab"].select("term", "df"), "terms")
    put(_read(spark, root, "totals", done).agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")), "totals")
    put(spark.createDataFrame([], SCHEMAS["replaced"]), "replaced")
    put(spark.createDataFrame([(len(done),)], SCHEMAS["commits"]), "commits")
    return done[-1]


def ingest(units: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Feed a stream of units (``doc_idx, text, ...``) to the index at ``root``."""
    w = units.writeStream.foreachBatch(lambda df, batch_id: append(df, batch_id, root)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
