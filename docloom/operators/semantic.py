"""Embeddings and dense / hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.filters import compile_filters
from docloom.functions.scores import rrf
from docloom.operators.retrieval import cut
from docloom.sources.io import stored

MAX_QUERY_BLOCK = 2048  # query vectors held by one scan; more queries scan in blocks
HIT = "query_id long, doc_idx long, score double"

Provider = Callable[[DataFrame], DataFrame]  # (id, text) -> (id, vector)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(n, F.size(v)).alias("n")), lambda z: z["x"].cast("double") / z["n"])


def hashed_embedding(texts: DataFrame, id_col: str = "doc_idx", text_col: str = "text", dims: int = 64) -> DataFrame:
    """Offline embedding provider: feature-hashed token counts, L2-normalised.
    One row per non-zero dimension (``dim, value``)."""
    t = texts.select(F.col(id_col).alias("id"), F.explode(tx.tokens(text_col)).alias("term"))
    # digest each distinct (id, term) once, not each occurrence
    g = t.groupBy("id", "term").agg(F.count("*").alias("n"))
    g = g.groupBy("id", (tx.md5_hash60(F.col("term"), 0) % dims).cast("int").alias("dim")).agg(F.sum("n").alias("n"))
    norm = g.groupBy("id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return g.join(norm, "id").select(F.col("id").alias(id_col), "dim", (F.col("n") / F.col("norm")).alias("value"))


def dense_vectors(sparse: DataFrame, id_col: str = "doc_idx", dims: int = 64) -> DataFrame:
    m = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    return m.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))


def embed_units(units: DataFrame, provider: Provider, id_col: str = "doc_idx") -> DataFrame:
    """Vectors of units through a provider, L2-normalised."""
    v = provider(units.select(id_col, "text"))
    return v.select(id_col, l2_normalize(F.col("vector")).alias("vector"))


def batch_provider(encode: Callable[[list[str]], np.ndarray], id_col: str = "doc_idx", id_type: str = "long") -> Provider:
    """Wrap a text encoder as an Arrow-batched provider; a model loaded inside
    ``encode`` is loaded once per Python worker."""
    def run(df: DataFrame) -> DataFrame:
        def step(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                vecs = np.asarray(encode(list(pdf["text"])), dtype=np.float64)
                yield pd.DataFrame({id_col: pdf[id_col], "vector": list(vecs)})

        return df.select(id_col, "text").mapInPandas(step, f"{id_col} {id_type}, vector array<double>")

    return run


def _scan(block: list[tuple[int, list[float]]], vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """One pass over the vectors against a bounded block of queries: a matrix
    product per Arrow batch keeps k hits per query and batch."""
    ids = np.array([q for q, _ in block], dtype=np.int64)
    mat = np.array([v for _, v in block], dtype=np.float64)

    def step(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            docs = pdf["doc_idx"].to_numpy()
            if metric == "ip":
                s = (mat @ x.T + 1.0) / 2.0
            else:  # squared distance; negated so that larger is nearer
                s = -((mat**2).sum(1)[:, None] - 2 * mat @ x.T + (x**2).sum(1)[None, :])
            # the k-th best value with all that may round to it: exact under the final order
            keep = min(k, s.shape[1])
            kth = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
            qi, di = np.nonzero(s >= kth[:, None] - 1.1e-6)
            yield pd.DataFrame({"query_id": ids[qi], "doc_idx": docs[di], "score": s[qi, di]})

    return vectors.select("doc_idx", "vector").mapInPandas(step, HIT)


def dense(query_vectors: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "ip",
          docs: DataFrame | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
    """Exact nearest units of every query vector (``query_id, vector``).

    Filters apply before the search, so k results come back whenever k units
    pass.  Query vectors are read in blocks by the hash of the row, of half of
    ``MAX_QUERY_BLOCK`` on average: that is what driver and tasks hold, however many
    queries, or vectors of one query, there are; none is left out.  Beyond one
    block, the k best of a block are written before the next is read.  Only
    repeated rows (same query, same vector) share a block whatever their number."""
    if filters:
        if docs is None:
            raise ValueError("filters need the docs relation")
        ok = docs.filter(compile_filters(filters, "vector", docs.columns)).select("doc_idx")
        vectors = vectors.join(ok, "doc_idx", "left_semi")
    q = query_vectors.select("query_id", "vector")
    n = q.count()
    blocks = max(1, -(-n // (MAX_QUERY_BLOCK // 2)))
    out = None
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)) == b)
        rows = [(r.query_id, list(r.vector)) for r in part.collect()]
        if not rows:
            continue
        hit = _scan(rows, vectors, k, metric)
        if blocks > 1:
            hit = stored(cut(hit, k).select("query_id", "doc_idx", "score"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = q.sparkSession.createDataFrame([], HIT)
    return cut(out, k)


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """Weighted RRF of a lexical and a dense ranking; ``alpha`` = dense weight."""
    both = lexical.select("query_id", "doc_idx", "rank", F.lit(1.0 - alpha).alias("w")).unionByName(
        semantic.select("query_id", "doc_idx", "rank", F.lit(alpha).alias("w")))
    return rrf(both, ["doc_idx"], k, weight=F.col("w")).select("query_id", "doc_idx", "score", "rank")


def hyde(queries: DataFrame, vectors: DataFrame, provider: Provider, passages: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Search with the embedding of a hypothetical passage where one was
    generated (``query_id, passage``), else with the query's own."""
    t = queries.select("query_id", "query")
    if passages is not None:
        t = t.join(passages, "query_id", "left").select("query_id", F.coalesce("passage", "query").alias("query"))
    v = provider(t.select(F.col("query_id").alias("doc_idx"), F.col("query").alias("text")))
    return dense(v.select(F.col("doc_idx").alias("query_id"), l2_normalize(F.col("vector")).alias("vector")), vectors, k)
