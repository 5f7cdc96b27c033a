"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of the benchmark are hashed into a set that every task holds; each
document is scanned once, every hash hit is verified word by word, and the hit
words mark spans to cut or documents to drop.  No document row is shuffled.  A
benchmark beyond ``block_windows`` is split by hash into blocks of at most
about that size; the rows with the hits of a block are written before the next
block is read, so driver and tasks hold one block and no window is left out.

Defined cases: null or empty texts have no words and no hits; items without a
word are ignored; an item without an id marks words but is not listed; repeated
items and rows count as they stand; an empty benchmark hits nothing; extra
columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import aside, small_batches, stored

WINDOW = 10
BLOCK_WINDOWS = 500_000
# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (window, item_id): the words of a window joined by one space."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["text"]):
                w = words(text)
                out += [(b" ".join(w[i:i + window]).decode("utf-8", "surrogatepass"), item) for i in range(max(1, len(w) - window + 1)) if w]
            yield pd.DataFrame(out, columns=["window", "item"])

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInPandas(cut, "window string, item string").distinct()


class Lookup:
    """Word numbers, window hashes and the exact windows of one block."""

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        self.vocab: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set] = {}
        for text, item in rows:
            key = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in text.encode().split(b" "))
            self.items.setdefault(key, set()).add(item)
        by_len: dict[int, list] = {}
        for key in self.items:
            by_len.setdefault(len(key), []).append(key)
        self.hashes = {n: np.unique(rolled(np.array(keys, dtype=np.int64).reshape(-1, n).T)) for n, keys in by_len.items()}

    def scan(self, text_words: list[bytes], hit: np.ndarray, found: set) -> None:
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in text_words), dtype=np.int64, count=len(text_words))
        gap = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(gap[n:] == gap[:-n])
            if len(at):
                h = rolled(np.stack([ids[at + j] for j in range(n)]))
                pos = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for i in at[hashes[pos] == h]:
                    items = self.items.get(tuple(ids[i:i + n].tolist()))
                    if items is not None:
                        hit[i:i + n] = True
                        found |= items


def rolled(columns: np.ndarray) -> np.ndarray:
    """Polynomial hash down the rows of (window, positions)."""
    h = np.zeros(columns.shape[1], dtype=np.uint64)
    for row in columns:
        h = h * BASE + row.astype(np.uint64) + np.uint64(1)
    return h


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_hits`` (sorted word ranges, end exclusive), ``_items``
    (sorted ids) and ``_words`` (number of words)."""
    spark = docs.sparkSession
    small_batches(spark)
    win = item_windows(benchmark, window)
    blocks = max(1, -(-win.count() // block_windows))
    out = docs.withColumns({"_hits": F.expr("cast(array() as array<array<int>>)"), "_items": F.expr("cast(array() as array<string>)"),
                            "_words": F.lit(0).cast("bigint")})
    schema = out.schema
    for k in range(blocks):
        part = win.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)  # at most about block_windows rows
        held = spark.sparkContext.broadcast([(r.window, r.item) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            look = Lookup(held.value)
            for b in batches:
                hits, items, sizes = [], [], []
                for text, h0, i0 in zip(b[text_col], b["_hits"], b["_items"]):
                    w = words(text)
                    hit, found = np.zeros(len(w), dtype=bool), set()
                    for lo, hi in h0:
                        hit[lo:hi] = True
                    look.scan(w, hit, found)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    hits.append(edge.reshape(-1, 2).astype(np.int32).tolist())
                    items.append(sorted((found - {None}) | set(i0)))
                    sizes.append(len(w))
                yield b.assign(_hits=hits, _items=items, _words=sizes)

        out = out.mapInPandas(scan, schema)
        if k < blocks - 1:
            out = stored(out)
            held.unpersist()
    return out


def cut_spans(text: str, hits: list) -> str:
    """``text`` without the characters from the first to the last word of each range."""
    b = text.encode("utf-8", "surrogatepass")
    flat = b.translate(TABLE)
    starts, ends, i = [], [], 0
    for w in flat.split():
        i = flat.index(w, i)
        starts.append(i)
        i += len(w)
        ends.append(i)
    out, at = [], 0
    for lo, hi in hits:
        out.append(b[at:starts[lo]])
        at = ends[hi - 1]
    return b"".join([*out, b[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **kw) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without
    the hit passages; rows without a hit stay untouched."""
    text_col = kw.pop("text_col", "text")
    named, back = aside(docs, text=text_col)
    marked = mark(named, benchmark, **kw)
    if remove == "documents":
        return back(marked.filter(F.size("_hits") == 0))
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove}")

    @F.pandas_udf("string")
    def rest(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(h) else cut_spans(t, h) for t, h in zip(text, hits)], dtype=object)

    out = back(marked.withColumn("text", rest("text", "_hits")))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The columns of the query."""
    m = mark(docs.select("doc_id", "text"), benchmark, **kw)
    n_hit = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda a, h: a + (h[1] - h[0]).cast("bigint"))
    return m.select("doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_hits") > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256), word by word; for tests."""
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for i in range(max(1, len(v) - window + 1)) if v else ():
                key = v[i:i + window]
                for j in range(len(w) - len(key) + 1):
                    if w[j:j + len(key)] == key:
                        hit |= set(range(j, j + len(key)))
                        found.add(str(item))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
