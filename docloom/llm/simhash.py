"""Document fingerprints: SimHash.

Weighted term hashes (words, word pairs and, in short texts, letter 4-grams)
vote on 128 signed bits.  Likeness is 1 minus twice the share of differing bits
(0 where half or more differ).  Permuted block tables find every fingerprint
within a Hamming radius: the bits fall into radius + 2 blocks, of which two stay
equal, so one table per pair of blocks, keyed by both, misses nothing.

``with_next`` gives every document its successor by id without sorting the
corpus in one task: rows are dealt to id ranges, and the first row of each range
also goes to the range before it, the first of all to the last.

Defined cases: a null text is empty; texts without a term have the all-zero
fingerprint and a likeness of 1 to each other; equal ids are ordered by text;
null ids come first; a single row is its own successor; repeated rows stay rows
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut, small_batches
from docloom.llm.minmax import mixed

BITS = 128
RADIUS = 5
SHORT = 64  # words; letter grams fade out up to here
RANGE_CHARS = 4_000_000


def fingerprint(text: str | None) -> bytes:
    """16 bytes: signs of the weighted votes of all terms."""
    w = (text or "").lower().split()
    if not w:
        return bytes(BITS // 8)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, " ".join(w).encode("utf-8", "surrogatepass").split(b" ")), dtype=np.uint64, count=len(w))
    terms, n = np.unique(h, return_counts=True)
    pairs = np.unique(mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    names, weight = [terms, pairs], [0.5 * (1 + np.log(n)), np.ones(len(pairs))]
    if len(w) < SHORT:
        t = " ".join(w)
        grams = sorted({f"#{t[i:i + 4]}" for i in range(max(1, len(t) - 3))})
        names.append(np.array([digest(g.encode("utf-8", "surrogatepass")) for g in grams], dtype=np.uint64))
        weight.append(np.full(len(grams), 0.5 * (1 - len(w) / SHORT)))
    x, weight = np.concatenate(names), np.concatenate(weight).astype(np.float32)
    x = np.stack([mixed(x), mixed(x ^ np.uint64(0xD6E8FEB86659FD93))], axis=1)
    votes = np.zeros(BITS, dtype=np.float32)
    for k in range(0, len(x), 4096):
        bits = np.unpackbits(x[k:k + 4096].view(np.uint8), axis=1)
        votes += 2 * (weight[k:k + 4096] @ bits.astype(np.float32)) - weight[k:k + 4096].sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    d = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, 1 - 2 * d / BITS)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the
    following text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def ranges(docs: DataFrame, range_chars: int) -> list:
    """Bounds that are ids of the table, about one per ``range_chars`` characters."""
    size = docs.agg(F.sum(F.length("text")).alias("c"), F.count("doc_id").alias("n")).first()
    k = min(int(size.n or 0), 100_000, -(-int(size.c or 0) // range_chars))
    if k < 2:
        return []
    got = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 100 * k)).first()[0]
    return sorted(set(got))


def with_next(docs: DataFrame, row, schema: str, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Maps ``row(doc_id, text, next_text, memo)`` over every document and its
    successor.  ``memo`` passes a value of the successor on to its own turn."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = ranges(d, range_chars)
    first = None if not d.filter("doc_id is null").isEmpty() else d.agg(F.min("doc_id")).first()[0]
    kind = d.schema["doc_id"].dataType
    held_bounds = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("r int, bound boolean")
    def place(ids: pd.Series) -> pd.DataFrame:
        b = held_bounds.value
        r = [0 if pd.isna(i) else bisect_right(b, i) for i in ids]
        return pd.DataFrame({"r": r, "bound": [k > 0 and not pd.isna(i) and b[k - 1] == i for k, i in zip(r, ids)]})

    d = d.withColumn("_p", place("doc_id")).select("doc_id", "text", F.col("_p.r").alias("_r"), F.col("_p.bound").alias("_bound"))
    none = F.expr("cast(array() as array<struct<r:int,look:int>>)")
    ahead = F.when(F.col("_bound"), F.array(F.struct((F.col("_r") - 1).alias("r"), F.lit(1).alias("look")))).otherwise(none)
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast(kind)), F.array(F.struct(F.lit(len(bounds)).alias("r"), F.lit(2).alias("look")))).otherwise(none)
    own = F.array(F.struct(F.col("_r").alias("r"), F.lit(0).alias("look")))
    d = d.select("doc_id", "text", F.explode(F.concat(own, ahead, wrap)).alias("e")).select("doc_id", "text", "e.r", "e.look")
    # the first of equal looked-ahead rows is enough; looked-ahead rows sort last in their range
    d = d.repartition("r").sortWithinPartitions("r", "look", "doc_id", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, memo = None, None
        for batch in batches:
            out = []
            for doc_id, text, r, look in zip(batch["doc_id"], batch["text"], batch["r"], batch["look"]):
                if held is not None and held[2] == r:
                    res, memo = row(held[0], held[1], text, memo)
                    out.append(res)
                else:
                    memo = None
                held = None if look else (doc_id, text, r)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return d.mapInPandas(walk, schema)


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Per document: n_chars, its fingerprint, that of the edited text, and the
    likeness to the edited and the next text."""

    def one(doc_id, text, following, memo):
        own = fingerprint(text) if memo is None else memo
        nxt = fingerprint(following)
        new = edited(text, following)
        e = fingerprint(new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, own.hex(), e.hex(), likeness(own, e), likeness(own, nxt)), nxt

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs, one, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", range_chars)


def within(asked: DataFrame, known: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(asked, known, distance) of all different fingerprints (hex strings)
    within ``radius``, by one table per pair of blocks."""
    n = radius + 2
    edge = [BITS * i // n for i in range(n + 1)]
    bits = F.concat(*[F.lpad(F.conv(F.substring("f", 8 * i + 1, 8), 16, 2), 32, "0") for i in range(BITS // 32)])
    block = lambda i: F.substring("_b", edge[i] + 1, edge[i + 1] - edge[i])
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.xxhash64(block(i), block(j)).alias("key")) for k, (i, j) in enumerate(combinations(range(n), 2))])
    tabled = lambda d: d.select(F.col("fingerprint").alias("f")).distinct().withColumn("_b", bits).select("f", F.inline(keys))
    a, b = tabled(asked).withColumnRenamed("f", "asked"), tabled(known).withColumnRenamed("f", "known")
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    dist = sum((F.bit_count(word("asked", i).bitwiseXOR(word("known", i))) for i in range(1, BITS // 32)), F.bit_count(word("asked", 0).bitwiseXOR(word("known", 0))))
    near = a.join(b, ["table", "key"]).select("asked", "known", dist.alias("distance")).filter(F.col("distance") <= radius)
    return near.distinct()


def digest(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """The columns of the query; ``n_within`` (documents other than itself
    within the radius) is searched for ids divisible by ``every``."""
    f = cut(fingerprints(docs))
    asked = F.col("doc_id") % every == 0
    many = f.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    near = within(f.filter(asked), f, radius).join(many.withColumnRenamed("fingerprint", "known"), "known")
    near = cut(near.groupBy(F.col("asked").alias("fingerprint")).agg(F.sum("copies").alias("c")))
    out = f.filter(asked).join(near, "fingerprint", "left").withColumn("n_within", F.col("c") - 1).drop("c")
    rest = f.filter(F.coalesce(~asked, F.lit(True))).withColumn("n_within", F.lit(None).cast("long"))
    return out.select(rest.columns).unionByName(rest)
