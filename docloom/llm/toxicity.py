"""Toxicity: class-conditional Kneser-Ney models.

Bigrams of all labelled texts are counted in Spark.  Each class (toxic,
ordinary) has an interpolated Kneser-Ney bigram model over the continuation
counts of its words (how many different words a word follows).  The back-off is
shared: its weights come from the counts of both classes together, and below
the words lies one uniform share of their common vocabulary.  A rare expression
thus gets nearly the same probability from both, and only what one class says
reliably more often tells them apart.

A text is scored in passages of ``PASSAGE`` words by the difference of the two
length-normalised log-likelihoods, where a pair counts once in a passage and
once in a training text (junk repeats itself).  The greatest passage and the
whole text are turned into a probability by a logistic fit on labelled rows that the counts
left out.  The table of differences is held by every task up to
``HELD_ROWS`` rows; beyond, words are joined to it by a shuffle.  Both give the
same scores.

Defined cases: null texts count as empty; an empty text gets the score of
differences 0; without labels of both classes every score is 0; null labels are
not learnt; repeated rows are learnt as often as they stand; extra columns are
kept unless they carry a name of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut, held_out, small_batches, stored, with_small

PASSAGE = 48
DISCOUNT = 0.75
MARGIN = 1.0  # what one class says up to e times as often is neutral
BACK = 0.4  # least share of the shared back-off
MIN_BIGRAM = 2  # a pair of fewer toxic counts is left to the word models
HELD_ROWS = 8_000_000
FIT_ROWS = 20_000  # rows of the logistic fit at most
# Lower-cases A-Z and turns ASCII bytes that are no letter or digit into spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit numbers of the words of a whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    return np.fromiter(map(xxhash.xxh32_intdigest, w), dtype=np.uint32, count=len(w))


def pair_keys(h: np.ndarray) -> np.ndarray:
    """(word before, word) in one long; the first word follows 0."""
    before = np.concatenate([np.zeros(min(1, len(h)), dtype=np.uint32), h[:-1]])
    return (before.astype(np.uint64) << np.uint64(32) | h).view(np.int64)


def bigram_counts(rows: DataFrame) -> DataFrame:
    """(pair, n0, n1) of rows (text, y): in how many texts of each class a pair
    stands, counted per batch, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for k in (0, 1):
                keys = [np.unique(pair_keys(word_hashes(t))) for t in b["text"][b["y"] == k]]
                v, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                zero = np.zeros(len(n), dtype=np.int32)
                parts.append(pd.DataFrame({"pair": v, "n0": zero if k else n.astype(np.int32), "n1": n.astype(np.int32) if k else zero}))
            yield pd.concat(parts)

    return rows.mapInPandas(count, "pair long, n0 int, n1 int").groupBy("pair").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def differences(pairs: DataFrame) -> DataFrame | None:
    """(kind, key, d): log P(toxic) - log P(ordinary) of what was met.  Kind 0:
    a word by its continuation counts; kind 1: a pair (replaces its word).  A
    word of neither class has the shared uniform share from both, so 0.  None
    without both classes."""
    before, word = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    kinds = lambda k: F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"t{k}")
    less = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    w = cut(pairs.groupBy(word.alias("w")).agg(kinds(0), kinds(1), F.count("*").alias("types")))
    total = w.agg(F.sum(less("t0")).alias("t0"), F.sum(less("t1")).alias("t1"), F.sum("types").alias("types"), F.count("*").alias("v")).first()
    if not total.t0 or not total.t1:
        return None
    back = max(BACK, DISCOUNT * total.v / total.types)
    p_word = lambda k: (1 - back) * less(f"t{k}") / total[f"t{k}"] + back / (total.v + 1)
    w = w.select("w", p_word(0).alias("p0"), p_word(1).alias("p1"))
    ctx = pairs.groupBy(before.alias("c")).agg(F.sum(less("n0")).alias("s0"), F.sum(less("n1")).alias("s1"), F.sum(F.col("n0") + F.col("n1")).alias("n"), F.count("*").alias("t"))
    ctx = ctx.filter("s0 > 0 and s1 > 0").select("c", "s0", "s1", F.greatest(F.lit(BACK), DISCOUNT * F.col("t") / F.col("n")).alias("back"))
    full = pairs.filter(F.col("n1") >= MIN_BIGRAM).select("pair", "n0", "n1", before.alias("c"), word.alias("w")).join(w, "w").join(ctx, "c")
    p = lambda k: (1 - F.col("back")) * less(f"n{k}") / F.col(f"s{k}") + F.col("back") * F.col(f"p{k}")
    d = lambda x: (F.signum(x) * F.greatest(F.abs(x) - MARGIN, F.lit(0.0))).cast("float").alias("d")
    return w.select(F.lit(0).alias("kind"), F.col("w").alias("key"), d(F.log("p1") - F.log("p0"))).unionByName(
        full.select(F.lit(1).alias("kind"), F.col("pair").alias("key"), d(F.log(p(1)) - F.log(p(0)))))


class Held:
    """Sorted arrays of the differences."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.key, self.d = [], []
        for k, kind in enumerate((np.uint32, np.int64)):
            part = rows[rows["kind"] == k].sort_values("key")
            self.key.append(np.append(part["key"].to_numpy(dtype=kind), np.iinfo(kind).max))
            self.d.append(np.append(part["d"].to_numpy(dtype=np.float32), np.float32(0)))

    def words(self, pair: np.ndarray) -> np.ndarray:
        """Difference of each word of many texts."""
        v, back = np.unique(pair, return_inverse=True)
        out = np.zeros(len(v), dtype=np.float32)
        for k, keys in enumerate(((v.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32), v)):
            at = np.searchsorted(self.key[k], keys)
            ok = self.key[k][at] == keys
            out[ok] = self.d[k][at[ok]]
        return out[back]


def spread(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, passage numbers) of a whole text, each pair once in a passage."""
    k = pair_keys(word_hashes(text))
    p = np.arange(len(k)) // PASSAGE
    at = np.unique(k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64), return_index=True)[1]
    at.sort()
    return k[at], p[at]


def passages(pair: np.ndarray, passage: np.ndarray, d: np.ndarray) -> tuple[float, float]:
    """Greatest difference of a passage, and what speaks for toxic in the whole
    text, each per word."""
    if not len(d):
        return 0.0, 0.0
    cuts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    first = np.unique(pair, return_index=True)[1]
    return float((np.add.reduceat(d.astype(np.float64), cuts) / PASSAGE).max()), float(np.maximum(d[first], 0).sum(dtype=np.float64) / (len(first) + 20))


def measured(docs: DataFrame, diff: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """``docs`` with its text replaced by ``top`` and ``whole``."""
    spark = docs.sparkSession
    small_batches(spark)
    if diff.limit(held_rows + 1).count() <= held_rows:
        # in slices, so that no single result is large
        parts = [diff.filter(F.pmod(F.xxhash64("key"), F.lit(8)) == i).toArrow().to_pandas() for i in range(8)]
        held = spark.sparkContext.broadcast(Held(pd.concat(parts)))

        @F.pandas_udf("top double, whole double")
        def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                keys = [spread(t) for t in texts]
                d = held.value.words(np.concatenate([k for k, _ in keys])) if keys else np.zeros(0)
                ends = np.cumsum([0, *(len(k) for k, _ in keys)])
                yield pd.DataFrame([passages(k, p, d[a:b]) for (k, p), a, b in zip(keys, ends, ends[1:])], columns=["top", "whole"])

        return docs.withColumn("_m", tell("text")).select("*", "_m.*").drop("_m", "text")

    @F.pandas_udf("array<struct<passage:int,pair:long>>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"passage": int(p), "pair": int(k)} for k, p in zip(*spread(t))])

    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_t", parts("text")).drop("text"))
    each = rows.select("_row", F.explode("_t").alias("t")).select("_row", "t.*").withColumn("w", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    part = lambda k, name: diff.filter(F.col("kind") == k).select(F.col("key").alias(name), F.col("d").alias(f"d{k}"))
    each = each.join(part(1, "pair"), "pair", "left").join(part(0, "w"), "w", "left").withColumn("d", F.coalesce("d1", "d0", F.lit(0.0)).cast("double"))
    top = each.groupBy("_row", "passage").agg(F.sum("d").alias("s")).groupBy("_row").agg((F.max("s") / PASSAGE).alias("top"))
    once = each.groupBy("_row", "pair").agg(F.max(F.greatest("d", F.lit(0.0))).alias("d"))
    whole = once.groupBy("_row").agg((F.sum("d") / (F.count("*") + 20)).alias("whole"))
    return rows.drop("_t").join(top, "_row", "left").join(whole, "_row", "left").fillna(0.0, ["top", "whole"]).drop("_row")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and bias by Newton steps; both classes weigh the same."""
    scale = np.append(np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1]), 1.0)
    x = np.hstack([x / scale[:-1], np.ones((len(x), 1))])
    c = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * w * 1e-2
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w / scale


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[DataFrame, np.ndarray] | None:
    """(differences, logistic weights) from labelled rows; a fifth of them, by
    hash, is left out of the counts and used for the logistic fit."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    rows = with_small(docs.select("doc_id", "text"), known, ["doc_id"], "inner").select(
        "text", "y", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(5_000_000)).alias("_h"))
    diff = differences(stored(bigram_counts(rows.filter(F.col("_h") % 5 != 0).select("text", "y"))))
    if diff is None:
        return None
    diff = stored(diff)
    rest = rows.filter(F.col("_h") % 5 == 0)
    n = known.count()
    rest = rest.filter(F.col("_h") < int(5_000_000 * min(1.0, fit_rows / max(1, n / 5)))) if n / 5 > fit_rows else rest
    got = measured(rest.select("text", "y"), diff).toPandas()
    return diff, logistic(got[["top", "whole"]].to_numpy(), got["y"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` (without text) with ``held_out``, ``score``, ``predicted`` and
    the measures ``top`` and ``whole``; held-out labels are never read.
    Columns of these names are replaced, all others stay."""
    docs, back = aside(docs, "doc_id", "text")
    made = learn(docs, labels.filter(~held_out("doc_id")))
    if made is None:
        out = docs.drop("text").withColumns({"top": F.lit(0.0), "whole": F.lit(0.0), "score": F.lit(0.0)})
    else:
        diff, w = made
        z = F.col("top") * float(w[0]) + F.col("whole") * float(w[1]) + float(w[2])
        out = measured(docs, diff).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0)))))
    return back(out, ("text",), held_out=held_out("doc_id"), score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"), top=F.col("top"), whole=F.col("whole"))
