"""Language ID: hierarchical discrimination with linear support vector machines.

A text is a vector of hashed letter 1- to 3-grams.  One-versus-one machines
tell language families apart first, then one-versus-one machines of a family
tell its languages apart.  The machines are fitted by dual coordinate descent
on the driver, on a bounded sample of labelled texts (``per_lang`` different
ones of each language at most, by hash order); every document is scored whole in one map.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without a labelled row every text is ``und``; with one learnt language that one
is predicted with score 1; null labels are not learnt; ties between languages
go to the first by name; repeated rows, very long texts and extra columns need
no care.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut, held_out, small_batches, with_small

DIM = 1 << 12
PER_LANG = 600
# Families of closely related languages; a language not named is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
}
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def _letters() -> np.ndarray:
    ok = np.zeros(0x110000, dtype=bool)
    ok[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return ok


class Features:
    """Unit vectors of letter n-gram counts (square roots, so that frequent
    grams do not drown the rest)."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.shift, self.letters = dim, np.uint32(32 - dim.bit_length() + 1), _letters()

    def __call__(self, text: str | None) -> np.ndarray | None:
        """None for a text without a letter."""
        if not text:
            return None
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ok = self.letters[c]
        if not ok.any():
            return None
        c = np.where(ok, c, 0)
        keep = np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])  # runs of other characters count as one
        c = np.concatenate([[0], c[keep], [0]]).astype(np.uint32)
        v = np.zeros(self.dim)
        h = c * MIX[0]
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] * MIX[1] ^ c[n - 1:]) * MIX[2]
            v += np.bincount(h >> self.shift, minlength=self.dim)
        v = np.sqrt(v)
        return (v / np.sqrt(v @ v)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of an L2-regularised hinge-loss machine (dual
    coordinate descent in a fixed seeded order)."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float64)
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(c, max(0.0, a[i] - (y[i] * (x[i] @ w) - 1) / q[i]))
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


class Duel:
    """One-versus-one machines among ``names``; decides by wins, then by the
    sum of margins."""

    def __init__(self, names: list[str], x: np.ndarray, label: np.ndarray) -> None:
        self.names, self.pairs, w = names, list(combinations(range(len(names)), 2)), []
        for a, b in self.pairs:
            m = (label == names[a]) | (label == names[b])
            w.append(svm(x[m], np.where(label[m] == names[a], 1.0, -1.0)))
        self.w = np.array(w, dtype=np.float32)

    def __call__(self, v: np.ndarray) -> tuple[str, float]:
        """Winner and its least margin."""
        if not self.pairs:
            return self.names[0], np.inf
        m = self.w[:, :-1] @ v + self.w[:, -1]
        k = len(self.names)
        wins, total, least = np.zeros(k), np.zeros(k), np.full(k, np.inf)
        for (a, b), d in zip(self.pairs, m):
            for i, s in ((a, d), (b, -d)):
                wins[i] += s > 0
                total[i] += s
                least[i] = min(least[i], s)
        best = max(range(k), key=lambda i: (wins[i], total[i], -i))
        return self.names[best], float(least[best])


class Model:
    def __init__(self, langs: list[str], x: np.ndarray, families: dict[str, str], dim: int) -> None:
        self.dim = dim
        label = np.array(langs, dtype=object)
        family = np.array([families.get(x, x) for x in langs], dtype=object)
        self.top = Duel(sorted(set(family)), x, family) if langs else None
        self.low = {f: Duel(sorted(set(label[family == f])), x[family == f], label[family == f]) for f in set(family)}

    def __call__(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or self.top is None:
            return "und", 0.0
        family, m1 = self.top(v)
        lang, m2 = self.low[family](v)
        return lang, float(1 / (1 + np.exp(-2.0 * np.clip(min(m1, m2), -30, 30))))


def fit(docs: DataFrame, per_lang: int = PER_LANG, families: dict[str, str] | None = None, dim: int = DIM) -> Model:
    """Model of (text, lang) rows.  Per language the ``per_lang`` different texts
    of least hash are learnt; their vectors are all that reaches the driver.  No
    language is left out."""
    small_batches(docs.sparkSession)
    rows = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    each = rows.select("lang", "_h").distinct()  # copies of a text take one place
    n = each.groupBy("lang").count().withColumn("_share", F.least(F.lit(1.0), F.lit(1.5 * per_lang) / F.col("count")))
    # a hash threshold first, so that ranking meets about 1.5 x per_lang texts of each language
    near = with_small(each, n, ["lang"], "inner").filter(F.pmod("_h", F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    w = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1_000_003)), "_h")
    picked = cut(near.select("lang", "_h", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= per_lang).select("lang", "_h"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, seen = Features(dim), set()
        for b in batches:
            out = []
            for lang, text, h in zip(b["lang"], b["text"], b["_h"]):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    v = make(text)
                    if v is not None:
                        out.append((lang, h, v.astype(np.float16).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "v"])

    got = with_small(rows, picked, ["lang", "_h"], "left_semi").mapInPandas(vectors, "lang string, h long, v binary")
    got = got.dropDuplicates(["lang", "h"]).select("lang", "v").collect()
    got.sort(key=lambda r: (r.lang, zlib.crc32(r.v), bytes(r.v)))
    x = np.array([np.frombuffer(r.v, dtype=np.float16) for r in got], dtype=np.float32).reshape(-1, dim)
    return Model([r.lang for r in got], x, FAMILIES if families is None else families, dim)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        make = Features(m.dim)
        for texts in batches:
            yield pd.DataFrame([m(make(t)) for t in texts], columns=["lang_pred", "score"])

    out = docs.drop("lang_pred", "score", "_p").withColumn("_p", tell(F.col(text_col)))
    return out.select("*", "_p.lang_pred", "_p.score").drop("_p")


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out("doc_id")).select("text", "lang")


def identify(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """Stage: rows of no language (``und``, or beaten in a duel: a score under
    ``min_score``) go; ``lang`` becomes the prediction.
    All other columns stay, whatever their names."""
    named, back = aside(docs, "text")
    p = predict(named, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return back(p, lang=F.col("lang_pred")).select(docs.columns)
