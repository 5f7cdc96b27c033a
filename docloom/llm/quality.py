"""Quality classifier: regularised quadratic discriminant.

Statistics of each whole text, transformed by logs and roots, are modelled per
class by a Gaussian.  Counts, sums and cross products of all labelled rows are
summed in Spark (one small row per class and task), so nothing is sampled.
Class covariances shrink towards the pooled one and towards its diagonal; the
score is the logistic of the Mahalanobis log-density difference, computed with
Cholesky factors that are made once per worker.

Defined cases: null texts count as empty; every text has a score; without
labels of both classes the score is the share of class 1 (0.5 without any
label); null labels are not learnt; conflicting labels of one document are both
learnt; repeated rows are learnt as often as they stand; extra columns are kept
unless they carry a name of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut, held_out, small_batches

THRESHOLD = 0.3
NAMES = ("log_bytes", "log_words", "word_bytes", "upper", "capital_words", "digits", "symbols", "stops", "bars", "types", "adjacent", "lines", "line_repeats", "non_ascii")
P = len(NAMES)
_CLASS = bytearray(256)  # 1 upper, 2 digit, 3 symbol, 4 sentence stop, 5 bar, 6 newline, 7 non-ASCII
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (7 if _c >= 128 else 1 if _ch.isupper() else 2 if _ch.isdigit() else 6 if _ch == "\n" else 5 if _ch == "|"
                  else 4 if _ch in ".,;:?" else 3 if _ch in "#$%&*!@^~<>=+{}[]\\_" else 0)
_CLASS = bytes(_CLASS)
_CAPS = re.compile(rb"\b[A-Z]{2,}\b")


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(b), 1)
    kind = np.bincount(np.frombuffer(b.translate(_CLASS), dtype=np.uint8), minlength=8) if b else np.zeros(8)
    w = b.split()
    k = max(len(w), 1)
    same = sum(map(bytes.__eq__, w, w[1:])) if len(w) > 1 else 0
    lines = b.split(b"\n")
    root = lambda x: float(np.sqrt(x))
    return np.array([
        np.log1p(len(b)), np.log1p(len(w)), np.log1p((n - kind[6]) / k), root(kind[1] / n), root(len(_CAPS.findall(b)) / k), root(kind[2] / n),
        root(kind[3] / n), root(kind[4] / n), root(kind[5] / n), np.log1p(len(set(w))) - np.log1p(len(w)), root(same / k),
        np.log1p(len(lines)), root(1 - len(set(lines)) / len(lines)), root(kind[7] / n)])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``x`` (array of the statistics)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.withColumn("x", stats(F.col(text_col))).drop(text_col)


class Gaussians:
    """Moments of both classes -> log-density difference."""

    def __init__(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.2) -> None:
        self.prior = (n[1] + 1) / (n.sum() + 2)
        self.ok = bool((n > 1).all())
        if not self.ok:
            return
        self.mean = s / n[:, None]
        scatter = ss - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        self.chol = []
        for k in (0, 1):
            c = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
            self.chol.append(np.linalg.cholesky(c))
        self.inverse = [np.linalg.inv(c) for c in self.chol]
        self.half_logdet = [np.log(np.diag(c)).sum() for c in self.chol]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of (rows, statistics)."""
        if not self.ok:
            return np.full(len(x), self.prior if self.prior != 0.5 else 0.5)
        d = [-0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) - self.half_logdet[k] for k in (0, 1)]
        z = d[1] - d[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z / 4, -500, 500)))  # dependent statistics: a quarter of the evidence


def fit(rows: DataFrame, label: str = "quality", **kw) -> Gaussians:
    """Gaussians of rows (x, label).  Each task sends one row of moments per class."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + P + P * P))
        for b in batches:
            for k in (0, 1):
                x = np.array(b["x"][b["y"] == k].tolist(), dtype=float).reshape(-1, P)
                total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"k": [0, 1], "m": total.tolist()})

    got = rows.select("x", F.col(label).cast("int").alias("y")).filter("y in (0, 1)").mapInPandas(moments, "k int, m array<double>")
    got = got.select("k", F.posexplode("m")).groupBy("k", "pos").agg(F.sum("col").alias("v")).collect()  # 2 x (1 + p + p x p) rows
    m = np.zeros((2, 1 + P + P * P))
    for r in got:
        m[r.k, r.pos] = r.v
    return Gaussians(m[:, 0], m[:, 1:1 + P], m[:, 1 + P:].reshape(2, P, P), **kw)


def score(rows: DataFrame, model: Gaussians) -> DataFrame:
    """Adds ``score`` to rows that carry ``x``."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def tell(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.array(x.tolist(), dtype=float).reshape(-1, P)))

    return rows.withColumn("score", tell("x"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (without text) with ``held_out``, ``score`` and ``predicted``;
    labels of held-out rows are never read.  Columns of these names are replaced, all
    others stay."""
    named, back = aside(docs, "doc_id", "text")
    rows = cut(with_statistics(named))
    known = labels.filter(~held_out("doc_id")).select("doc_id", "quality")
    model = fit(rows.select("doc_id", "x").join(known, "doc_id"))
    return back(score(rows, model), ("text",), held_out=held_out("doc_id"), score=F.col("score"), predicted=(F.col("score") >= threshold).cast("int"))
