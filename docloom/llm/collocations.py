"""Collocations of two and three words, by vertically partitioned suffix subtrees.

The word suffixes of all pieces, truncated at three words, form one suffix tree
for each language.  It is never built whole:

1. Vertical partitioning.  A pass over the texts counts word and word-pair
   prefixes in chunks and reports those that are frequent in a chunk.  A word
   whose sum passes the memory budget of a subtree is *extended*: its suffixes
   are told apart by their first two words, those of a pair that passes it by
   all three.  The report threshold is a fraction of the budget for each chunk,
   so a prefix over the budget cannot be missed.
2. Prefixes are dealt by hash into as many groups as the budget asks for.  A
   second pass sends every suffix, summed within a chunk, to its group: a row
   for each chunk and group, not for each suffix.
3. Each group sorts its suffixes into a depth-truncated subtree on its own; the
   count of a node is the sum of the leaves below it.  Only nodes of extended
   prefixes have leaves in several groups; their parts are summed afterwards.
4. Counts of the parts of a candidate are nodes again, found by two joins.

Counts of nodes below ``min_count`` are left out only where they are complete.
All candidates have parts at least as frequent as themselves, so nothing that a
score needs is missing.

Defined cases: null or empty texts have no words; words of any length; a null
language is ``und``; repeated rows count as they stand; ties rank by count, then
by the bytes of the phrase; an empty table gives an empty result; columns other
than text and language are not read.  Exact up to 5e15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, stored

# Ends of pieces, A-Z and tabs; 0xFF stands in no UTF-8 text.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
BUDGET = 2_000_000  # suffixes of a subtree
CHUNK = 500_000     # words summed at once in a task
BITS = 21           # a word number within a chunk; of which a chunk has at most 1.2 * CHUNK + 2
MASK = (1 << BITS) - 1
SUFFIX = "lang string, grp long, words binary, counts binary"


def tokens(text: str | None) -> list[bytes]:
    """Words, with 0xFF where a piece ends."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b"\xff", b" \xff ").split(b" ")


class Chunk:
    """Suffixes of a chunk of texts as packed word numbers, by language."""

    def __init__(self, size: int) -> None:
        self.size, self.step = size, max(1, size // 5)  # words of one text handled at once
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b"": -1, b"\xff": 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.words = 0

    def add(self, lang: str, text: str | None) -> Iterator[None]:
        """Takes a text in steps; stops (yields) whenever the chunk is full."""
        toks = tokens(text)
        for lo in range(0, len(toks), self.step):
            get = self.number.setdefault
            ids = np.array([get(w, len(self.number) - 1) for w in toks[lo:lo + self.step]], dtype=np.int64)
            ids, tail = ids[ids >= 0], []
            # the two words after the step end its last suffixes; empty tokens do not count
            for j in range(lo + self.step, len(toks)):
                if w := toks[j]:
                    tail.append(get(w, len(self.number) - 1))
                    if len(tail) == 2:
                        break
            n = len(ids)
            ids = np.concatenate([ids, np.array([*tail, 0, 0], dtype=np.int64)])
            a, b, c = ids[:n], ids[1:n + 1], ids[2:n + 2]
            key = a << 2 * BITS | b << BITS | np.where(b > 0, c, 0)
            key = key[a > 0]
            self.parts.setdefault(lang, []).append(key)
            self.words += n
            if self.words >= self.size:
                yield
                self.clear()

    def suffixes(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(language, distinct packed suffixes, their counts)."""
        for lang, parts in self.parts.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            if len(key):
                yield lang, key, n

    def spelled(self) -> np.ndarray:
        """Words by number; 0 is the empty word."""
        out = np.empty(len(self.number), dtype=object)
        for w, i in self.number.items():
            if i > 0:
                out[i] = w
        out[0] = b""
        return out[:max(self.number.values()) + 1]


def chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[Chunk]:
    chunk = Chunk(size)
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            for _ in chunk.add(lang, text):
                yield chunk
    if chunk.parts:
        yield chunk


def sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals of equal neighbours in sorted ``key``."""
    start = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, dtype=np.int64)
    return key[start], np.add.reduceat(n, start) if len(start) else n


def extended_prefixes(rows: DataFrame, budget: int, n_chunks: int, chunk: int) -> list[tuple[str, bytes]]:
    """(lang, prefix) of words and pairs whose suffixes would pass the budget;
    at most twice the words of the corpus divided by three quarters of it."""
    least = max(1, budget // (4 * n_chunks))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches, chunk):
            spelled = c.spelled()
            for lang, key, n in c.suffixes():
                out = []
                for shift in (2 * BITS, BITS):
                    k, m = sums(key >> shift, n)
                    for x, y in zip(k[m >= least].tolist(), m[m >= least].tolist()):
                        if shift == 2 * BITS:
                            out.append((lang, spelled[x], y))
                        elif x & MASK:
                            out.append((lang, spelled[x >> BITS] + b" " + spelled[x & MASK], y))
                yield pd.DataFrame(out, columns=["lang", "prefix", "n"])

    found = rows.mapInPandas(report, "lang string, prefix binary, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    return [(r.lang, bytes(r.prefix)) for r in found.filter(F.col("n") > 3 * budget // 4).collect()]


def dealt_suffixes(rows: DataFrame, extended: list[tuple[str, bytes]], groups: int, chunk: int) -> DataFrame:
    """(lang, grp, words, counts): the suffixes of a chunk that belong to a
    group, three words each, with their counts."""
    held = rows.sparkSession.sparkContext.broadcast(set(extended))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks(batches, chunk):
            spelled = c.spelled()
            for lang, key, n in c.suffixes():
                salt = crc32(lang.encode())
                hashed = np.fromiter((crc32(w, salt) for w in spelled), dtype=np.uint64, count=len(spelled))
                a, b, d = key >> 2 * BITS, key >> BITS & MASK, key & MASK
                one = np.fromiter(((lang, w) in held.value for w in spelled), dtype=bool, count=len(spelled))[a]
                h = hashed[a]
                h = np.where(one, h * np.uint64(0x9E3779B97F4A7C15) ^ hashed[b], h)
                if one.any():
                    pairs, back = np.unique(key[one] >> BITS, return_inverse=True)
                    two = np.fromiter(((lang, spelled[p >> BITS] + b" " + spelled[p & MASK]) in held.value for p in pairs.tolist()), dtype=bool, count=len(pairs))
                    at = np.flatnonzero(one)[two[back]]
                    h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[d[at]]
                grp = ((h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)) % np.uint64(groups)
                by = np.argsort(grp, kind="stable")
                edge = np.concatenate([np.flatnonzero(np.diff(grp[by].astype(np.int64), prepend=-1)), [len(by)]])
                flat = np.stack([a, b, d], axis=1)[by]
                n32 = n[by].astype("<i8")
                out = []
                for i, j in zip(edge, edge[1:]):
                    out.append((lang, int(grp[by[i]]), b"\xff".join(spelled[flat[i:j].ravel()].tolist()), n32[i:j].tobytes()))
                yield pd.DataFrame(out, columns=["lang", "grp", "words", "counts"])

    return rows.mapInPandas(deal, SUFFIX)


def subtree_nodes(dealt: DataFrame, extended: list[tuple[str, bytes]], min_count: int) -> DataFrame:
    """(lang, phrase, n): node counts of the subtrees, a null phrase for the root."""
    held = dealt.sparkSession.sparkContext.broadcast(set(extended))

    def grow(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {b"": 0}
        ids, counts = [], []
        for words, n in zip(table["words"], table["counts"]):
            get = number.setdefault
            ids.append(np.array([get(w, len(number)) for w in words.as_py().split(b"\xff")], dtype=np.int64))
            counts.append(np.frombuffer(n.as_py(), dtype="<i8"))
        lang = table["lang"][0].as_py()
        leaf, n = np.concatenate(ids).reshape(-1, 3), np.concatenate(counts)
        order = np.lexsort((leaf[:, 2], leaf[:, 1], leaf[:, 0]))
        leaf, n = leaf[order], n[order]
        spelled = list(number)
        phrase, count = [None], [int(n.sum())]
        change = np.zeros(len(n), dtype=bool)
        for depth in (1, 2, 3):
            change[0] = True
            change[1:] |= leaf[1:, depth - 1] != leaf[:-1, depth - 1]
            start = np.flatnonzero(change)
            total = np.add.reduceat(n, start)  # a node's count is the sum of its leaves
            full = leaf[start, depth - 1] > 0
            often = full & (total >= min_count)
            if depth < 3 and held.value:  # extended: other groups hold leaves of it too
                for i in np.flatnonzero(full & ~often):
                    if (lang, b" ".join(spelled[x] for x in leaf[start[i], :depth])) in held.value:
                        often[i] = True
            phrase += [b" ".join([spelled[x] for x in row]) for row in leaf[start[often], :depth].tolist()]
            count += total[often].tolist()
        return pa.table({"lang": pa.array([lang] * len(count), pa.string()), "phrase": pa.array(phrase, pa.binary()), "n": pa.array(count, pa.int64())})

    nodes = dealt.groupBy("lang", "grp").applyInArrow(grow, "lang string, phrase binary, n long")
    return nodes.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, min_count: int = 10, inside: int = 50, first: int = 2000, lang_col: str = "lang", text_col: str = "text",
         budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of every
    language.  ``inside``: a phrase goes where a longer candidate around it has
    at least this percentage of its count."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chars, tasks = rows.withColumn("task", F.spark_partition_id()).agg(F.sum(F.length("text")), F.count_distinct("task")).first()
    words = (chars or 0) // 2 + 1  # at most
    extended = extended_prefixes(rows, budget, words // chunk + tasks + 1, chunk)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // budget))
    nodes = stored(subtree_nodes(dealt_suffixes(rows, extended, groups, chunk), extended, min_count))

    often = nodes.filter(F.col("phrase").isNotNull() & (F.col("n") >= min_count))
    size = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" ")))).cast("int") + 1
    cand = often.withColumn("size", size).filter("size > 1").withColumnRenamed("n", "a")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    left = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("left", left).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    part = often.withColumnRenamed("n", "of_part")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("of_part").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("of_part").alias("r")), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("num", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a")).withColumn("den", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # the most frequent longer candidate around a phrase
    within = cand.filter("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))

    total = nodes.filter("phrase is null").select("lang", F.col("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    top = kept.withColumn("rank", place).filter(F.col("rank") <= first)
    return top.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


