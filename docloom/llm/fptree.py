"""Ranked lexical search over a document FP-tree.

1. One pass over the texts keeps, of every document, its length and the counts
   of the terms that some item asks for (its restricted vector).
2. The kept terms of a document are ordered by document frequency, most frequent
   first, and the vectors are range-partitioned in that order: documents that
   begin alike meet in one task and share the paths of its tries.  The id is
   part of the range key, so a hot vector is split over tasks.
3. A task builds a trie over at most ``tree_rows`` vectors at a time.  A node
   stands for one path; unary chains are one node, small sibling subtrees share
   one.  Each node knows, for every term below it, the largest tf, and the least
   length measure m.  tf/(tf + m) grows with tf and falls with m, so these give
   an upper bound of every score below.
4. Each item walks the trie depth first, the child of the largest bound first,
   and leaves out what cannot beat its k-th best so far.  Equal bounds are still
   visited, as ties are decided by id.  The k best of each task meet in one
   ranking, of which Spark sends k rows of an item from each task at most.

Items are a stated query set: their terms are held by tasks in blocks of about
``block_terms`` (item, term) pairs, however many items there are.

Defined cases: null or empty texts have no terms and are no documents of N;
items without terms, or whose terms no document holds, get no rows; repeated
document rows are documents of their own; a document without an id ranks after
all others of its score; repeated item rows are items of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, stored
from docloom.llm.decontaminate import words

TREE_ROWS = 32_768
LEAF_ROWS = 128
BLOCK_TERMS = 500_000
NO_ID = 2**63 - 1


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(q, item_id), a row for each item row, and its distinct terms (q, term)."""
    rows = stored(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(q, w.decode("utf-8", "surrogatepass")) for q, t in zip(b["q"], b["text"]) for w in sorted(set(words(t)))]
            yield pd.DataFrame(out, columns=["q", "term"])

    return rows.select("q", "item_id"), stored(rows.select("q", "text").mapInPandas(split, "q long, term string"))


def vectors(docs: DataFrame, vocab: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): all documents with a term, of the block's terms
    their number in ``vocab`` and count."""
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def restrict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: i for i, w in enumerate(held.value)}
        for b in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, t in zip(b["doc_id"], b["text"]):
                w = words(t)
                if w:
                    c = Counter(w)
                    kept = c.keys() & number.keys()
                    ids.append(i)
                    sizes.append(len(w))
                    terms.append([number[x] for x in kept])
                    tfs.append([c[x] for x in kept])
            if ids:
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="int64"), "n": pd.array(sizes, dtype="int64"), "terms": terms, "tfs": tfs})

    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(restrict, "doc_id long, n long, terms array<int>, tfs array<int>")


def paths(vecs: DataFrame, rank: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(path, tf, m, doc_id): ranks in trie order as big-endian 32-bit numbers,
    whose bytes sort as the ranks do.  ``rank`` is -1 for terms of no weight."""
    held = vecs.sparkSession.sparkContext.broadcast(rank)

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = held.value
        for b in batches:
            out = []
            for i, n, terms, tfs in zip(b["doc_id"], b["n"], b["terms"], b["tfs"]):
                r = ranks[np.asarray(terms, dtype=np.int64)]
                at = np.argsort(r, kind="stable")
                at = at[r[at] >= 0]
                if len(at):
                    m = 100 - 50 + 50 * int(n) * n_docs // n_terms
                    out.append((r[at].astype(">u4").tobytes(), np.asarray(tfs)[at].astype(">u4").tobytes(), m, i))
            yield pd.DataFrame(out, columns=["path", "tf", "m", "doc_id"])

    return vecs.filter(F.size("terms") > 0).mapInPandas(order, "path binary, tf binary, m long, doc_id long")


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Tree:
    """Trie over vectors in path order; ``first[node]:last[node]`` are its rows."""

    def __init__(self, rows: list[tuple[bytes, bytes, int, int]], n_terms: int, leaf_rows: int) -> None:
        size = np.array([len(r[0]) // 4 for r in rows], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.term = np.frombuffer(b"".join(r[0] for r in rows), dtype=">u4").astype(np.int64)
        self.tf = np.frombuffer(b"".join(r[1] for r in rows), dtype=">u4").astype(np.int64)
        self.m = np.array([r[2] for r in rows], dtype=np.int64)
        self.doc = np.array([r[3] for r in rows], dtype=np.int64)
        self.size, self.leaf_rows = size, leaf_rows
        self.gain = part(self.tf, np.repeat(self.m, size))
        self.first, self.last, self.children = [0], [len(rows)], [[]]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            for lo, hi, deeper in self._split(self.first[node], self.last[node], depth):
                self.first.append(lo)
                self.last.append(hi)
                self.children.append([])
                self.children[node].append(len(self.first) - 1)
                if deeper is not None:
                    todo.append((len(self.first) - 1, deeper))
        self._bounds(n_terms)

    def _split(self, lo: int, hi: int, depth: int) -> list[tuple[int, int, int | None]]:
        """Row ranges of the children of a node, with the depth below which a
        child branches, None for those that are leaves."""
        if hi - lo <= self.leaf_rows:
            return []
        while True:
            has = self.size[lo:hi] > depth
            if not has.any():
                return []  # equal paths: a leaf, whatever their number
            head = np.where(has, self.term[np.minimum(self.at[lo:hi] + depth, len(self.term) - 1)], -1)
            cuts = np.flatnonzero(np.diff(head)) + 1
            if len(cuts):
                break
            depth += 1
        out: list[tuple[int, int, int | None]] = []
        edges = [lo, *(lo + cuts).tolist(), hi]
        for a, b in zip(edges, edges[1:]):
            if b - a > self.leaf_rows and head[a - lo] >= 0:
                out.append((a, b, depth + 1))
            elif out and out[-1][2] is None and b - out[-1][0] <= self.leaf_rows:
                out[-1] = (out[-1][0], b, None)  # small siblings share a node
            else:
                out.append((a, b, None))
        return out

    def _bounds(self, n_terms: int) -> None:
        """Per term the nodes that hold it and the bound of its part there."""
        nodes, terms, best = [], [], []
        for node, (a, b) in enumerate(zip(self.first, self.last)):
            t, tf = self.term[self.at[a]:self.at[b]], self.tf[self.at[a]:self.at[b]]
            by = np.argsort(t, kind="stable")
            start = np.flatnonzero(np.diff(t[by], prepend=-1))
            top = np.maximum.reduceat(tf[by], start)
            terms.append(t[by][start])
            best.append(part(top, self.m[a:b].min()))
            nodes.append(np.full(len(start), node))
        term = np.concatenate(terms)
        by = np.argsort(term, kind="stable")
        self.node, self.best = np.concatenate(nodes)[by], np.concatenate(best)[by]
        self.of_term = np.searchsorted(term[by], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, top: "Top") -> None:
        """Depth-first branch and bound of one item; ``dense`` holds its weights by term."""
        bound = np.zeros(len(self.first), dtype=np.int64)
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, b = self.of_term[t], self.of_term[t + 1]
            bound[self.node[a:b]] += w * self.best[a:b]  # a node stands once for each term
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] == 0 or bound[node] < top.least:
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            a, b = self.first[node], self.last[node]
            i, j = self.at[a], self.at[b]
            total = np.concatenate([[0], np.cumsum(dense[self.term[i:j]] * self.gain[i:j])])
            top.add(total[self.at[a + 1:b + 1] - i] - total[self.at[a:b] - i], self.doc[a:b])


class Top:
    """The k best (score, doc) so far: larger scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score, self.doc = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        ok = score >= self.least
        if not ok.any():
            return
        score, doc = np.concatenate([self.score, score[ok]]), np.concatenate([self.doc, doc[ok]])
        by = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[by], doc[by]
        if len(by) == self.k:
            self.least = max(1, int(self.score[-1]))


def best_of_tasks(path_rows: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, k: int, tree_rows: int, leaf_rows: int) -> DataFrame:
    """(q, doc_id, score): the k best of each task for each item."""
    held = path_rows.sparkSession.sparkContext.broadcast(asked)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, dense = held.value, np.zeros(n_terms, dtype=np.int64)
        tops = [Top(k) for _ in items]
        rows: list[tuple] = []
        last, same = None, 0

        def grow() -> None:
            tree = Tree(rows, n_terms, leaf_rows)
            for (_, terms, weights), top in zip(items, tops):
                dense[terms] = weights
                tree.search(terms, weights, dense, top)
                dense[terms] = 0
            rows.clear()

        for b in batches:
            for row in zip(b["path"], b["tf"], b["m"], b["doc_id"]):
                same = same + 1 if row[:3] == last else 0
                last = row[:3]
                if same < k:  # equal vectors score alike: their k least ids are all that can be listed
                    rows.append(row)
                if len(rows) >= tree_rows:
                    grow()
        if rows:
            grow()
        for (q, *_), top in zip(items, tops):
            if len(top.doc):
                yield pd.DataFrame({"q": np.full(len(top.doc), q, dtype=np.int64), "doc_id": top.doc, "score": top.score})

    return path_rows.mapInPandas(walk, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           block_terms: int = BLOCK_TERMS, tree_rows: int = TREE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    small_batches(docs.sparkSession)
    names, terms = item_terms(items, item_col)
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for block in range(blocks):
        some = terms.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        asked: dict[int, list[bytes]] = {}
        for r in some.collect():  # about block_terms rows
            asked.setdefault(r.q, []).append(r.term.encode("utf-8", "surrogatepass"))
        if not asked:
            continue
        vocab = sorted({t for ts in asked.values() for t in ts})
        vecs = stored(vectors(docs, vocab, id_col, text_col))
        n_docs, n_terms = vecs.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocab), dtype=np.int64)
        for r in vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row for each term of the block
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        live = np.flatnonzero((df > 0) & (weight > 0))
        order = live[np.argsort(-df[live], kind="stable")]
        rank = np.full(len(vocab), -1, dtype=np.int64)
        rank[order] = np.arange(len(order))
        number = {t: i for i, t in enumerate(vocab)}
        queries = []
        for q, ts in asked.items():
            ids = np.array([number[t] for t in ts])
            ids = ids[rank[ids] >= 0]
            if len(ids):
                queries.append((q, rank[ids], weight[ids]))
        if not queries:
            continue
        dealt = paths(vecs, rank, n_docs, n_terms).repartitionByRange("path", "doc_id").sortWithinPartitions("path", "tf", "m", "doc_id")
        hits = best_of_tasks(dealt, queries, len(order), k, tree_rows, leaf_rows)
        hits = stored(hits) if blocks > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "q long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    out = found.withColumn("rank", place).filter(F.col("rank") <= k).join(names, "q")
    return out.select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
