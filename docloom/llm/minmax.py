"""Near-duplicates by min-max hashing.

Each document's set of word shingles is hashed once; every permutation gives
both its minimum and its maximum, so a signature of 2 x p values costs p hash
evaluations and its matches are unbiased estimates of the Jaccard similarity
with less variance.  Bands of the signature make candidate buckets (a pair at
0.8 escapes all 40 bands of 5 with probability 1.2e-7), and links are confirmed
on the full sets.

A group of copies never becomes a list of pairs.  Equal sets collapse to one
class.  In each bucket every class is first compared with one hub only, the
class with the most copies.  What the confirmed links connect needs no further
comparison; what stays outside its hub's main component is tested against the
others under that hub inside a join, by a bound on the symmetric difference, and
only pairs that can reach the threshold leave it to be confirmed.

Defined cases: null or empty texts and texts without words have no shingles and
link with nothing; one word is a shingle of its own; equal sets link; ids may be
negative; rows that share an id are documents of their own, so equal rows link
and each is returned; a row with a null id is kept and links with nothing (in
``deduplicate`` it links too); an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docloom.llm.common import aside, cut, small_batches, with_small
from docloom.llm.components import components

PERMUTATIONS = 100
BAND = 5
PERCENT = 80
SKETCH = 4096  # bits
BLOCK = 256  # shingles permuted at once: their values stay in the cache
NAME = "struct<no_id:boolean,id:bigint,key:binary>"
ODD = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a text of
    fewer words is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    n = min(size, len(w))
    out = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j:len(h) - n + 1 + j])
    return np.unique(out)


def parities(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class MinMax:
    def __init__(self, permutations: int = PERMUTATIONS, band: int = BAND, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.mul = r.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = r.integers(0, 2**63, permutations, dtype=np.uint64)
        self.band = band
        self.room = np.empty((BLOCK, permutations), dtype=np.uint64)

    def bands(self, h: np.ndarray) -> np.ndarray:
        """One 64-bit key per band: bands of minima, then bands of maxima."""
        x = (h >> np.uint64(32)) | (h << np.uint64(32))  # high bits of a product depend on all bits below
        low, high = np.full(len(self.mul), 2**64 - 1, dtype=np.uint64), np.zeros(len(self.mul), dtype=np.uint64)
        for k in range(0, len(x), BLOCK):
            part = x[k:k + BLOCK, None]
            p = np.multiply(part, self.mul, out=self.room[:len(part)])
            p += self.add
            np.minimum(low, p.min(0), out=low)
            np.maximum(high, p.max(0), out=high)
        v = np.concatenate([low, high]).reshape(-1, self.band)
        key = np.arange(len(v), dtype=np.uint64)
        for j in range(self.band):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
        return key


def signatures(docs: DataFrame, size: int, permutations: int, band: int, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands); ``set_key`` names the set.  With
    ``named`` the column ``name`` of ``docs`` is carried along."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mm = MinMax(permutations, band)
        for b in batches:
            n, key, bands = [], [], []
            for t in b["text"]:
                h = shingle_hashes(t, size)
                n.append(len(h))
                key.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bands.append(mm.bands(h).view(np.int64).tolist() if len(h) else [])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": n, "set_key": key, "bands": bands} | ({"name": b["name"]} if named else {}))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *(["name"] if named else []))
    return rows.mapInPandas(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>" + (f", name {NAME}" if named else ""))


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(set_key, s, sketch): full sets as sorted longs, and the parities of
    their members in ``SKETCH`` cells."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [shingle_hashes(t, size) for t in b["text"]]
            yield pd.DataFrame({"set_key": [xxhash.xxh3_128_digest(h.tobytes()) for h in s], "s": [h.view(np.int64) for h in s],
                                "sketch": [parities(h) for h in s]})

    return docs.select("text").mapInPandas(sets, "set_key binary, s array<long>, sketch array<long>")


@F.pandas_udf(IntegerType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sizes of the intersections of two columns of distinct longs."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int32")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent``."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    x = x.withColumn("i", shared("sa", "sb")).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    return x.filter(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def links(docs: DataFrame, size: int = 2, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND,
          named: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): ``rows`` (doc_id, n_shingles, set_key);
    ``classes`` (set_key, node, rep, copies, n), one per different set, ``rep``
    its least id; ``links`` (a, b) between nodes, enough to connect every
    component.  With ``named``, ``rows`` carry ``name`` and ``classes`` their
    least one."""
    sig = cut(signatures(docs, size, permutations, band, named))
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"),
                                            F.first("bands").alias("bands"), *([F.min("name").alias("name")] if named else []))  # equal sets have equal bands
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by the checkpoint
    member = classes.select(F.col("node").alias("x"), "n", "copies", F.posexplode("bands").alias("band", "value"))
    # a bucket's hub: most copies, then least node; only buckets of two members or more
    hub = member.groupBy("band", "value").agg(F.max_by("x", F.struct("copies", -F.col("x"))).alias("hub"), F.count("*").alias("k"))
    hub = cut(hub.filter("k > 1").select("band", "value", "hub"))
    member = cut(member.select("band", "value", "x", "n").join(hub, ["band", "value"]))
    fits = lambda p, q: F.least(p, q) * 100 >= F.greatest(p, q) * percent
    hub_n = classes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    first = member.filter("x <> hub").select("x", "hub", "n").distinct().join(hub_n, "hub").filter(fits(F.col("n"), F.col("hub_n")))
    first = cut(first.select(F.col("x").alias("a"), F.col("hub").alias("b")))
    near = member.select(F.col("x").alias("node")).distinct().join(classes.select("node", "rep", "set_key"), "node")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(near.select("rep"), "rep", "left_semi")
    sets = shingle_sets(texts, size).join(near.select("set_key", "node"), "set_key").select("node", "s", "sketch").dropDuplicates(["node"])
    sets = cut(sets)
    found = cut(confirmed(first, sets, percent))
    # What is left: members under one hub in different components.  All but the
    # hub's main component look for partners; a pair whose parity sketches differ
    # in more bits than the sets may differ in members cannot link, exactly.
    comp = components(found).select(F.col("node").alias("x"), "root")
    under = member.select("hub", "x", "n").distinct().join(comp, "x", "left").withColumn("root", F.coalesce("root", "x"))
    main = under.groupBy("hub", "root").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("k"))
    left = under.join(main.filter("k > 1").select("hub", "main"), "hub").join(sets.select(F.col("node").alias("x"), "sketch"), "x")
    left = cut(left.select("hub", "x", "n", "root", "sketch", (F.col("root") == F.col("main")).alias("in_main")))
    p, q = left.filter("not in_main").alias("p"), left.alias("q")
    differ = sum((F.bit_count(F.col("p.sketch")[i].bitwiseXOR(F.col("q.sketch")[i])) for i in range(1, SKETCH // 64)),
                 F.bit_count(F.col("p.sketch")[0].bitwiseXOR(F.col("q.sketch")[0])))
    both = F.col("p.n") + F.col("q.n")
    pairs = p.join(q, (F.col("p.hub") == F.col("q.hub")) & (F.col("p.root") != F.col("q.root")) & (F.col("q.in_main") | (F.col("p.x") < F.col("q.x")))
                   & fits(F.col("p.n"), F.col("q.n")) & (differ * (100 + percent) <= both * (100 - percent)))
    pairs = pairs.select(F.col("p.x").alias("a"), F.col("q.x").alias("b")).distinct()
    seen = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = confirmed(cut(pairs.join(seen, ["a", "b"], "left_anti")), sets, percent)
    return sig.drop("bands"), classes.drop("bands"), cut(found.unionByName(more))


def near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    rows, classes, found = links(docs, **kw)
    named = classes.select("set_key", "node", "rep").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(least, "root").select("set_key", "component_id"))
    out = rows.join(named, "set_key", "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, one_row: bool = False, **kw) -> DataFrame:
    """Stage: one document of each group stays, the one of the least id, of
    equal ids the one of the least text key; rows without an id come last.
    With ``one_row`` exactly one row of each group stays, of repeated rows the
    first stored.  Otherwise a document is what its id names: all rows of the
    group's least id stay, and rows without an id stay.  Rows are told apart by
    id and text, so a row of the same id in another group is left alone."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text").cast("binary")))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("bigint").alias("id"), key.alias("key"))
    rows, classes, found = links(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text", name.alias("name")), named=True, **kw)
    named = classes.select("set_key", "node", "name").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.join(named.groupBy("root").agg(F.min("name").alias("least")), "root").select("set_key", "least"))
    rows = rows.join(named, "set_key").select("name", "least")
    stays = F.col("name.key") == F.col("least.key") if one_row else F.col("name.no_id") | F.coalesce(F.col("name.id") == F.col("least.id"), F.lit(False))
    rows = cut(rows.groupBy(F.col("name.key").alias("_key"), stays.alias("stays")).agg(F.count("*").alias("k")).filter("not stays or k > 1"))
    named, back = aside(docs, "doc_id", "text")
    keyed = named.withColumn("_key", key)
    if not one_row:
        return back(keyed.join(rows.filter("not stays"), "_key", "left_anti"))
    # rows repeated under the id and text that stay: the first stored one
    again = with_small(keyed.withColumn("_at", F.monotonically_increasing_id()), rows.filter("stays").select("_key"), ["_key"], "left_semi")
    again = again.groupBy("_key").agg(F.min_by(F.struct(*named.columns), "_at").alias("_row")).select("_row.*")
    return back(keyed.join(rows, "_key", "left_anti").select(named.columns).unionByName(again))
