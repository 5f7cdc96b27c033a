"""Exact repeats of long byte strings, by hash anchors.

Hash anchors stand in for suffix order and longest-previous-factor arrays,
neither of which is built.  Every window of ``length`` bytes is assigned to an
anchor, the least hash of the ``gram``-byte strings inside it, so equal windows
have equal anchors at equal offsets and meet in one group.  A group sorts the
64-bit hashes of its windows, so that equal ones are neighbours; that order says
nothing else.  ``remove(keep="first")`` also finds the least (document, row,
byte) of each repeated window, its earlier match.

1. Anchors of all texts are hashed and counted; those met twice enter a Bloom
   filter of fixed size (a fuller filter only lets more candidates through).
2. A second map cuts the context of each candidate anchor: the bytes of all
   windows assigned to it.  Equal contexts collapse.
3. Groups of one anchor order the hashes of their windows.  A group of more than ``HOT``
   contexts is not gathered: slices of its windows, then windows, go by their
   own hash through aggregates that combine before the shuffle.
4. Repeated windows of a text become byte ranges, keyed by the text's digest.

Defined cases: null or empty texts have no bytes; shorter texts have no window;
equal texts and repeated rows repeat each other whole; overlapping copies count;
matches never cross documents; an empty table gives an empty result; extra
columns are kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import aside, cut, small_batches, stored

LENGTH = 400
GRAM = 128
HOT = 192
SLICE = 32
BLOOM_BITS = 27  # 16 MB
PIECE = 1 << 19  # bytes of a text handled at once; addresses in a key take 20 bits
_R = np.random.default_rng(5)
BYTE = _R.integers(0, 2**64, 256, dtype=np.uint64)
P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Rolling:
    """Hashes of all substrings of one length, by prefix sums modulo 2^64."""

    def __init__(self) -> None:
        self.n = 0

    def __call__(self, b: np.ndarray, size: int) -> np.ndarray:
        if len(b) + 1 > self.n:
            self.n = max(2 * len(b), 1 << 14)
            self.pow, self.inv = _powers(P, self.n), _powers(P_INV, self.n)
        s = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(BYTE[b] * self.pow[:len(b)], out=s[1:])
        h = (s[size:] - s[:-size]) * self.inv[:len(b) - size + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(x) - w + 1
    pad = np.full(-len(x) % w, np.iinfo(np.uint64).max, dtype=np.uint64)
    y = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1:w - 1 + n])


class Anchors:
    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.w, self.roll = length, gram, length - gram + 1, Rolling()

    def __call__(self, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(hash, position, first window, last window) of the anchors of a
        text, in pieces that overlap by a window less one byte."""
        for lo in range(0, max(len(b) - self.length + 1, 0), PIECE):
            part = b[lo:lo + PIECE + self.length - 1]
            if len(part) < self.length:
                return
            h = self.roll(part, self.gram)
            key = h & ~np.uint64((1 << 20) - 1) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is least
            at = (sliding_min(key, self.w) & np.uint64((1 << 20) - 1)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            end = np.concatenate([start[1:], [len(at)]]) - 1
            yield h[at[start]], at[start] + lo, start + lo, end + lo


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeated_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h): hashes of anchors met more than once."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Anchors(length, gram)
        for b in batches:
            got = [h for t in b["text"] for h, *_ in find(np.frombuffer(as_bytes(t), dtype=np.uint8))]
            v, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pd.DataFrame({"h": v.view(np.int64), "n": np.minimum(n, 2).astype(np.int32)})

    return docs.select("text").mapInPandas(scan, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def bloom(hashes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bit words of a filter with two probes; at most 2^(bits - 6) rows reach the driver."""
    mask = (1 << bits) - 1
    probes = F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))
    rows = hashes.select(F.explode(probes).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("v"))
    got = rows.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint64)


def in_bloom(words: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)

    def one(p: np.ndarray) -> np.ndarray:
        return words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1) != 0

    return one(h & mask) & one(h >> np.uint64(32) & mask)


def contexts(docs: DataFrame, words: np.ndarray, length: int, gram: int, bits: int, ordered: bool = False) -> DataFrame:
    """(text_key, h, ctx_key, first, off, ctx): candidate anchors with the bytes of
    their windows.  ``ordered`` carries the place (doc, row) of the text."""
    place = ["doc", "row"] if ordered else []
    held = docs.sparkSession.sparkContext.broadcast(words)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, filt = Anchors(length, gram), held.value
        for b in batches:
            out = []
            for t, *at_row in zip(b["text"], *(b[c] for c in place)):
                raw = as_bytes(t)
                if len(raw) < length:
                    continue
                key = hashlib.md5(raw).digest()
                for h, at, first, last in find(np.frombuffer(raw, dtype=np.uint8)):
                    ok = in_bloom(filt, h, bits)
                    for x, p, f, e in zip(h[ok].view(np.int64).tolist(), at[ok].tolist(), first[ok].tolist(), last[ok].tolist()):
                        ctx = raw[f:e + length]
                        out.append((key, x, hashlib.blake2b(ctx, digest_size=12, salt=(p - f).to_bytes(4, "big")).digest(), f, p - f, ctx, *at_row))
            yield pd.DataFrame(out, columns=["text_key", "h", "ctx_key", "first", "off", "ctx", *place])

    return docs.select("text", *place).mapInPandas(scan, "text_key binary, h long, ctx_key binary, first int, off int, ctx binary" + "".join(f", {c} long" for c in place))


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def ordered_repeats(group: pd.DataFrame, length: int, roll: Rolling) -> list[list[list[int]]]:
    """Per context of one anchor: the runs of window starts that another context
    of the group holds too.  Windows are sorted by offset and hash; a window
    repeats if its neighbour before or after is equal."""
    offs, keys, owner = [], [], []
    for i, (ctx, off) in enumerate(zip(group["ctx"], group["off"])):
        h = roll(np.frombuffer(ctx, dtype=np.uint8), length)
        keys.append(h)
        offs.append(np.arange(len(h)) - off)
        owner.append(np.full(len(h), i))
    key, off, own = np.concatenate(keys), np.concatenate(offs), np.concatenate(owner)
    order = np.lexsort((key, off))
    same = (key[order][1:] == key[order][:-1]) & (off[order][1:] == off[order][:-1])
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    ends = np.cumsum([0, *map(len, keys)])
    return [_runs(twice[a:b] | (n > 1)) for a, b, n in zip(ends, ends[1:], group["n"])]


def slice_udf(length: int):
    @F.pandas_udf("array<struct<s:int,core:long,whole:long,i:int,v:array<long>>>")
    def slices(c: pd.Series, off: pd.Series) -> pd.Series:
        roll = Rolling()

        def one(x, o):
            raw = np.frombuffer(x, dtype=np.uint8)
            v, core = roll(raw, length), roll(raw, length - SLICE + 1)
            at = np.arange(len(v)) - o  # offsets from the anchor; slices start at multiples of SLICE
            out = []
            for s in range(int(at[0]) // SLICE, int(at[-1]) // SLICE + 1):
                i, j = max(0, s * SLICE + o), min(len(v), (s + 1) * SLICE + o)
                part = v[i:j] * np.uint64(2) + at[i:j].astype(np.uint64)
                whole = hashlib.blake2b(part.tobytes(), digest_size=8, salt=(i - s * SLICE - o).to_bytes(4, "big")).digest()
                out.append({"s": s, "core": int(core[s * SLICE + o + SLICE - 1].view(np.int64)), "whole": int.from_bytes(whole, "big", signed=True), "i": i, "v": part.view(np.int64).tolist()})
            return out

        return pd.Series([one(x, o) for x, o in zip(c, off)], dtype=object)

    return slices


def repeated_windows(ctx: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(ctx_key, runs) of distinct contexts (ctx_key, h, off, n, ctx)."""
    size = ctx.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("m")).filter("m > 1")
    size = cut(size.select("h", "k"))
    schema = "ctx_key binary, runs array<array<int>>"

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, rest = Rolling(), None
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            open_ = b["h"] == b["h"].iloc[-1]  # the last group may go on
            rest = b[open_]
            out = [r for _, g in b[~open_].groupby("h", sort=False) for r in zip(g["ctx_key"], ordered_repeats(g, length, roll))]
            yield pd.DataFrame(out, columns=["ctx_key", "runs"])
        if rest is not None:
            yield pd.DataFrame({"ctx_key": rest["ctx_key"], "runs": ordered_repeats(rest, length, roll)})

    cold = ctx.join(size.filter(F.col("k") <= hot).select("h"), "h")
    cold = cold.repartition("h").sortWithinPartitions("h").mapInPandas(order, schema)

    # Hot anchors, by aggregates that combine before the shuffle.  The windows of
    # a slice share a core of bytes: a core met once rules them all out.  Slices
    # met twice repeat whole; only windows of the others are counted one by one.
    warm = ctx.join(size.filter(F.col("k") > hot).select("h"), "h")
    warm = cut(warm.select("ctx_key", "n", "h", F.explode(slice_udf(length)("ctx", "off")).alias("x")).select("ctx_key", "n", "h", "x.*"))
    cores = cut(warm.groupBy("h", "s", "core").agg(F.sum("n").alias("m")).filter("m > 1").select("h", "s", "core"))
    warm = warm.join(cores, ["h", "s", "core"], "left_semi")
    kinds = cut(warm.groupBy("h", "s", "whole").agg(F.sum("n").alias("m"), F.first("ctx_key").alias("ctx_key"), F.first("i").alias("i"), F.first("v").alias("v")))
    each = kinds.select("h", "m", "ctx_key", "i", F.posexplode("v").alias("p", "w"))
    twice = cut(each.groupBy("h", "w").agg(F.sum("m").alias("k")).filter("k > 1").select("h", "w"))
    single = each.filter("m = 1").join(twice, ["h", "w"], "left_semi").select("ctx_key", F.array(F.col("i") + F.col("p"), F.col("i") + F.col("p") + 1).alias("r"))
    whole = warm.join(kinds.filter("m > 1").select("h", "s", "whole"), ["h", "s", "whole"], "left_semi").select("ctx_key", F.array(F.col("i"), F.col("i") + F.size("v")).alias("r"))
    back = single.unionByName(whole).groupBy("ctx_key").agg(F.array_sort(F.collect_list("r")).alias("runs"))
    return cold.unionByName(back.select("ctx_key", "runs"))


def ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bits: int = BLOOM_BITS) -> DataFrame:
    """(text_key, lo, hi): byte ranges, per different text, that repeats cover."""
    small_batches(docs.sparkSession, 1000)
    words = bloom(repeated_anchors(docs, length, gram), bits)
    occ = stored(contexts(docs, words, length, gram, bits))
    ctx = stored(occ.groupBy("ctx_key").agg(F.first("h").alias("h"), F.first("off").alias("off"), F.count("*").alias("n"), F.first("ctx").alias("ctx")))
    runs = cut(repeated_windows(ctx, length, hot).filter(F.size("runs") > 0))
    at = occ.select("text_key", "ctx_key", "first").distinct().join(runs, "ctx_key")
    return at.select("text_key", F.explode("runs").alias("r"), "first").select(
        "text_key", (F.col("first") + F.col("r")[0]).alias("lo"), (F.col("first") + F.col("r")[1] - 1 + length).alias("hi"))


def earlier_windows(ctx: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(ctx_key, later, runs) of distinct contexts (ctx_key, h, off, n, ctx, doc,
    row, at), the last three the place of its first occurrence: runs of repeated
    windows that stand at their first place there, and (``later``) of windows
    another context holds at an earlier place."""
    size = cut(ctx.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("m")).filter("m > 1").select("h", "k"))
    schema = "ctx_key binary, later boolean, runs array<array<int>>"

    def told(g: pd.DataFrame, roll: Rolling) -> list[tuple]:
        rank = np.empty(len(g), dtype=np.int64)
        rank[np.lexsort((g["at"], g["row"], g["doc"]))] = np.arange(len(g))
        keys = [roll(np.frombuffer(c, dtype=np.uint8), length) for c in g["ctx"]]
        sizes = np.array([len(k) for k in keys])
        key, own = np.concatenate(keys), np.repeat(np.arange(len(g)), sizes)
        off = np.concatenate([np.arange(n) - o for n, o in zip(sizes, g["off"])])
        order = np.lexsort((rank[own], key, off))
        same = (key[order][1:] == key[order][:-1]) & (off[order][1:] == off[order][:-1])
        again, later = (g["n"].to_numpy() > 1)[own], np.zeros(len(key), dtype=bool)
        again[order[:-1]] |= same
        later[order[1:]] |= same
        ends = np.cumsum([0, *sizes])
        return [(c, late, r) for c, a, b in zip(g["ctx_key"], ends, ends[1:])
                for late, r in ((True, _runs(later[a:b])), (False, _runs((again & ~later)[a:b]))) if r]

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll, rest = Rolling(), None
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            open_ = b["h"] == b["h"].iloc[-1]  # the last group may go on
            rest = b[open_]
            yield pd.DataFrame([r for _, g in b[~open_].groupby("h", sort=False) for r in told(g, roll)], columns=["ctx_key", "later", "runs"])
        if rest is not None:
            yield pd.DataFrame(told(rest, roll), columns=["ctx_key", "later", "runs"])

    cold = ctx.join(size.filter(F.col("k") <= hot).select("h"), "h")
    cold = cold.repartition("h").sortWithinPartitions("h").mapInPandas(order, schema)
    # Hot anchors as in repeated_windows; the least place goes along as a minimum.
    place = F.struct("doc", "row", "at")
    warm = ctx.join(size.filter(F.col("k") > hot).select("h"), "h")
    warm = cut(warm.select("ctx_key", "n", "h", place.alias("place"), F.explode(slice_udf(length)("ctx", "off")).alias("x")).select("ctx_key", "n", "h", "place", "x.*"))
    cores = cut(warm.groupBy("h", "s", "core").agg(F.sum("n").alias("m")).filter("m > 1").select("h", "s", "core"))
    warm = warm.join(cores, ["h", "s", "core"], "left_semi")
    kinds = warm.groupBy("h", "s", "whole").agg(F.sum("n").alias("m"), F.min(F.struct("place", "ctx_key", "i", "v")).alias("f"))
    kinds = cut(kinds.select("h", "s", "whole", "m", "f.*"))
    each = kinds.select("h", "m", "place", "ctx_key", "i", F.posexplode("v").alias("p", "w"))
    least = cut(each.groupBy("h", "w").agg(F.sum("m").alias("k"), F.min("place").alias("least")).filter("k > 1").select("h", "w", "least"))
    one = each.join(least, ["h", "w"]).select("ctx_key", (F.col("place") != F.col("least")).alias("later"), F.array(F.col("i") + F.col("p"), F.col("i") + F.col("p") + 1).alias("r"))
    whole = warm.join(kinds.filter("m > 1").select("h", "s", "whole", F.col("ctx_key").alias("_f")), ["h", "s", "whole"]).filter("ctx_key <> _f")
    whole = whole.select("ctx_key", F.lit(True).alias("later"), F.array(F.col("i"), F.col("i") + F.size("v")).alias("r"))
    back = one.unionByName(whole).groupBy("ctx_key", "later").agg(F.array_sort(F.collect_list("r")).alias("runs"))
    return cold.unionByName(back)


def with_later_ranges(docs: DataFrame, id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bits: int = BLOOM_BITS) -> DataFrame:
    """``docs`` with ``_cut`` (lo, hi, later as 0 or 1): byte ranges of windows met
    earlier, and of the first places of repeated windows.  Places are ordered by
    ``id_col`` (null last), then stored row, then byte.  Equal texts collapse to
    their first row; the others are cut whole."""
    small_batches(docs.sparkSession, 1000)
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))  # written: the number stays
    place = F.struct(F.coalesce(F.col(id_col).cast("bigint"), F.lit(2**63 - 1)).alias("doc"), F.col("_row").alias("row"))
    some = rows.filter(F.octet_length("text") >= length)
    firsts = cut(some.groupBy(key.alias("text_key")).agg(F.min(place).alias("f")).select("text_key", "f.*"))
    texts = stored(some.select("text", F.col("_row").alias("row")).join(firsts.select("doc", "row"), "row"))
    occ = stored(contexts(texts, bloom(repeated_anchors(texts, length, gram), bits), length, gram, bits, ordered=True))
    at = F.struct("doc", "row", (F.col("first") + F.col("off")).alias("at"))
    ctx = occ.groupBy("ctx_key").agg(F.first("h").alias("h"), F.first("off").alias("off"), F.count("*").alias("n"), F.first("ctx").alias("ctx"), F.min(at).alias("place"))
    ctx = stored(ctx.select("ctx_key", "h", "off", "n", "ctx", "place.*"))
    seen = occ.select("text_key", "ctx_key", "first", F.length("ctx").alias("size"), at.alias("here")).join(ctx.select("ctx_key", F.struct("doc", "row", "at").alias("place")), "ctx_key")
    copies = seen.filter("here <> place").select("text_key", F.array("first", F.col("first") + F.col("size"), F.lit(1)).alias("c"))
    runs = cut(earlier_windows(ctx, length, hot))
    own = seen.filter("here = place").join(runs, "ctx_key").select("text_key", "first", F.col("later").cast("int").alias("l"), F.explode("runs").alias("r"))
    own = own.select("text_key", F.array(F.col("first") + F.col("r")[0], F.col("first") + F.col("r")[1] - 1 + length, F.col("l")).alias("c"))
    found = cut(copies.unionByName(own).groupBy("text_key").agg(F.collect_set("c").alias("_cut")))
    found = cut(firsts.select("text_key", F.col("row").alias("_first")).join(found, "text_key", "left"))
    out = rows.withColumn("text_key", key).join(found, "text_key", "left")
    whole = F.array(F.array(F.lit(0), F.octet_length("text"), F.lit(1)))
    return out.withColumn("_cut", F.when(F.col("_row") != F.col("_first"), whole).otherwise(F.col("_cut"))).drop("text_key", "_row", "_first")


def without(later: list, first: list) -> list[list[int]]:
    """Merged ranges ``later`` less the ranges ``first``."""
    out, keep = [], merged(first)
    for lo, hi in merged(later):
        for a, b in keep:
            if b > lo and a < hi:
                if a > lo:
                    out.append([lo, a])
                lo = max(lo, b)
        if lo < hi:
            out.append([lo, hi])
    return out


def merged(pieces: list) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(pieces):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def with_ranges(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with ``_cut``: byte ranges (lo, hi) that repeats cover, unmerged."""
    found = ranges(docs.select("text"), **kw).groupBy("text_key").agg(F.collect_set(F.array("lo", "hi")).alias("_cut"))
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    # written first: both sides are plain exchanges, so that a hot text can be split
    return docs.withColumn("text_key", key).join(cut(found), "text_key", "left").drop("text_key")


def remove(docs: DataFrame, keep: str = "none", **kw) -> DataFrame:
    """``docs`` with repeats cut from their texts; the rest of a cut character
    goes with it.  ``keep="first"`` leaves the first copy of every repeated
    window whole and cuts what was met earlier; ``"none"`` cuts all copies."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    ranged = with_later_ranges if keep == "first" else with_ranges

    @F.pandas_udf("string")
    def rest(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, c):
            if t is None or c is None:
                return t
            b, out, at = as_bytes(t), [], 0
            c = [list(x) for x in c]
            spans = without([x[:2] for x in c if x[2]], [x[:2] for x in c if not x[2]]) if keep == "first" else merged(c)
            for lo, hi in spans:
                out.append(b[at:lo])
                at = hi
            return b"".join([*out, b[at:]]).decode("utf-8", "ignore")
        return pd.Series([one(t, c) for t, c in zip(text, cuts)], dtype=object)

    named, back = aside(docs, "text", **({"doc_id": kw.pop("id_col", "doc_id")} if keep == "first" else {}))
    return back(ranged(named, **kw).withColumn("text", rest("text", "_cut")))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """The columns of the query."""
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    def told(text: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(text, cuts):
            b = as_bytes(t)
            spans = merged([list(x) for x in c]) if c is not None else []
            h, at = hashlib.sha256(), 0
            for lo, hi in spans:
                h.update(b[at:lo])
                at = hi
            h.update(b[at:])
            out.append((len(b), sum(hi - lo for lo, hi in spans), len(spans), h.hexdigest()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(docs.select("doc_id", "text"), **kw).select("doc_id", told("text", "_cut").alias("t")).select("doc_id", "t.*")
