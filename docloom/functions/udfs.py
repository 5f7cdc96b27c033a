"""The few per-row helpers Spark has no builtin for (Arrow batches)."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, LongType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(DecimalType(20, 0))
def blake2b_hash64(value: pd.Series, seed: pd.Series) -> pd.Series:
    """Unsigned 64-bit BLAKE2b of ``seed:value``."""
    from decimal import Decimal

    def one(v: str, s: int) -> Decimal:
        return Decimal(int(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).hexdigest(), 16))

    return pd.Series([one(v, s) for v, s in zip(value, seed)])


@F.pandas_udf(ArrayType(IntegerType()))
def joined_starts(sizes: pd.Series) -> pd.Series:
    """Where words of these sizes begin when joined by single spaces."""
    return sizes.map(lambda n: None if n is None else (np.cumsum(n + 1) - n - 1).astype(np.int32))


def relaxed(pattern: str) -> str | None:
    """An RE2 pattern found in every text that ``pattern`` (Java) is found in: the same
    without word boundaries and line ends.  None where it holds more than literals,
    classes, groups, alternatives and repeats."""
    fold = pattern.startswith("(?i)")
    out, inside = ["(?i)"] if fold else [], False
    for t in re.findall(r"\\.|\(\?:|\(\?|\[\^|.", pattern[4 * fold:], re.S):
        if t in (r"\b", r"\B") and not inside or t in "^$" and not inside:
            continue
        if t == r"\s":  # Java's holds the vertical tab, RE2's does not
            t = r"\s\x0b" if inside else r"[\s\x0b]"
        elif t in ("(?", "[^") or inside and t in "[&" or len(t) == 2 and t[1].isalnum() and t not in (r"\d", r"\w"):
            return None
        inside = t == "[" or inside and t != "]"
        out.append(t)
    try:
        pc.match_substring_regex(pa.array([""]), "".join(out))
    except pa.ArrowInvalid:
        return None
    return "".join(out)


TEST_BITS, TEST_BLOCK = 62, 8


def may_match(tests: Sequence[tuple[int, str]]) -> Callable[..., Column]:
    """A function of text columns that gives a bit for each test (number of a column,
    RE2 pattern), ``TEST_BITS`` to a long: whether the pattern is found in that
    column.  A pass over the batch for each block of patterns, whatever alternatives
    they have, and one for each of them over the rows that passed; a batch with text
    that is no UTF-8 has all bits set."""
    order = sorted(range(len(tests)), key=lambda i: tests[i][0])
    blocks = [[i for i in order[k:k + TEST_BLOCK] if tests[i][0] == c] for k in range(0, len(order), TEST_BLOCK) for c in sorted({tests[i][0] for i in order[k:k + TEST_BLOCK]})]

    @F.arrow_udf(ArrayType(LongType()))
    def bits(*cols: pa.Array) -> pa.Array:
        n, longs = len(cols[0]), -(-len(tests) // TEST_BITS)
        got = np.zeros((n, longs), dtype=np.int64)
        try:
            for c in cols:
                c.validate(full=True)
        except pa.ArrowInvalid:
            got[:] = (1 << TEST_BITS) - 1
        else:
            for block in blocks:
                col = cols[tests[block[0]][0]]
                some = np.flatnonzero(pc.match_substring_regex(col, "|".join(f"(?:{tests[i][1]})" for i in block)).fill_null(False))
                part = col.take(pa.array(some))
                for i in block:
                    got[some, i // TEST_BITS] |= np.asarray(pc.match_substring_regex(part, tests[i][1])).astype(np.int64) << (i % TEST_BITS)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * longs, pa.int32()), pa.array(got.ravel()))

    return bits


def has_bit(bits: Column, i: int) -> Column:
    return F.get(bits, F.lit(i // TEST_BITS)).bitwiseAND(F.lit(1 << i % TEST_BITS)) != 0


def _cover(positions) -> int | None:
    """Width of the smallest window holding one position of every list."""
    if positions is None or len(positions) < 2:
        return None
    pos = np.concatenate([np.asarray(p, dtype=np.int64) for p in positions])
    term = np.repeat(np.arange(len(positions)), [len(p) for p in positions])
    order = np.argsort(pos, kind="stable")
    pos, term = pos[order], term[order]
    # last position of every term at or before each position
    last = np.full((len(positions), len(pos)), -1, dtype=np.int64)
    last[term, np.arange(len(pos))] = pos
    np.maximum.accumulate(last, axis=1, out=last)
    low = last.min(axis=0)
    return int((pos - low + 1)[low >= 0].min())


@F.pandas_udf(IntegerType())
def min_cover_span(positions: pd.Series) -> pd.Series:
    """Minimal covering span of per-term position lists."""
    return positions.map(_cover).astype("Int32")


GRAM_BYTES = 2**20  # line bytes counted at once


def _gram_counts(lines: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(unit, gram, count) of ASCII lines, by unit: grams as numbers of one byte per
    character, so counting is one sort."""
    flat = lines.flatten()
    unit_of_line = np.repeat(np.arange(len(lines)), np.asarray(lines.value_lengths()))
    size = np.asarray(pc.binary_length(flat), dtype=np.int64)
    text = np.frombuffer(b"".join(x.as_buffer() for x in flat), dtype=np.uint8).astype(np.int64)
    line = np.repeat(np.arange(len(size)), size)
    units, codes, grams = [], [], []
    for n in range(lo, hi + 1):
        m = max(len(text) - n + 1, 0)
        code = np.zeros(m, dtype=np.int64)
        for i in range(n):
            code = (code << 8) | text[i:i + m]
        inside = line[:m] == line[n - 1:n - 1 + m]
        units.append(unit_of_line[line[:m][inside]])
        codes.append(code[inside])
    for part in codes:
        grams.append(np.unique(part))
    distinct = np.concatenate(grams)  # shorter grams are smaller numbers
    number = np.searchsorted(distinct, np.concatenate(codes))
    key, count = np.unique(np.concatenate(units) * max(len(distinct), 1) + number, return_counts=True)
    names = [v.tobytes().decode() for g, n in zip(grams, range(lo, hi + 1)) for v in g.astype(">i8").view(np.uint8).reshape(-1, 8)[:, 8 - n:]]
    return key // max(len(distinct), 1), pa.array(names, pa.string()).take(pa.array(key % max(len(distinct), 1))), count


def char_gram_counts(units: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """(doc_idx, grams, tfs) of units with ASCII ``lines``: the character n-grams
    inside a line and how often a unit has them.  Nothing is exploded or shuffled."""
    schema = StructType([units.schema["doc_idx"], StructField("grams", ArrayType(StringType())), StructField("tfs", ArrayType(LongType()))])
    out = to_arrow_schema(schema)

    def step(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            sizes = np.array([sum(len(s) for s in u) for u in whole.column(1).to_pylist()])
            piece = np.cumsum(sizes) // GRAM_BYTES
            for p in np.unique(piece):
                lo_row, hi_row = np.searchsorted(piece, [p, p + 1])
                b = whole.slice(lo_row, hi_row - lo_row)
                unit, gram, count = _gram_counts(b.column(1), lo, hi)
                offsets = pa.array(np.searchsorted(unit, np.arange(b.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, v).cast(f.type) for v, f in zip((gram, pa.array(count)), list(out)[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], schema=out)

    return units.select("doc_idx", "lines").mapInArrow(step, schema)
