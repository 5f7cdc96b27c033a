"""Column builders for text: tokens, n-grams, set similarity, normalisation.

Everything here is a JVM-side expression, so it fuses into whatever stage uses
it.  ``tokens`` is the one definition of a term across the engine.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, a sentence end, a date.
TOKEN = "[a-zA-Z0-9]+"
SENTENCE_END = "([.!?])[ \\t\\n\\r\\f]+"
DATE = (
    "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
    "|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
)
NUMBER_UNIT = "([0-9]+(?:[.][0-9]+)?)[ \\t\\n\\r\\f]*([a-zA-Z/%]+)?"
UNIT_SEPARATOR = "\u001f"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text: str | Column) -> Column:
    """Lower-cased ASCII word tokens; null text gives an empty array."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: str | Column) -> Column:
    """Whitespace words in surface form: the token axis of the corpus."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), "[ \\t\\n\\r\\f]+")
    return F.filter(parts, lambda x: x != "")


def distinct_tokens(text: str | Column) -> Column:
    return F.array_distinct(tokens(text))


def word_ngrams(toks: Column, n: int) -> Column:
    """Contiguous n-token phrases joined by one space (n<=1 gives the tokens)."""
    if n <= 1:
        return toks
    # zip the array with its own shifted copies: one pass, no re-slicing
    shifted = [F.slice(toks, i + 1, F.greatest(F.size(toks) - n + 1, F.lit(0))) for i in range(n)]
    zipped = F.arrays_zip(*[s.alias(f"g{i}") for i, s in enumerate(shifted)])
    joined = F.transform(
        zipped, lambda z: F.concat_ws(" ", *[z.getField(f"g{i}") for i in range(n)])
    )
    return F.when(F.size(toks) >= n, joined).otherwise(F.array().cast("array<string>"))


def char_ngrams(toks: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of the space-joined token string.  A look-ahead match
    yields overlapping grams in one pass; a lambda over positions would rebuild
    the joined string for every position."""
    s = F.concat_ws(" ", toks)
    return F.concat(*[
        F.regexp_extract_all(s, F.lit("(?=(.{%d}))" % n), F.lit(1)) for n in range(lo, hi + 1)
    ])


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Set Jaccard over two token arrays; an empty side scores 0 (or
    ``both_empty`` when neither side has tokens)."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    inter, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(inter / union)
    )


def overlap(a: Column, b: Column) -> Column:
    """|A∩B| / |A| over distinct tokens, 0 when A is empty."""
    a = F.array_distinct(a)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(a)
    )


def f1(a: Column, b: Column) -> Column:
    """F1 of two token sets, 0 when they share nothing."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(a, b))
    p, r = inter / F.size(b), inter / F.size(a)
    return F.when(inter == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def sentences(text: str | Column, next_upper: bool = False) -> Column:
    """Split after sentence punctuation followed by whitespace.  With
    ``next_upper`` the next sentence has to start with A-Z."""
    pat = SENTENCE_END + "([A-Z])" if next_upper else SENTENCE_END
    rep = "$1" + UNIT_SEPARATOR + ("$2" if next_upper else "")
    return F.split(F.regexp_replace(F.trim(_c(text)), pat, rep), UNIT_SEPARATOR)


def normalize_space(text: str | Column) -> Column:
    """Runs of white space as one space.  Single spaces are not matched: they stay
    as they are, and a text that has no other is not searched by the pattern."""
    t = F.coalesce(_c(text), F.lit(""))
    other = reduce(or_, [F.contains(t, F.lit(x)) for x in ("  ", "\n", "\t", "\r", "\f")])
    return F.trim(F.when(other, F.regexp_replace(t, "[\\t\\n\\r\\f][ \\t\\n\\r\\f]*| [ \\t\\n\\r\\f]+", " ")).otherwise(t))


def lower_clean(text: str | Column) -> Column:
    return F.lower(normalize_space(text))


def normalize_heading(text: str | Column) -> Column:
    """Lower-case heading with trailing colons/dashes and leading numbering cut."""
    t = F.btrim(lower_clean(text), F.lit(" :-–—"))
    return F.trim(F.regexp_replace(t, "^[0-9]+[.)]*[ ]*", ""))


def repetition_key(text: str | Column) -> Column:
    """Header/footer key: page counters and short numbers become ``<n>``."""
    t = lower_clean(text)
    t = F.regexp_replace(t, "(?<![0-9a-z_])page [0-9]+ ?(of ?[0-9]+)?(?![0-9a-z_])", "page <n>")
    t = F.regexp_replace(t, "(?<![0-9a-z_])[0-9]+ ?/ ?[0-9]+(?![0-9a-z_])", "<n>/<n>")
    return F.regexp_replace(t, "(?<![0-9a-z_])[0-9]{1,4}(?![0-9a-z_])", "<n>")


def normalize_text(text: str | Column) -> Column:
    """Ligatures, zero-width and control characters, runs of blanks.  (Unicode
    NFC has no JVM-side builtin: see ``udfs.nfc``.)"""
    t = F.coalesce(_c(text), F.lit(""))
    for src, dst in (
        ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
        ("ﬃ", "ffi"), ("ﬄ", "ffl"), (" ", " "),
    ):
        t = F.replace(t, F.lit(src), F.lit(dst))
    t = F.regexp_replace(t, "[​‌‍﻿­]", "")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return F.regexp_replace(t, "[ \\t]+", " ")


def join_hyphenated(text: str | Column) -> Column:
    """Re-join words broken by a hyphen at a line end."""
    return F.regexp_replace(_c(text), "([A-Za-z])-\\n[ \\t]*([a-z])", "$1$2")


def iso_date(raw: str | Column) -> Column:
    """Normalise five date spellings to ISO text; unparsable input stays as is.
    For d/d/y the first number is a month when it is at most 12."""
    r = F.trim(_c(raw))
    iso = "^([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})$"
    num = "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})$"
    mdy = "^([A-Za-z]{3})[a-z]*[.]? ([0-9]{1,2}),? ([0-9]{4})$"
    dmy = "^([0-9]{1,2}) ([A-Za-z]{3})[a-z]*[.]?,? ([0-9]{4})$"

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(r, p, i).try_cast("int")

    def month(p: str, i: int) -> Column:
        at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(r, p, i)))
        return F.when((at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))

    def fmt(y: Column, m: Column, d: Column) -> Column:
        ok = m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))

    y = F.when(g(num, 3) < 100, g(num, 3) + 2000).otherwise(g(num, 3))
    a, b = g(num, 1), g(num, 2)
    return F.coalesce(
        F.when(r.rlike(iso), fmt(g(iso, 1), g(iso, 2), g(iso, 3))),
        F.when(r.rlike(num), F.when(a <= 12, fmt(y, a, b)).otherwise(fmt(y, b, a))),
        F.when(r.rlike(mdy), fmt(g(mdy, 3), month(mdy, 1), g(mdy, 2))),
        F.when(r.rlike(dmy), fmt(g(dmy, 3), month(dmy, 2), g(dmy, 1))),
        r,
    )


def magnitude_class(v: Column) -> Column:
    return (
        F.when(v < 1, "sub_unit").when(v < 10, "single_digit").when(v < 100, "tens")
        .when(v < 1000, "hundreds").otherwise("thousands_plus")
    )


def md5_hash60(value: Column, seed: Column | int) -> Column:
    """60-bit hash of ``seed:value`` (15 hex digits of MD5) as BIGINT.  Stands
    in for a 64-bit unsigned digest, which BIGINT cannot hold."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.md5(F.concat(seed.cast("string"), F.lit(":"), value))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
