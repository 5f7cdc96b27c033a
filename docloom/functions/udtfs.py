"""Chunkers as table functions in SQL: ``select ... from docs, lateral fixed_tokens(text, 512, 0)``.

The DataFrame chunkers stay the fast path (built-in functions on a whole corpus);
these serve ad-hoc SQL over any table with a text column.  A null text gives no
rows, and so does a text without a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SPACE = re.compile("[ \t\n\r\f]+")
SPAN = "chunk_id bigint, start_index bigint, end_index bigint, text string"


@udtf(returnType=SPAN)
class FixedTokens:
    """Windows of ``size`` words that overlap by ``overlap``; a last window that the
    one before holds already is left out."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if size is None or size <= 0 or overlap is None or not 0 <= overlap < size:
            raise ValueError("size must be above 0 and overlap from 0 to below size")
        words = [w for w in SPACE.split(text or "") if w]
        for i, s in enumerate(range(0, len(words), size - overlap)):
            if s == 0 or s + overlap < len(words):
                e = min(s + size, len(words))
                yield i, s, e, " ".join(words[s:e])


@udtf(returnType=SPAN)
class WordLines:
    """Non-blank lines with their word positions."""

    def eval(self, text: str) -> Iterator[tuple]:
        at, n = 0, 0
        for line in (text or "").split("\n"):
            k = sum(1 for w in SPACE.split(line) if w)
            if k:
                yield n, at, at + k, line
                at, n = at + k, n + 1


TABLE_FUNCTIONS = {"fixed_tokens": FixedTokens, "word_lines": WordLines}


def register_table_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the chunkers callable in the session's SQL; returns their names."""
    for name, fn in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, fn)
    return [prefix + n for n in TABLE_FUNCTIONS]
