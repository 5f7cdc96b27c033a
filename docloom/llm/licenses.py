"""Fuzzy search of short license notices: exact seeds, then bounded edits.

A notice of n characters may carry ``floor(n / chars_per_edit)`` edits.  Split
into one piece more than that, some piece stands unedited wherever the notice
does (pigeonhole).  All pieces of all notices are seeds of one multi-pattern
automaton that reads a text once; the neighbourhoods of the seeds found for a
notice, widened by its edits and merged, are the candidates, and the bounded-error
matching of the regex library verifies them and gives the spans.  No text is
shuffled and nothing but the notices is sent to the tasks.

A text is read as its words joined by single spaces, so line breaks and marks
inside a notice cost nothing; spans are reported in words and in code points of
the text itself.  All places without an edit are found, overlapping ones too;
those of a notice of ``BASE`` are base places.  Edited places are searched in what
these leave, leftmost first, and do not overlap others of their notice.

Defined cases: null or empty texts have no words and no places; long texts are
read whole; repeated rows count as they stand; repeated notices are one; an
empty table gives an empty result; columns other than id and text are not read
and not returned, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_batches
from docloom.llm.decontaminate import TABLE

# Fixed values of the contract: phrases and labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices of the method's own; all words in lower case, one space between.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
CHARS_PER_EDIT = 11


@dataclass
class Notice:
    text: str
    label: str
    edits: int
    base: bool

    def seeds(self) -> list[tuple[str, int]]:
        """(piece, offset): edits + 1 pieces of nearly equal length."""
        k, n = self.edits + 1, len(self.text)
        at = [n * i // k for i in range(k + 1)]
        return [(self.text[a:b], a) for a, b in zip(at, at[1:])]


def notices(base: dict[str, str], more: dict[str, str], chars_per_edit: int) -> list[Notice]:
    """The notices with their edits; those of no word are refused."""
    out = [Notice(t, label, len(t) // chars_per_edit, base.get(t) == label) for t, label in {**more, **base}.items()]
    if any(" ".join(split_words(n.text)[0]) != n.text or not n.text for n in out):
        raise ValueError("notices are lower-case words joined by single spaces")
    return out


def split_words(text: str) -> tuple[list[str], bytes]:
    flat = text.encode("utf-8", "surrogatepass").translate(TABLE)
    return [w.decode("utf-8", "surrogatepass") for w in flat.split()], flat


class Finder:
    """All places of the notices in a text of words joined by spaces."""

    def __init__(self, found: list[Notice]) -> None:
        self.notices = found
        self.seeds = ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(found):
            for piece, offset in n.seeds():
                of.setdefault(piece, []).append((i, offset))
        for piece, uses in of.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in found]

    def __call__(self, padded: str) -> Iterator[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in ``padded``, which begins and ends with a space."""
        near: dict[int, list[list[int]]] = {}
        exact: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.seeds.iter(padded):
            for i, offset in uses:
                n = self.notices[i]
                at = end + 1 - size - offset  # where an unedited notice would begin
                if offset == 0 and padded[at - 1] == " " and padded.startswith(n.text + " ", at):
                    exact.setdefault(i, []).append([at, at + len(n.text)])
                    yield i, at, at + len(n.text), 0
                # one character more on each side for the neighbouring spaces
                near.setdefault(i, []).append([max(0, at - n.edits - 1), min(len(padded), at + len(n.text) + n.edits + 1)])
        for i, spans in near.items():
            if self.notices[i].edits:
                for lo, hi in apart(merged(spans), merged(exact.get(i, []))):
                    for m in self.patterns[i].finditer(padded, lo, hi):
                        yield i, m.start(), m.end(), sum(m.fuzzy_counts)


def apart(spans: list[list[int]], exact: list[list[int]]) -> Iterator[tuple[int, int]]:
    """What the exact places leave of the candidate ``spans``."""
    for lo, hi in spans:
        for a, b in exact:
            if lo < b and a < hi:
                yield lo, a
                lo = b
        if lo < hi:
            yield lo, hi


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def word_spans(text: str, words: list[str], flat: bytes, asked: set[int]) -> dict[int, tuple[int, int]]:
    """Code-point ranges in ``text`` of the words with the ``asked`` numbers."""
    out, raw, at, chars, seen = {}, text.encode("utf-8", "surrogatepass"), 0, 0, 0
    for i, w in enumerate(words):
        b = w.encode("utf-8", "surrogatepass")
        at = flat.index(b, at)
        if i in asked:
            chars += len(raw[seen:at].decode("utf-8", "surrogatepass"))
            seen = at
            out[i] = (chars, chars + len(w))
        at += len(b)
    return out


def scan(docs: DataFrame, base: dict[str, str] | None = None, more: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places): for every row the places of notices in order:
    label, notice, edits, base, first word, words, start and end (code points,
    end exclusive)."""
    small_batches(docs.sparkSession)
    known = notices(BASE if base is None else base, NOTICES if more is None else more, chars_per_edit)
    kind = docs.schema[id_col].dataType.simpleString()
    place = "struct<word:long,words:long,label:string,notice:string,edits:int,base:boolean,start:long,stop:long>"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(known)
        for b in batches:
            sizes, places = [], []
            for text in b["text"]:
                words, flat = ([], b"") if text is None else split_words(text)
                sizes.append(len(words))
                padded = f" {' '.join(words)} "
                hits, at, n = [], 0, 0
                for start, end, i, edits in sorted((s, e, i, d) for i, s, e, d in find(padded)):
                    n += padded.count(" ", at, start) if start > at else 0
                    at = max(at, start)
                    hits.append((n - 1, padded.count(" ", start, end) + 1, known[i], edits))
                ends = word_spans(text, words, flat, {w for f, k, *_ in hits for w in (f, f + k - 1)}) if hits else {}
                places.append([{"word": f, "words": k, "label": x.label, "notice": x.text, "edits": d, "base": x.base and d == 0, "start": ends[f][0], "stop": ends[f + k - 1][1]}
                               for f, k, x, d in hits])
            if sizes:
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": pd.array(sizes, dtype="int64"), "places": places})

    # ids go as text, so that none changes on the way through pandas
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(search, f"doc_id string, n_words long, places array<{place}>")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def digest(docs: DataFrame, **kw) -> DataFrame:
    """The columns of the query; the score is the largest share of a found
    notice that stands unedited, 0 without any."""
    base = F.filter("places", lambda p: p["base"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: 1 - p["edits"] / F.length(p["notice"])))
    return scan(docs, **kw).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["word"])).alias("first_word"), F.array_max(F.transform(base, lambda p: p["word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"))
