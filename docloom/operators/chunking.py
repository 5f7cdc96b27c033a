"""Chunkers: document -> token spans.

Each chunker takes a Corpus and returns ``document_id, chunk_id, chunk_kind,
start_index, end_index, metadata``.  Fixed windows need no shuffle: they come
from the token count alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scores import range_join
from docloom.functions.text import sentences, words
from docloom.sources.corpus import Corpus

SPLIT_THRESHOLD = 40  # fixed value: longest unsplit line, in tokens


def _stride(size: int, overlap: int) -> int:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("overlap must be in [0, chunk size)")
    return size - overlap


def window_starts(start: Column, end: Column, size: int, overlap: int) -> Column:
    """Window starts inside [start, end): the last window is the first one that
    reaches the end."""
    stride = _stride(size, overlap)
    n = F.greatest(F.ceil((end - start - F.lit(overlap)) / F.lit(stride)), F.lit(1))
    last = start + (n - 1) * F.lit(stride)
    seq = F.sequence(start.cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint"))
    return F.when(end > start, seq).otherwise(F.array().cast("array<bigint>"))


def _meta(**kv: Column | str | int) -> Column:
    args: list[Column] = []
    for k, v in kv.items():
        args += [F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")]
    return F.create_map(*args)


def _number(df: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(*order)
    return df.withColumn("chunk_id", (F.row_number().over(w) - 1).cast("bigint"))


SPAN_COLS = ["document_id", "chunk_id", "chunk_kind", "start_index", "end_index", "metadata"]


def fixed_tokens(corpus: Corpus, size: int = 512, overlap: int = 0, early_stop: bool = True) -> DataFrame:
    """Fixed windows with overlap.  ``early_stop=False`` is the service form,
    which also emits tail windows already contained in the previous one."""
    n = F.col("token_count")
    if early_stop:
        starts = window_starts(F.lit(0).cast("bigint"), n, size, overlap)
    else:
        step = max(1, size - overlap)
        starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(step).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        )
    ex = corpus.documents.select("document_id", "token_count", F.posexplode(starts).alias("pos", "start_index"))
    return ex.select(
        "document_id",
        F.col("pos").cast("bigint").alias("chunk_id"),
        F.lit("fixed_token").alias("chunk_kind"),
        "start_index",
        F.least(F.col("start_index") + size, n).alias("end_index"),
        _meta(chunk_size=size, overlap=overlap).alias("metadata"),
    )


def pages_as_chunks(corpus: Corpus) -> DataFrame:
    p = corpus.pages.filter(F.col("end_index") > F.col("start_index"))
    p = p.withColumn("chunk_kind", F.lit("page")).withColumn("metadata", _meta(page_number=F.col("page_number")))
    return _number(p, "page_number").select(*SPAN_COLS)


def page_windows(corpus: Corpus, window_pages: int = 2, overlap_pages: int = 1) -> DataFrame:
    stride = _stride(window_pages, overlap_pages)
    by_doc = Window.partitionBy("document_id")
    w = by_doc.orderBy("page_number")
    ahead = w.rowsBetween(0, window_pages - 1)
    p = corpus.pages.filter(F.col("end_index") > F.col("start_index")).select(
        "document_id", "start_index",
        (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(by_doc).alias("n"),
        F.last("end_index").over(ahead).alias("end_index"),
        F.col("page_number").alias("page_start"),
        F.last("page_number").over(ahead).alias("page_end"),
    )
    i, n = F.col("i"), F.col("n")
    keep = (i % stride == 0) & ((i == 0) | (i - stride + window_pages < n))
    return p.filter(keep).select(
        "document_id",
        (i / stride).cast("bigint").alias("chunk_id"),
        F.lit("page_window").alias("chunk_kind"),
        "start_index", "end_index",
        _meta(window_pages=window_pages, overlap_pages=overlap_pages,
              page_start=F.col("page_start"), page_end=F.col("page_end")).alias("metadata"),
    )


def element_chunks(corpus: Corpus, element_type: str = "block", max_tokens: int | None = None) -> DataFrame:
    """One chunk per element; an oversize element becomes fixed windows."""
    e = corpus.elements_of(element_type).filter(F.col("end_index") > F.col("start_index"))
    e = e.select("document_id", "element_id", "page_number", "line_number",
                 F.col("start_index").alias("s"), F.col("end_index").alias("e"))
    if max_tokens is None:
        spans = e.select("*", F.col("s").alias("start_index"), F.col("e").alias("end_index"),
                         F.lit(element_type).alias("chunk_kind"))
    else:
        overlap = max(0, min(64, max_tokens // 10))
        big = F.col("e") - F.col("s") > max_tokens
        starts = F.when(big, window_starts(F.col("s"), F.col("e"), max_tokens, overlap)).otherwise(F.array("s"))
        spans = e.select("*", F.explode(starts).alias("start_index")).select(
            "*",
            F.when(big, F.least(F.col("start_index") + max_tokens, F.col("e"))).otherwise(F.col("e")).alias("end_index"),
            F.when(big, F.lit(f"{element_type}_window")).otherwise(F.lit(element_type)).alias("chunk_kind"),
        )
    spans = spans.withColumn("metadata", _meta(
        source_element_id=F.col("element_id"), source_element_type=element_type, page_number=F.col("page_number")))
    return _number(spans, "line_number", "start_index").select(*SPAN_COLS)


def sentence_chunks(corpus: Corpus) -> DataFrame:
    """Lines up to 40 tokens stay whole; longer ones split into sentences whose
    token ranges are allotted in proportion to sentence length (half-even
    rounding, at least one token each, the last takes the rest)."""
    e = corpus.elements_of("line").filter(F.col("end_index") > F.col("start_index"))
    n_tok = F.col("e_end") - F.col("e_start")
    raw = F.filter(sentences("text", next_upper=True), lambda s: F.trim(s) != "")
    parts = F.when((n_tok > SPLIT_THRESHOLD) & (F.size(raw) > 1), raw).otherwise(F.array("text"))
    s = e.select(
        "document_id", "line_number", "page_number", "element_id",
        F.col("start_index").alias("e_start"), F.col("end_index").alias("e_end"), "text",
    )
    s = s.select("*", F.size(parts).alias("k"), F.posexplode(parts).alias("i", "sentence"))
    s = s.withColumn("len", F.size(words("sentence")))
    line = Window.partitionBy("document_id", "line_number")
    total = F.greatest(F.sum("len").over(line), F.lit(1))
    step = F.greatest(F.lit(1), F.bround(n_tok * F.col("len") / total)).cast("bigint")
    s = s.withColumn("step", step)
    # end_i = min(end_{i-1} + step_i, e_end - (k - i - 1)); with c_i the running
    # sum of steps, end_i = c_i + min over j<=i of (cap_j - c_j), capped at e_start
    run = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("c", F.sum("step").over(run))
    slack = F.col("e_end") - (F.col("k") - F.col("i") - 1) - F.col("c")
    s = s.withColumn("slack", F.min(slack).over(run))
    end = F.when(F.col("i") == F.col("k") - 1, F.col("e_end")).otherwise(
        F.least(F.col("e_start") + F.col("c"), F.col("c") + F.col("slack"))
    )
    s = s.withColumn("end_index", end)
    start = F.coalesce(F.lag("end_index").over(line.orderBy("i")), F.col("e_start"))
    s = s.withColumn("start_index", start)
    s = s.withColumn("chunk_kind", F.lit("sentence"))
    s = _number(s, "line_number", "i").withColumn(
        "metadata",
        _meta(sentence_index=F.col("chunk_id"), page_number=F.col("page_number"), source_element_id=F.col("element_id")),
    )
    return s.select(*SPAN_COLS)


def pack_spans(starts: np.ndarray, ends: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy budget pack over element spans: (first, last+1) element indexes."""
    out, i, n = [], 0, len(starts)
    while i < n:
        # first element whose end would break the budget; the first always fits
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + max_tokens, side="right")))
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, j - overlap) if overlap > 0 else j
    return out


def grouped_elements(
    corpus: Corpus, element_type: str = "block", max_tokens: int = 800, overlap_elements: int = 0
) -> DataFrame:
    """Greedy token-budget groups of elements with element overlap.  The fold is
    sequential inside one document (one source row), parallel across them."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be > 0")
    e = corpus.elements_of(element_type).filter(F.col("end_index") > F.col("start_index")).select(
        "document_id", "line_number", "element_id", "start_index", "end_index")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_number")
        s, t = pdf["start_index"].to_numpy(), pdf["end_index"].to_numpy()
        ids = pdf["element_id"].to_numpy()
        groups = pack_spans(s, t, max_tokens, overlap_elements)
        return pd.DataFrame({
            "document_id": pdf["document_id"].iloc[0],
            "chunk_id": range(len(groups)),
            "start_index": [int(s[i]) for i, _ in groups],
            "end_index": [int(t[j - 1]) for _, j in groups],
            "ids": [",".join(map(str, ids[i:j])) for i, j in groups],
        })

    out = e.groupBy("document_id").applyInPandas(
        fold, "document_id long, chunk_id long, start_index long, end_index long, ids string")
    return out.select(
        "document_id", "chunk_id", F.lit(f"{element_type}_group").alias("chunk_kind"), "start_index", "end_index",
        _meta(element_type=element_type, max_tokens=max_tokens, overlap_elements=overlap_elements,
              source_element_ids=F.col("ids")).alias("metadata"),
    )


def hierarchical(
    corpus: Corpus, child: int = 256, child_overlap: int = 32, parent: int = 1200, parent_overlap: int = 120
) -> DataFrame:
    """Child windows inside parent windows; two explodes, no shuffle until the
    final numbering, which follows from counts per parent."""
    n = F.col("token_count")
    zero = F.lit(0).cast("bigint")
    p = corpus.documents.select(
        "document_id", "token_count",
        F.posexplode(window_starts(zero, n, parent, parent_overlap)).alias("parent_id", "parent_start"),
    ).withColumn("parent_end", F.least(F.col("parent_start") + parent, n))
    c = p.select(
        "*", F.posexplode(window_starts(F.col("parent_start"), F.col("parent_end"), child, child_overlap)).alias("k", "start_index")
    )
    # every parent before the last is full size, so it has the same child count
    full = max(1, -(-(parent - child_overlap) // (child - child_overlap)))
    return c.select(
        "document_id",
        (F.col("parent_id") * full + F.col("k")).cast("bigint").alias("chunk_id"),
        F.lit("hierarchical_child").alias("chunk_kind"),
        "start_index",
        F.least(F.col("start_index") + child, F.col("parent_end")).alias("end_index"),
        _meta(parent_id=F.col("parent_id"), parent_start=F.col("parent_start"), parent_end=F.col("parent_end"),
              child_tokens=child, child_overlap=child_overlap).alias("metadata"),
    )


def _pack_text(units: list[tuple[str, int]], size: int, overlap: int) -> list[dict]:
    out: list[dict] = []
    held: list[tuple[str, int]] = []
    used = 0
    for unit, n in units:
        if held and used + n > size:
            out.append({"text": " ".join(u for u, _ in held), "token_count": used})
            while held and used > overlap:
                used -= held.pop(0)[1]
        held.append((unit, n))
        used += n
    if held:
        out.append({"text": " ".join(u for u, _ in held), "token_count": used})
    return out


def packed_units(docs: DataFrame, unit: str = "sentence", size: int = 512, overlap: int = 64,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Service chunker: sentences or paragraphs packed to ``size`` tokens with
    carried-over trailing units.  Splitting and counting stay JVM-side; only
    the pack of one document's units runs in Python."""
    if unit == "sentence":
        parts = sentences(text_col)
    elif unit == "paragraph":
        parts = F.filter(F.transform(F.split(F.col(text_col), "\n[ \\t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    else:
        raise ValueError("unit must be sentence or paragraph")
    units = F.transform(parts, lambda p: F.struct(p.alias("u"), F.size(words(p)).alias("n")))

    @F.pandas_udf("array<struct<text:string,token_count:int>>")
    def pack(col: pd.Series) -> pd.Series:
        return col.map(lambda us: _pack_text([(u["u"], int(u["n"])) for u in us], size, overlap))

    out = docs.select(F.col(id_col).alias("document_id"), pack(units).alias("p"))
    return out.select("document_id", F.posexplode("p").alias("chunk_id", "c")).select(
        "document_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "c.text", "c.token_count")


def page_ranges(chunks: DataFrame, pages: DataFrame, width: int = 512) -> DataFrame:
    """First and last page each span overlaps (interval join on token bins)."""
    p = pages.select("document_id", "page_number", F.col("start_index").alias("p_start"), F.col("end_index").alias("p_end"))
    hit = range_join(chunks, p, ["document_id"], "start_index", "end_index", "p_start", "p_end", width)
    r = hit.groupBy("document_id", "strategy_name", "chunk_id").agg(
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    return chunks.join(r, ["document_id", "strategy_name", "chunk_id"], "left")


def finish(spans: DataFrame, corpus: Corpus, strategy: str) -> DataFrame:
    """Common tail of every chunker: clamp, drop empty spans, name the strategy."""
    total = corpus.documents.select("document_id", "token_count")
    s = spans.join(total, "document_id")
    s = s.withColumn("start_index", F.greatest(F.col("start_index"), F.lit(0)))
    s = s.withColumn("end_index", F.least("end_index", "token_count")).filter(F.col("end_index") > F.col("start_index"))
    return s.select(
        "document_id", F.lit(strategy).alias("strategy_name"), "chunk_id", "chunk_kind", "start_index", "end_index",
        (F.col("end_index") - F.col("start_index")).alias("token_length"), "metadata",
    )


def _named(fn, **kw):
    return lambda corpus: fn(corpus, **kw)


# Registered names and their sizes (fixed values).
DEFAULT_CHUNKERS = {
    "fixed_512": _named(fixed_tokens, size=512),
    "fixed_512_overlap_100": _named(fixed_tokens, size=512, overlap=100),
    "fixed_1024_overlap_128": _named(fixed_tokens, size=1024, overlap=128),
    "page_based": pages_as_chunks,
    "page_window_2_overlap_1": _named(page_windows, window_pages=2, overlap_pages=1),
    "block_based": _named(element_chunks, element_type="block"),
    "line_based_debug": _named(element_chunks, element_type="line"),
    "sentence_based": sentence_chunks,
    "block_group_800_overlap_1": _named(grouped_elements, element_type="block", max_tokens=800, overlap_elements=1),
    "line_group_512_overlap_2": _named(grouped_elements, element_type="line", max_tokens=512, overlap_elements=2),
    "hierarchical_child_256_parent_1200": hierarchical,
}
