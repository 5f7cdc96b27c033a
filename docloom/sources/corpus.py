"""Corpus tables: documents with tokens, line/block/page elements.

A corpus is three relations over a shared token axis: ``documents`` (one row
per document with its token array), ``elements`` (line and block spans) and
``pages``.  All positions are half-open global token positions per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.filters import compile_filters
from docloom.functions.text import words
from docloom.functions.udfs import joined_starts


@dataclass
class Corpus:
    documents: DataFrame  # document_id, text, tokens, token_count
    elements: DataFrame   # schemas.ELEMENTS
    pages: DataFrame      # schemas.PAGES

    def elements_of(self, element_type: str | None = None, page_number: int | None = None) -> DataFrame:
        cond = {}
        if element_type is not None:
            cond["element_type"] = element_type
        if page_number is not None:
            cond["page_number"] = page_number
        return self.elements.filter(compile_filters(cond))

    def page_text(self, page_number: int) -> DataFrame:
        return self.pages.filter(F.col("page_number") == page_number).select("document_id", "text")

    def element(self, element_id: int) -> DataFrame:
        return self.elements.filter(F.col("element_id") == element_id)


def with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    toks = words(text_col)
    return docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"), toks.alias("tokens")).withColumn(
        "token_count", F.size("tokens").cast("bigint")
    )


def line_elements(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lines_per_block: int = 4,
    lines_per_page: int = 40,
) -> DataFrame:
    """Non-blank lines with token spans.  Blank lines go before the explode, so
    the position in the array is already the line number."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.trim(x) != "")
    ex = docs.select(F.col(id_col).alias("document_id"), F.posexplode(lines).alias("line_number", "text"))
    ex = ex.withColumn("token_length", F.size(words("text")).cast("bigint"))
    w = Window.partitionBy("document_id").orderBy("line_number")
    end = F.sum("token_length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ex.select(
        "document_id",
        (F.col("line_number") * 4 + 2).cast("bigint").alias("element_id"),
        F.lit("line").alias("element_type"),
        F.floor(F.col("line_number") / lines_per_page).cast("int").alias("page_number"),
        F.floor(F.col("line_number") / lines_per_block).cast("int").alias("block_number"),
        "line_number",
        (end - F.col("token_length")).alias("start_index"),
        end.alias("end_index"),
        "token_length",
        "text",
    )


def _joined_text() -> Column:
    rows = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def printed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_per_block: int = 4, lines_per_page: int = 40,
                  char_width: int = 6, line_height: int = 14) -> DataFrame:
    """Words of plain texts with the boxes of a fixed-pitch print, numbered in
    each page: what a layout extractor gives for native pages."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.size(words(x)) > 0)
    ex = docs.select(F.col(id_col).alias("document_id"), F.posexplode(lines).alias("line", "_l")).withColumn("_w", words("_l"))
    page = F.floor(F.col("line") / lines_per_page).cast("int")
    n = F.size("_w")
    before = F.sum(n).over(Window.partitionBy("document_id", "page_number").orderBy("line")) - n
    # a running sum over the words: an array grown word by word is copied for each;
    # it stands before the window, as Spark forgets behind it how the pages are dealt
    ex = ex.withColumn("_x", joined_starts(F.transform("_w", F.length)))
    ex = ex.withColumn("page_number", page).withColumn("_before", before)
    ex = ex.select("document_id", "page_number", "line", "_before", F.posexplode(F.arrays_zip(F.col("_x").alias("x"), F.col("_w").alias("t"))).alias("k", "w"))
    y0 = (F.col("line") % lines_per_page * line_height).cast("double")
    return ex.select(
        "document_id", "page_number", (F.col("_before") + F.col("k")).cast("int").alias("word_no"), F.floor(F.col("line") / lines_per_block).cast("int").alias("block_no"),
        F.col("line").alias("line_no"), F.col("w.t").alias("text"), (F.col("w.x") * char_width).cast("double").alias("x0"), y0.alias("y0"),
        ((F.col("w.x") + F.length("w.t")) * char_width).cast("double").alias("x1"), (y0 + line_height - 2).alias("y1"))


def block_elements(lines: DataFrame) -> DataFrame:
    g = lines.groupBy("document_id", "block_number").agg(
        F.min("page_number").alias("page_number"),
        F.min("line_number").alias("line_number"),
        F.min("start_index").alias("start_index"),
        F.max("end_index").alias("end_index"),
        _joined_text().alias("text"),
    )
    return g.select(
        "document_id",
        (F.col("block_number") * 4 + 1).cast("bigint").alias("element_id"),
        F.lit("block").alias("element_type"),
        "page_number", "block_number", "line_number", "start_index", "end_index",
        (F.col("end_index") - F.col("start_index")).alias("token_length"),
        "text",
    )


def page_table(lines: DataFrame) -> DataFrame:
    return lines.groupBy("document_id", "page_number").agg(
        F.min("start_index").alias("start_index"),
        F.max("end_index").alias("end_index"),
        (F.max("end_index") - F.min("start_index")).alias("token_length"),
        F.count("*").alias("line_count"),
        _joined_text().alias("text"),
    )


def build_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **layout: int) -> Corpus:
    """Token store for a table of plain-text documents."""
    lines = line_elements(docs, id_col, text_col, **layout)
    return Corpus(
        documents=with_tokens(docs, id_col, text_col),
        elements=lines.unionByName(block_elements(lines)),
        pages=page_table(lines),
    )


def decode_span(toks: Column, start: Column, end: Column) -> Column:
    """Text of a token span, clamped to the document; empty when inverted."""
    s = F.greatest(start, F.lit(0)).cast("int")
    e = F.least(end, F.size(toks)).cast("int")
    return F.when(e > s, F.array_join(F.slice(toks, s + 1, e - s), " ")).otherwise(F.lit(""))


def decode(spans: DataFrame, corpus: Corpus, start: str = "start_index", end: str = "end_index") -> DataFrame:
    """Attach span text to any (document_id, start, end) relation."""
    docs = corpus.documents.select("document_id", "tokens")
    return spans.join(docs, "document_id").withColumn(
        "text", decode_span(F.col("tokens"), F.col(start), F.col(end))
    ).drop("tokens")
