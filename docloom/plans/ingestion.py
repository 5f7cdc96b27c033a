"""Ingestion as one sequence of named steps, and the store that keeps its result.

``extract -> normalize -> page_types -> columns -> reading_order -> headings``
work on a ``Layout`` (pages, elements, spans, images as relations), ``write`` and
``manifest`` put it under a new version.  A version is complete once its manifest
is there, so a run that died leaves the former version in place, and reopening
computes nothing again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import layout as lo
from docloom.sources.corpus import Corpus, build_corpus
from docloom.sources.io import read_manifest, write_manifest

KEY = ["document_id", "page_number"]
PIPELINE = "layout_steps_v1"


@dataclass(frozen=True)
class Layout:
    documents: DataFrame          # document_id, text, tokens, token_count
    pages: DataFrame              # schemas.PAGES, page_width, page_height
    elements: DataFrame           # schemas.ELEMENTS, x0, y0, x1, y1
    spans: DataFrame              # document_id, page_number, font_name, font_size
    images: DataFrame | None = None


Step = Callable[[Layout], Layout]
Extractor = Callable[[DataFrame], Layout]


def html_text(html: str) -> Column:
    """Text of a page: block ends and line breaks become lines, other tags go."""
    t = F.coalesce(F.col(html), F.lit(""))
    t = F.regexp_replace(t, "(?is)<(script|style|head)\\b.*?</\\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|blockquote|pre)>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return t


def plain_layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: float = 600.0, height: float = 600.0, char: float = 6.0, line: float = 14.0,
                 lines_per_page: int = 40) -> Layout:
    """Layout of plain texts in fixed pitch: one font, one column, blocks of lines."""
    c = build_corpus(docs, id_col, text_col, lines_per_page=lines_per_page)
    y0 = (F.col("line_number") % lines_per_page * line).cast("double")
    chars = F.array_max(F.transform(F.split("text", "\n"), F.length))
    rows = F.size(F.split("text", "\n"))
    e = c.elements.withColumn("x0", F.lit(0.0)).withColumn("y0", y0).withColumn("x1", F.least(F.lit(width), chars * char)).withColumn("y1", y0 + rows * line - 2)
    spans = e.filter("element_type = 'line'").select(*KEY, F.lit("plain").alias("font_name"), F.lit(10.0).alias("font_size"))
    return Layout(c.documents, c.pages.withColumn("page_width", F.lit(width)).withColumn("page_height", F.lit(height)), e, spans)


def normalize(x: Layout) -> Layout:
    t = F.trim(tx.normalize_text("text"))
    return replace(x, elements=x.elements.withColumn("normalized_text", t))


def page_types(x: Layout) -> Layout:
    t = lo.page_types(x.pages, x.spans, x.images)
    return replace(x, pages=x.pages.join(t, KEY, "left"))


def columns(x: Layout) -> Layout:
    blocks = x.elements.filter("element_type = 'block'").join(x.pages.select(*KEY, "page_width"), KEY)
    c = lo.column_counts(blocks).select(*KEY, F.col("columns").alias("column_count"))
    return replace(x, pages=x.pages.join(c, KEY, "left").withColumn("column_count", F.coalesce("column_count", F.lit(1))))


def reading_order(x: Layout) -> Layout:
    c = x.pages.select(*KEY, F.col("column_count").alias("columns"))
    return replace(x, elements=lo.column_order(x.elements, c).drop("columns"))


def headings(x: Layout) -> Layout:
    """Position scores for lines; blocks keep what they have."""
    is_line = F.col("element_type") == "line"
    lines = x.elements.filter(is_line).withColumn("_raw", F.col("text")).withColumn("text", F.col("normalized_text"))
    scored = lo.positional_headings(lines, x.pages.select(*KEY, "page_type")).withColumn("text", F.col("_raw")).drop("_raw", "page_type")
    own = F.col("heading_score") if "heading_score" in x.elements.columns else F.lit(0.0)
    flag = F.col("is_heading_candidate") if "is_heading_candidate" in x.elements.columns else F.lit(False)
    rest = x.elements.filter(~is_line).withColumn("heading_score_final", F.coalesce(own, F.lit(0.0))).withColumn("is_heading_candidate_final", F.coalesce(flag, F.lit(False)))
    return replace(x, elements=scored.unionByName(rest))


STEPS: list[tuple[str, Step]] = [("normalize", normalize), ("page_types", page_types), ("columns", columns), ("reading_order", reading_order), ("headings", headings)]


class CorpusStore:
    """Versions of an ingested corpus under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the complete versions."""
        try:
            found = self.spark.read.text(f"{self.root}/manifest").select("version").distinct().collect()
        except AnalysisException:
            return []
        return sorted(r.version for r in found)

    def ingest(self, docs: DataFrame, extract: Extractor = plain_layout, steps: Sequence[tuple[str, Step]] = STEPS) -> dict[str, Any]:
        """Run all steps and keep the result as the next version; returns its manifest.
        Rows are counted while they are written."""
        x = extract(docs)
        for _, step in steps:
            x = step(x)
        version = max(self.versions(), default=0) + 1
        measures = {
            "documents": [F.count("*").alias("documents"), F.sum("token_count").alias("total_tokens")],
            "pages": [F.count("*").alias("total_pages"), *[F.count_if(F.col("page_type") == t).alias(f"{t}_pages") for t in ("native", "scanned_ocr", "mixed", "image_only")],
                      F.count_if(F.col("column_count") > 1).alias("two_column_pages")] if {"page_type", "column_count"} <= set(x.pages.columns) else [F.count("*").alias("total_pages")],
            "elements": [F.count("*").alias("elements"), F.count_if("is_heading_candidate_final").alias("headings")] if "is_heading_candidate_final" in x.elements.columns
            else [F.count("*").alias("elements")],
        }
        counts: dict[str, Any] = {}
        for name, exprs in measures.items():
            seen = Observation()
            df = getattr(x, name).observe(seen, *exprs)
            df.write.mode("overwrite").option("compression", "zstd").parquet(self._path(name, version))
            counts |= {k: v or 0 for k, v in seen.get.items()}
        made = {"version": version, "pipeline_version": PIPELINE, "steps": ["extract", *[n for n, _ in steps], "write", "manifest"], **counts}
        write_manifest(self.spark, made, f"{self.root}/manifest/version={version}")
        return made

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/version={version}"

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        done = self.versions()
        if not done or version is not None and version not in done:
            raise FileNotFoundError(f"no such version at {self.root}: {version}")
        return read_manifest(self.spark, f"{self.root}/manifest/version={version or done[-1]}")

    def open(self, version: int | None = None) -> Corpus:
        """The stored corpus of the last version or the given one, as it was written."""
        v = self.manifest(version)["version"]
        return Corpus(*[self.spark.read.parquet(self._path(n, v)) for n in ("documents", "elements", "pages")])
