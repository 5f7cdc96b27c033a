"""Page types, columns, reading order, headings, Markdown and the ingestion store."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking
from docloom.operators import layout as lo
from docloom.plans import ingestion as ing

BOX = "document_id long, page_number int, element_id long, x0 double, y0 double, x1 double, y1 double, page_width double, text string"


def test_page_types(spark):
    pages = spark.createDataFrame([(1, p, 100.0, 100.0) for p in range(8)], "document_id long, page_number int, page_width double, page_height double")
    spans = ([(1, 0, f"F{i}", 9.0 + i) for i in range(5)] + [(1, 1, "Times", 10.0)] * 40 + [(1, 2, "x GlyphLess", 10.0), (1, 2, None, None)]
             + [(1, 3, f"F{i}", 9.0) for i in range(5)] + [(1, 6, "A", 8.0 + i % 2 * 8) for i in range(40)] + [(1, 7, "A", 8.0 + i % 2 * 8) for i in range(40)])
    spans = spark.createDataFrame(spans, "document_id long, page_number int, font_name string, font_size double")
    images = spark.createDataFrame([(1, 3, 0.0, 0.0, 30.0, 30.0), (1, 4, 0.0, 0.0, 90.0, 90.0), (1, 5, 0.0, 0.0, 10.0, None), (1, 7, 0.0, 0.0, 30.0, 30.0)],
                                   "document_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    got = {r.page_number: r.page_type for r in lo.page_types(pages, spans, images).collect()}
    assert got == {0: "native", 1: "scanned_ocr", 2: "scanned_ocr", 3: "mixed", 4: "image_only", 5: "native", 6: "native", 7: "scanned_ocr"}


def blocks(spark, centers, page=0, width=100.0):
    return spark.createDataFrame([(1, page, i, None if c is None else c - 5.0, float(i // 2), None if c is None else c + 5.0, float(i), width, "t") for i, c in enumerate(centers)], BOX)


def test_columns_and_order(spark):
    two = blocks(spark, [20.0, 80.0] * 3)
    count = lambda b: lo.column_counts(b).first().columns
    assert count(two) == 2 and count(blocks(spark, [20.0, 80.0] * 2)) == 1 and count(blocks(spark, [20.0] * 6)) == 1
    assert count(blocks(spark, [20.0, 80.0] * 3 + [50.0] * 2)) == 2 and count(blocks(spark, [20.0, 80.0] * 3 + [50.0] * 3)) == 1
    assert count(blocks(spark, [20.0, 80.0] * 3, width=0.0)) == 1 and count(blocks(spark, [None] * 7)) == 1
    order = {r.element_id: r.reading_order for r in lo.column_order(two, lo.column_counts(two)).collect()}
    assert [order[i] for i in (0, 2, 4, 1, 3, 5)] == [0, 1, 2, 3, 4, 5]
    one = lo.column_order(two, lo.column_counts(two).withColumn("columns", F.lit(1)))
    assert [r.element_id for r in one.orderBy("reading_order").collect()] == [0, 1, 2, 3, 4, 5]


def test_positional_headings(spark):
    rows = [(1, 0, i, 0.0, y, 50.0, y + 10, 100.0, t) for i, (y, t) in enumerate([
        (0.0, "PATIENT HISTORY:"), (12.0, "this is a plain line of text, which ends here."), (24.0, "and goes on, with words"), (60.0, "1. Past Illness"), (72.0, "a b"), (84.0, ""), (96.0, None)])]
    lines = spark.createDataFrame(rows, BOX).withColumn("heading_score", F.lit(0.9)).withColumn("is_heading_candidate", F.lit(True))
    types = lambda t: spark.createDataFrame([(1, 0, t)], "document_id long, page_number int, page_type string")
    got = {r.element_id: r for r in lo.positional_headings(lines, types("scanned_ocr")).collect()}
    assert [got[i].is_heading_candidate_final for i in range(7)] == [True, False, False, True, False, False, False]
    assert got[0].heading_score_final == pytest.approx(0.15 + 0.10 + 0.20 + 0.15 + 0.05)
    assert got[3].heading_score_final == pytest.approx(0.35 + 0.15 + 0.10 + 0.10 + 0.05 + 0.10)
    native = lo.positional_headings(lines, types("native")).collect()
    assert {(r.heading_score_final, r.is_heading_candidate_final) for r in native} == {(0.9, True)}


def test_markdown(spark):
    rows = [(1, 1, 3, 0.0, 0.0, 1.0, 1.0, 9.0, "second page"), (1, 0, 2, 0.0, 5.0, 1.0, 1.0, 9.0, " body "), (1, 0, 1, 0.0, 0.0, 1.0, 1.0, 9.0, "Title"), (1, 0, 4, 0.0, 9.0, 1.0, 1.0, 9.0, " "),
            (1, 2, 5, 0.0, 0.0, 1.0, 1.0, 9.0, "footer")]
    d = spark.createDataFrame(rows, BOX).withColumn("is_heading_candidate", F.col("text") == "Title").withColumn("is_repeated_footer_candidate", F.col("text") == "footer")
    want = "<!-- page_number: 0 -->\n\n\n## Title\n\nbody\n\n<!-- page_number: 1 -->\n\nsecond page\n\n<!-- page_number: 2 -->"
    assert lo.to_markdown(d).first().markdown == want
    assert lo.to_markdown(d, remove_repeated=False).first().markdown == want + "\n\nfooter"


def test_store_keeps_versions(spark, tmp_path):
    s = ing.CorpusStore(spark, str(tmp_path / "corpus"))
    with pytest.raises(FileNotFoundError):
        s.open()
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    one = s.ingest(docs("TITLE:\nof two lines and\ttabs", None, "\n".join(f"line {i}" for i in range(50))))
    assert one["steps"] == ["extract", "normalize", "page_types", "columns", "reading_order", "headings", "write", "manifest"]
    assert (one["version"], one["documents"], one["total_pages"], one["native_pages"], one["scanned_ocr_pages"], one["two_column_pages"]) == (1, 3, 3, 2, 1, 0)
    assert one["total_tokens"] == 6 + 100 and one["elements"] == 52 + 14
    c = s.open()
    assert c.elements.filter("element_type = 'line'").select("reading_order", "heading_score_final", "normalized_text").count() == 52
    assert [r.token_length for r in chunking.finish(chunking.DEFAULT_CHUNKERS["fixed_512"](c), c, "fixed_512").orderBy("document_id").collect()] == [6, 100]
    assert s.ingest(docs("x"), steps=ing.STEPS[:1])["steps"] == ["extract", "normalize", "write", "manifest"]
    assert s.versions() == [1, 2] and s.open().documents.count() == 1 and s.open(1).documents.count() == 3
    spark.range(1).write.parquet(str(tmp_path / "corpus/pages/version=3"))  # a run that died
    assert s.manifest()["version"] == 2
    with pytest.raises(FileNotFoundError):
        s.open(3)


def test_text_of_html(spark):
    h = "<head><title>no</title></head><body><p>One<br>two &amp; <b>three</b></p><script>x<y</script><!-- c --><li>&lt;four&gt;</li></body>"
    got = spark.createDataFrame([(h,), (None,)], "h string").select(ing.html_text("h").alias("t")).collect()
    assert [x.split() for x in got[0].t.strip().split("\n")] == [["One"], ["two", "&", "three"], ["<four>"]] and got[1].t == ""
