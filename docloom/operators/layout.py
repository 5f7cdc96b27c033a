"""Layout analytics over line and span relations: fonts, repeated headers,
heading scores, heading paths, columns and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx


def bbox_features(df: DataFrame) -> DataFrame:
    """Width, height, area, centres and page-normalised box; nulls propagate."""
    ok = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    df = df.withColumn("box_width", w).withColumn("box_height", h).withColumn("box_area", w * h)
    for a, side in (("x0", "page_width"), ("x1", "page_width"), ("y0", "page_height"), ("y1", "page_height")):
        df = df.withColumn(f"{a}_norm", F.when(ok, F.col(a) / F.col(side)))
    return df.withColumn("center_x_norm", (F.col("x0_norm") + F.col("x1_norm")) / 2).withColumn(
        "center_y_norm", (F.col("y0_norm") + F.col("y1_norm")) / 2)


def text_shape(df: DataFrame) -> DataFrame:
    t = F.trim("text")
    letters, upper = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit("[A-Z]"))
    return (df.withColumn("text_length", F.length(t)).withColumn("word_count", F.size(tx.words(t)))
            .withColumn("has_digit", t.rlike("[0-9]")).withColumn("ends_with_colon", t.endswith(":"))
            .withColumn("is_all_caps", (letters > 0) & (upper / F.greatest(letters, F.lit(1)) > 0.85))
            .withColumn("looks_numbered_heading", t.rlike("^([0-9]+[.)]|[IVX]+[.)]|[A-Z][.)]) ?")))


def font_aggregates(spans: DataFrame) -> DataFrame:
    """Per line: mean and largest size, most frequent font, any bold/italic."""
    name = F.lower("font")
    bold, italic = name.rlike("bold|black|heavy|semibold|demi"), name.rlike("italic|oblique")
    return spans.groupBy("document_id", "element_id").agg(
        F.avg("size").alias("avg_font_size"), F.max("size").alias("max_font_size"), F.mode("font", True).alias("main_font"),
        F.bool_or(bold).alias("contains_bold"), F.bool_or(italic).alias("contains_italic"))


def repeated_lines(lines: DataFrame, ratio: float = 0.35) -> DataFrame:
    """Flag top/bottom-zone lines repeated on enough pages of a document.
    Counting is a small aggregate per (document, normalised line)."""
    n = lines.withColumn("norm", tx.repetition_key("text"))
    pages = n.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"))
    cnt = n.filter(F.length("norm") >= 3).groupBy("document_id", "norm").agg(
        F.count_if("is_top_zone").alias("top"), F.count_if("is_bottom_zone").alias("bottom"))
    need = F.greatest(F.lit(2), F.ceil(F.col("pages") * ratio))
    rep = cnt.join(pages, "document_id").filter(F.col("pages") > 2).select(
        "document_id", "norm", (F.col("top") >= need).alias("r_top"), (F.col("bottom") >= need).alias("r_bottom"))
    out = n.join(rep, ["document_id", "norm"], "left")
    return (out.withColumn("is_repeated_header_candidate", F.coalesce(F.col("is_top_zone") & F.col("r_top"), F.lit(False)))
            .withColumn("is_repeated_footer_candidate", F.coalesce(F.col("is_bottom_zone") & F.col("r_bottom"), F.lit(False))).drop("r_top", "r_bottom"))


def heading_scores(lines: DataFrame, cut: float = 0.45) -> DataFrame:
    """Heading score from font percentiles of the document and line shape.
    ``lines`` carries text_shape and font columns."""
    pct = lines.groupBy("document_id").agg(F.percentile("max_font_size", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.9))).alias("p"))
    d = lines.join(pct, "document_id", "left")
    size, wc = F.coalesce("max_font_size", F.lit(0.0)), F.col("word_count")
    s = (F.when(size >= F.col("p")[2], 0.35).when(size >= F.col("p")[1], 0.25).when(size > F.col("p")[0], 0.15).otherwise(0.0)
         + F.when(F.coalesce("contains_bold", F.lit(False)), 0.20).otherwise(0.0)
         + F.when(F.col("is_all_caps") & wc.between(1, 12), 0.15).otherwise(0.0)
         + F.when(F.col("ends_with_colon") & wc.between(1, 14), 0.15).otherwise(0.0)
         + F.when(F.col("looks_numbered_heading"), 0.10).otherwise(0.0) + F.when(wc.between(1, 12), 0.10).otherwise(0.0)
         - F.when(wc > 20, 0.20).otherwise(0.0) - F.when(F.length(F.trim("text")) > 160, 0.20).otherwise(0.0))
    skip = (F.trim("text") == "") | F.col("p").isNull()
    for c in ("is_repeated_header_candidate", "is_repeated_footer_candidate"):
        if c in lines.columns:
            skip = skip | F.col(c)
    score = F.when(skip, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    return d.withColumn("heading_score", score).withColumn("is_heading_candidate", F.col("heading_score") >= cut - 1e-9).drop("p")


def heading_paths(lines: DataFrame, order: list[str]) -> DataFrame:
    """Carry the last heading forward in reading order."""
    w = Window.partitionBy("document_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading_path", F.last(F.when(F.col("is_heading_candidate"), F.col("text")), ignorenulls=True).over(w))


# Fonts that OCR software writes, thresholds of page types and columns.
OCR_FONT = "(?i)(glyphless|glyph.less|ocr|tesseract|abbyy|recognita|acrobat.capture)"
LOW_VARIETY, IMAGE_AREA, ONLY_IMAGES, EVEN_SIZES = 0.06, 0.05, 0.1, 0.05
CENTER_ZONE, BLOCKS_PER_COLUMN = (0.30, 0.70), 3


def page_types(pages: DataFrame, spans: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Type of every page with what tells it.

    ``pages``: document_id, page_number, page_width, page_height; ``spans``: font_name
    and font_size of the page's text spans; ``images``: boxes.  A font of OCR
    software, or few fonts for the number of spans together with images or with
    even sizes, make a scanned page; images beside varied fonts a mixed one.  Null
    fonts and sizes count as one unnamed font and as 0; only sizes above 0 enter
    the variation, population form."""
    key = ["document_id", "page_number"]
    name, size = F.coalesce("font_name", F.lit("")), F.coalesce(F.col("font_size").cast("double"), F.lit(0.0))
    real = F.when(size > 0, size)
    s = spans.groupBy(*key).agg(
        F.count("*").alias("span_count"), (F.count_distinct(F.struct(name, F.bround(size * 2, 0) / 2)) / F.count("*")).alias("font_variety_score"),
        F.count_distinct(F.when(name != "", name)).alias("distinct_fonts"), F.bool_or(name.rlike(OCR_FONT)).alias("has_ocr_font"),
        F.when((F.count(real) > 1) & (F.avg(real) > 0), F.stddev_pop(real) / F.avg(real)).alias("size_cv"))
    out = pages.select(*key, "page_width", "page_height").join(s, key, "left")
    if images is None:
        out = out.withColumn("_area", F.lit(0.0))
    else:
        side = lambda a, b: F.greatest(F.lit(0.0), F.coalesce(F.col(b), F.lit(0.0)) - F.coalesce(F.col(a), F.lit(0.0)))
        out = out.join(images.groupBy(*key).agg(F.sum(side("x0", "x1") * side("y0", "y1")).alias("_area")), key, "left")
    area = F.coalesce("_area", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height"))
    out = out.select(*key, area.alias("image_area_ratio"), F.coalesce("span_count", F.lit(0)).alias("span_count"), F.coalesce("font_variety_score", F.lit(0.0)).alias("font_variety_score"),
                     F.coalesce("size_cv", F.lit(0.0)).alias("size_cv"), F.coalesce("has_ocr_font", F.lit(False)).alias("has_ocr_font"), F.coalesce("distinct_fonts", F.lit(0)).alias("distinct_fonts"))
    low, image = F.col("font_variety_score") < LOW_VARIETY, F.col("image_area_ratio") > IMAGE_AREA
    kind = (F.when((F.col("span_count") == 0) & (F.col("image_area_ratio") > ONLY_IMAGES), "image_only").when(F.col("span_count") == 0, "native").when(F.col("has_ocr_font"), "scanned_ocr")
            .when(low & image, "scanned_ocr").when(low & (F.col("size_cv") < EVEN_SIZES) & (F.col("distinct_fonts") <= 2), "scanned_ocr").when(image & ~low, "mixed").otherwise("native"))
    return out.withColumn("page_type", kind)


def column_counts(blocks: DataFrame) -> DataFrame:
    """1 or 2 columns of each page out of its block boxes (``x0, x1, page_width``):
    two when both sides of the middle zone hold enough blocks and the zone itself
    few.  Blocks without a box count for the size of the page only."""
    c = (F.col("x0") + F.col("x1")) / 2 / F.when(F.col("page_width") > 0, F.col("page_width"))
    lo, hi = CENTER_ZONE
    g = blocks.groupBy("document_id", "page_number").agg(
        F.count("*").alias("blocks"), F.max("page_width").alias("_w"), F.count(c).alias("_n"), F.count_if(c < lo).alias("left"), F.count_if(c > hi).alias("right"),
        F.count_if(c.between(lo, hi)).alias("center"))
    two = ((F.col("_w") > 0) & (F.col("blocks") >= 2 * BLOCKS_PER_COLUMN) & (F.col("left") >= BLOCKS_PER_COLUMN) & (F.col("right") >= BLOCKS_PER_COLUMN)
           & (F.col("center") <= F.greatest(F.lit(2), F.floor(F.lit(0.15) * F.col("_n")))))
    return g.withColumn("columns", F.when(two, 2).otherwise(1)).drop("_w", "_n")


def column_order(elements: DataFrame, columns: DataFrame) -> DataFrame:
    """``reading_order`` of the elements (``x0, y0, x1``) of pages with known column
    counts: top to bottom, or the left column before the right one, split at the
    median centre of the page."""
    page = Window.partitionBy("document_id", "page_number")
    c = (F.coalesce("x0", F.lit(0.0)) + F.coalesce("x1", F.lit(0.0))) / 2
    d = elements.join(columns.select("document_id", "page_number", "columns"), ["document_id", "page_number"], "left")
    d = d.withColumn("_c", c).withColumn("_split", F.coalesce(F.median(F.when(F.col("x0").isNotNull(), F.col("_c"))).over(page), F.lit(0.0)))
    right = (F.coalesce("columns", F.lit(1)) > 1) & (F.col("_c") > F.col("_split"))
    at = [F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), F.col("element_id")]
    return d.withColumn("reading_order", F.row_number().over(page.orderBy(right.cast("int"), *at)) - 1).drop("_c", "_split")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Left of the page's median centre first, then top to bottom."""
    page = Window.partitionBy("document_id", "page_number")
    d = blocks.withColumn("split", F.median("center_x_norm").over(page))
    right = (F.col("center_x_norm") > F.col("split")).cast("int")
    return d.withColumn("reading_order", F.row_number().over(page.orderBy(right, "y0_norm", "x0_norm", "element_id")) - 1)


# Position-based headings.
HEADING_GAP, HEADING_WORDS, HEADING_CUT = 1.4, 15, 0.45
NUMBERED = "^\\s*([0-9]+(\\.[0-9]+)*|[A-Z])[\\).\\s-]+"


def title_case(t: Column) -> Column:
    """Capitals begin words and nothing else does."""
    return t.rlike("\\p{L}") & ~t.rlike("[\\p{Lu}\\p{Ll}]\\p{Lu}") & ~t.rlike("(^|[^\\p{Lu}\\p{Ll}])\\p{Ll}")


def positional_headings(lines: DataFrame, types: DataFrame) -> DataFrame:
    """``heading_score_final`` and ``is_heading_candidate_final`` of every line.

    On pages that are not native, fonts say nothing: the gap above a line against
    the page's median of positive gaps, its length, case and ending are scored.
    Native pages keep ``heading_score`` and ``is_heading_candidate`` where given.
    Pages of no known type count as native."""
    page = Window.partitionBy("document_id", "page_number")
    y0, y1, x0 = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("y0", "y1", "x0"))
    d = lines.join(types.select("document_id", "page_number", "page_type"), ["document_id", "page_number"], "left")
    d = d.withColumn("_g", y0 - F.coalesce(F.lag(y1).over(page.orderBy(y0, x0, "element_id")), F.lit(0.0)))
    first = F.row_number().over(page.orderBy(y0, x0, "element_id")) == 1
    d = d.withColumn("_first", first)
    median = F.coalesce(F.median(F.when(~F.col("_first") & (F.col("_g") > 0), F.col("_g"))).over(page), F.lit(2.0))
    d = d.withColumn("_ratio", F.col("_g") / F.greatest(F.lit(0.5), median))
    t = F.trim(F.coalesce("text", F.lit("")))
    n, letters, upper = F.size(tx.words(t)), F.regexp_count(t, F.lit("\\p{L}")), F.regexp_count(t, F.lit("\\p{Lu}"))
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    caps = (letters > 0) & (upper / F.greatest(F.lit(1), letters) > 0.85) & (n <= 10)
    s = (yes(F.col("_ratio") >= HEADING_GAP, F.least(F.lit(0.35), 0.08 * F.col("_ratio"))) + yes(n.between(1, HEADING_WORDS), 0.15) + yes(n <= 5, 0.10)
         + F.when(caps, 0.20).when(title_case(t) & (n <= 10), 0.10).otherwise(0.0) + yes(t.endswith(":") & (n <= 12), 0.15) + yes(~t.endswith(".") & ~t.endswith(","), 0.05)
         + yes(t.rlike(NUMBERED), 0.10) - yes(n > HEADING_WORDS, 0.30) - yes(F.length(t) > 160, 0.20))
    skip = n == 0
    for c in ("is_repeated_header_candidate", "is_repeated_footer_candidate"):
        if c in lines.columns:
            skip = skip | F.coalesce(F.col(c), F.lit(False))
    score = F.when(skip, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    own = F.coalesce(F.col("heading_score"), F.lit(0.0)) if "heading_score" in lines.columns else F.lit(0.0)
    flag = F.coalesce(F.col("is_heading_candidate"), F.lit(False)) if "is_heading_candidate" in lines.columns else F.lit(False)
    native = F.coalesce("page_type", F.lit("native")) == "native"
    d = d.withColumn("heading_score_final", F.when(native, own).otherwise(score))
    return d.withColumn("is_heading_candidate_final", F.when(native, flag).otherwise(F.col("heading_score_final") >= HEADING_CUT - 1e-9)).drop("_g", "_first", "_ratio")


def to_markdown(lines: DataFrame, remove_repeated: bool = True, heading: str = "is_heading_candidate") -> DataFrame:
    """One Markdown text per document: a comment where a page begins, headings set
    apart as ``##`` lines, blank lines and repeated headers and footers left out.
    Lines go by page, y0, x0 and element; a page all of whose lines go keeps its comment."""
    gone = F.lit(False)
    if remove_repeated:
        for c in ("is_repeated_header_candidate", "is_repeated_footer_candidate"):
            gone = gone | F.coalesce(F.col(c), F.lit(False)) if c in lines.columns else gone
    t = F.trim(F.coalesce("text", F.lit("")))
    body = F.when(gone | (t == ""), None).when(F.coalesce(F.col(heading), F.lit(False)), F.concat(F.lit("\n## "), t, F.lit("\n"))).otherwise(t)
    at = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("y0", "x0")]
    rows = lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", *at, "element_id", body.alias("t")))).alias("r"))
    mark = lambda x: F.concat(F.lit("\n<!-- page_number: "), x["page_number"].cast("string"), F.lit(" -->\n"))
    first = lambda x, i: (i == 0) | (F.get("r", i - 1)["page_number"] != x["page_number"])
    parts = F.flatten(F.transform("r", lambda x, i: F.array(F.when(first(x, i), mark(x)), x["t"])))
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
    return rows.select("document_id", F.regexp_replace(joined, "^\\s+|\\s+$", "").alias("markdown"))


def inject_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Add OCR elements on pages where the native text has no tokens."""
    has = native.filter(F.size(tx.tokens("text")) > 0).select("document_id", "page_number").distinct()
    return native.unionByName(ocr.join(has, ["document_id", "page_number"], "left_anti"), allowMissingColumns=True)


def scale_box(df: DataFrame, scale: float, width: Column, height: Column) -> DataFrame:
    """Boxes measured on a scaled render, back in page units and clamped."""
    for a, side in (("x0", width), ("x1", width), ("y0", height), ("y1", height)):
        df = df.withColumn(a, F.greatest(F.lit(0.0), F.least(F.col(a) / scale, side)))
    return df


def quote_windows(words: DataFrame, quotes: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Best word window on a page for each quote (``document_id, quote_id,
    quote``): the run of words sharing most tokens with the quote.

    A word's tokens join the quote's tokens; per hit the window over the next
    ``n + max(4, n // 4)`` words counts distinct quote tokens, so only matching
    words are ever compared."""
    q = quotes.withColumn("qd", tx.distinct_tokens("quote")).withColumn("n_q", F.size(tx.tokens("quote"))).filter(F.size("qd") > 0)
    qt = q.select("document_id", "quote_id", F.size("qd").alias("distinct_q"), (F.col("n_q") + F.greatest(F.lit(4), F.floor(F.col("n_q") / 4))).alias("span"), F.explode("qd").alias("tok"))
    w = words.select("document_id", "page_number", "word_no", F.explode(tx.distinct_tokens("text")).alias("tok"))
    hit = w.join(qt, ["document_id", "tok"])
    key = ["document_id", "quote_id", "page_number"]
    # distinct tokens in a window = hits whose next equal token lies beyond it;
    # count starts per window by joining each hit to the hits that follow closely
    starts = hit.select(*key, F.col("word_no").alias("start"), "span", "distinct_q").distinct()
    bins = F.floor(F.col("start") / F.col("span"))
    s = starts.withColumn("bin", F.explode(F.array(bins, bins + 1)))
    h = hit.select(*key, "word_no", "tok", F.floor(F.col("word_no") / F.col("span")).alias("bin"))
    pair = s.join(h, [*key, "bin"]).filter((F.col("word_no") >= F.col("start")) & (F.col("word_no") < F.col("start") + F.col("span")))
    d = pair.groupBy(*key, F.col("start").alias("word_no"), "span", "distinct_q").agg(F.countDistinct("tok").alias("hits"))
    d = d.withColumn("score", F.col("hits") / F.col("distinct_q")).filter(F.col("score") >= threshold)
    w2 = Window.partitionBy("document_id", "quote_id").orderBy(F.desc("score"), "page_number", "word_no")
    return d.withColumn("_r", F.row_number().over(w2)).filter("_r = 1").select(*key, "word_no", "span", "hits", "score")
