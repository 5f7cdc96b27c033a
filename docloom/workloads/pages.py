"""Page layout of the text corpus: types, columns, reading order, headings.

Lines are printed in boxes that follow from their numbers and lengths; every
fourth document has a second column, others images or the fonts of OCR software."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.scores import quantize
from docloom.operators import chunking
from docloom.operators import layout as lo
from docloom.plans.ingestion import CorpusStore, html_text
from docloom.sources.io import shared_folder
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.registry import ORACLES, query
from docloom.workloads.structure import SPAN

KEY = ["document_id", "page_number"]


def lines(spark, d):
    e = inp.corpus(spark, d).elements_of("line").select("document_id", "element_id", "page_number", "line_number", "text")
    right = (F.col("document_id") % 4 == 1) & (F.col("line_number") % 40 >= 20)
    x0 = F.when(right, 360.0).otherwise(20.0) + F.when(F.length("text") % 13 == 0, 120.0).otherwise(0.0)
    row = F.when(F.col("document_id") % 4 == 1, F.col("line_number") % 20).otherwise(F.col("line_number") % 40)
    y0 = row * 14.0 + F.when(F.length("text") % 3 == 0, 6.0).otherwise(0.0)
    return e.withColumn("x0", x0).withColumn("x1", x0 + 200).withColumn("y0", y0).withColumn("y1", y0 + 12).withColumn("page_width", F.lit(600.0))


def spans(spark, d):
    k, n = F.col("document_id") % 5, F.length("text")
    font = (F.when(k == 0, F.concat(F.lit("Font"), (n % 9).cast("string"))).when((k == 2) & (n % 17 == 0), "GlyphLessFont").otherwise("Times"))
    size = F.when(k.isin(0, 4), 8.0 + n % 7 / 2).otherwise(10.0)
    return lines(spark, d).select(*KEY, font.alias("font_name"), size.alias("font_size"))


def types(spark, d):
    p = lines(spark, d).select(*KEY).distinct()
    pages = p.withColumn("page_width", F.lit(600.0)).withColumn("page_height", F.lit(800.0))
    image = p.filter("document_id % 3 = 0").select(*KEY, F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(100.0).alias("y1"))
    return lo.page_types(pages, spans(spark, d), image)


_LINES = """pl0 as (select doc_id document_id, unnest(ls) "text", unnest(range(0, len(ls))) line_number from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') ls from documents)),
pl1 as (select document_id, (line_number * 4 + 2)::bigint element_id, (line_number // 40)::int page_number, line_number, text,
  case when document_id % 4 = 1 and line_number % 40 >= 20 then 360.0 else 20.0 end::double + case when length(text) % 13 = 0 then 120 else 0 end x0,
  case when document_id % 4 = 1 then line_number % 20 else line_number % 40 end * 14.0::double + case when length(text) % 3 = 0 then 6 else 0 end y0 from pl0),
pl as (select *, x0 + 200 x1, y0 + 12 y1 from pl1)"""
_TYPES = """sp as (select document_id, page_number, case when document_id % 5 = 0 then 'Font' || length(text) % 9 when document_id % 5 = 2 and length(text) % 17 = 0 then 'GlyphLessFont' else 'Times' end f,
  case when document_id % 5 in (0, 4) then 8.0 + (length(text) % 7)::double / 2 else 10.0 end::double z from pl),
sg as (select document_id, page_number, count(*) span_count, count(distinct f || '|' || (round_even(z * 2, 0) / 2)) / count(*) font_variety_score, count(distinct f) distinct_fonts,
  bool_or(regexp_matches(f, '(?i)glyphless|ocr')) has_ocr_font, case when count(*) > 1 then stddev_pop(z) / avg(z) else 0 end size_cv from sp group by all),
ty as (select *, case when document_id % 3 = 0 then 30000.0 / 480000 else 0 end::double image_area_ratio from sg),
pt as (select *, case when has_ocr_font then 'scanned_ocr' when font_variety_score < 0.06 and image_area_ratio > 0.05 then 'scanned_ocr' when font_variety_score < 0.06 and size_cv < 0.05 and distinct_fonts <= 2 then 'scanned_ocr'
  when image_area_ratio > 0.05 and font_variety_score >= 0.06 then 'mixed' else 'native' end page_type from ty)"""
_COLUMNS = """cc as (select document_id, page_number, count(*) blocks, count(*) filter (c < 0.3) "left", count(*) filter (c > 0.7) "right", count(*) filter (c between 0.3 and 0.7) center
  from (select *, (x0 + x1) / 2 / 600 c from pl) group by all),
co as (select *, case when blocks >= 6 and "left" >= 3 and "right" >= 3 and center <= greatest(2, floor(0.15 * blocks)) then 2 else 1 end columns from cc)"""


@query("l6_page_types", S.select([_LINES, _TYPES], f"""select document_id, page_number, span_count, {S.q6('font_variety_score')} font_variety_score, {S.q6('size_cv')} size_cv, has_ocr_font, distinct_fonts,
  {S.q6('image_area_ratio')} image_area_ratio, page_type from pt"""))
def _(spark, d):
    t = types(spark, d)
    return t.select(*KEY, "span_count", *[quantize(F.col(c)).alias(c) for c in ("font_variety_score", "size_cv", "image_area_ratio")], "has_ocr_font", "distinct_fonts", "page_type")


@query("l7_columns", S.select([_LINES, _COLUMNS], "select * from co"))
def _(spark, d):
    return lo.column_counts(lines(spark, d))


@query("l8_column_order", S.select([_LINES, _COLUMNS, "cm as (select *, median((x0 + x1) / 2) over (partition by document_id, page_number) m from pl join co using (document_id, page_number))"],
    """select document_id, element_id, row_number() over (partition by document_id, page_number order by (columns > 1 and (x0 + x1) / 2 > m)::int, y0, x0, element_id) - 1 reading_order from cm"""))
def _(spark, d):
    x = lines(spark, d)
    return lo.column_order(x, lo.column_counts(x)).select("document_id", "element_id", "reading_order")


@query("l9_headings", S.select([_LINES, _TYPES, """hg as (select pl.*, page_type, y0 - coalesce(lag(y1) over w, 0) g, row_number() over w = 1 f1 from pl join pt using (document_id, page_number)
  window w as (partition by document_id, page_number order by y0, x0, element_id)),
hm as (select *, trim(text) t, g / greatest(0.5, coalesce(median(case when not f1 and g > 0 then g end) over (partition by document_id, page_number), 2)) r from hg),
hn as (select *, """ + f"len({S.words('t')})" + r""" n, len(regexp_extract_all(t, '\p{L}')) l, len(regexp_extract_all(t, '\p{Lu}')) u from hm),
hs as (select *, case when n = 0 then 0 else greatest(0, least(1, case when r >= 1.4 then least(0.35, 0.08 * r) else 0 end::double + case when n between 1 and 15 then 0.15 else 0 end + case when n <= 5 then 0.1 else 0 end
  + case when l > 0 and u::double / l > 0.85 and n <= 10 then 0.2 when l > 0 and not regexp_matches(t, '[\p{Lu}\p{Ll}]\p{Lu}') and not regexp_matches(t, '(^|[^\p{Lu}\p{Ll}])\p{Ll}') and n <= 10 then 0.1 else 0 end
  + case when t like '%:' and n <= 12 then 0.15 else 0 end + case when t like '%.' or t like '%,' then 0 else 0.05 end + case when regexp_matches(t, '^\s*([0-9]+(\.[0-9]+)*|[A-Z])[\).\s-]+') then 0.1 else 0 end
  - case when n > 15 then 0.3 else 0 end - case when length(t) > 160 then 0.2 else 0 end)) end::double s from hn)"""],
    f"select document_id, element_id, {S.q6('case when page_type = $$native$$ then 0 else s end')} heading_score_final, page_type <> 'native' and s >= 0.45 - 1e-9 is_heading_candidate_final from hs"))
def _(spark, d):
    h = lo.positional_headings(lines(spark, d), types(spark, d))
    return h.select("document_id", "element_id", quantize(F.col("heading_score_final")).alias("heading_score_final"), "is_heading_candidate_final")


@query("l4_markdown", S.select([_LINES, """mk as (select *, length(text) % 9 = 0 h, length(text) % 11 = 0 g, trim(text) t from pl),
mp as (select document_id, page_number, '<!-- page_number: ' || page_number || ' -->' || chr(10) || coalesce(chr(10) || string_agg(case when h then chr(10) || '## ' || t || chr(10) else t end, chr(10) order by y0, x0, element_id)
  filter (not g and t <> ''), '') b from mk group by document_id, page_number)"""],
    r"""select document_id, sha256(regexp_replace(string_agg(b, chr(10) || chr(10) order by page_number), '^\s+|\s+$', '', 'g')) markdown_sha256 from mp group by 1"""))
def _(spark, d):
    x = lines(spark, d).withColumn("is_heading_candidate", F.length("text") % 9 == 0).withColumn("is_repeated_footer_candidate", F.length("text") % 11 == 0)
    return lo.to_markdown(x).select("document_id", F.sha2("markdown", 256).alias("markdown_sha256"))


def store(spark, name):
    return CorpusStore(spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


@query("s8_reopened_chunks", ORACLES["c1_fixed"])
def _(spark, d):
    s = store(spark, "corpus")
    s.ingest(inp.documents(spark, d))
    c = s.open()
    return chunking.finish(chunking.DEFAULT_CHUNKERS["fixed_512"](c), c, "fixed_512").select(*SPAN)


@query("s12_ingest", S.select([r"""hp as (select page_id document_id, list_filter(string_split(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
  '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article|table|ul|ol|blockquote|pre)>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda x: trim(x, ' ') <> '') ls from pages),
hl as (select document_id, unnest(ls) l, unnest(range(0, len(ls))) n from hp)"""],
    f"select document_id, (n // 40)::int page_number, count(*) line_count, sum(len({S.words('l')}))::bigint tokens, case when count(*) > 16 then 'scanned_ocr' else 'native' end page_type, 1 column_count from hl group by all"))
def _(spark, d):
    s = store(spark, "pages")
    p = inp.table(spark, d, "pages")
    s.ingest(p.select(F.col("page_id").alias("doc_id"), html_text("html").alias("text")))
    return s.open().pages.select(*KEY, "line_count", F.col("token_length").alias("tokens"), "page_type", "column_count")
