"""Chunking, graph, near-duplicate, dense, layout, temporal and numeric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import quantize
from docloom.functions.udtfs import register_table_functions
from docloom.operators import chunking as ch
from docloom.operators import indexing as ix
from docloom.operators import retrieval as rt
from docloom.operators import semantic as sem
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.lexical import bm25_base, bm25_ix, rrf_sql
from docloom.workloads.registry import ORACLES, query, register

SPAN = ["document_id", "strategy_name", "chunk_id", "chunk_kind", "start_index", "end_index", "token_length"]
W = S.words("text")
DOCW = f"docw as (select doc_id as document_id, {W} as w, len({W}) as n from documents)"
LINES = f"""ln0 as (select doc_id as document_id, unnest(ls) as text, unnest(range(0,len(ls))) as line_number from (select doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l,' ') <> '') as ls from documents)),
ln1 as (select *, len({W}) as tl from ln0),
lines as (select *, sum(tl) over (partition by document_id order by line_number)::bigint as e, (sum(tl) over (partition by document_id order by line_number) - tl)::bigint as s, line_number//40 as page, line_number//4 as block from ln1),
pages_ as (select document_id, page, min(s) as s, max(e) as e from lines group by 1,2),
blocks_ as (select document_id, block, min(s) as s, max(e) as e from lines group by 1,2)"""


def _fixed_sql(name, size, ov):
    st = size - ov
    return S.select([DOCW], f"""select document_id, '{name}' as strategy_name, ((s)//{st})::bigint as chunk_id, 'fixed_token' as chunk_kind, s::bigint as start_index,
 least(s+{size}, n)::bigint as end_index, (least(s+{size}, n)-s)::bigint as token_length from (select document_id, n, unnest(range(0, n, {st})) as s from docw) where s = 0 or s + {ov} < n""")


def _chunks(spark, d, name, fn=None):
    c = inp.corpus(spark, d)
    return ch.finish((fn or ch.DEFAULT_CHUNKERS[name])(c), c, name).select(*SPAN)


def _reg(key, name, sql):
    register(key, lambda s, d: _chunks(s, d, name), sql)


def _span_sql(name, kind, src, order, ctes=None):
    return S.select([*(ctes or [LINES])], f"""select document_id, '{name}' as strategy_name, row_number() over (partition by document_id order by {order})-1 as chunk_id,
 '{kind}' as chunk_kind, s as start_index, e as end_index, e-s as token_length from {src} where e > s""")


_reg("c1_fixed", "fixed_512", _fixed_sql("fixed_512", 512, 0))
_reg("c2_fixed_overlap", "fixed_512_overlap_100", _fixed_sql("fixed_512_overlap_100", 512, 100))
_reg("c3_fixed_1024", "fixed_1024_overlap_128", _fixed_sql("fixed_1024_overlap_128", 1024, 128))
_reg("c4_page", "page_based", _span_sql("page_based", "page", "pages_", "page"))
_reg("c5_page_window", "page_window_2_overlap_1", S.select([LINES, """pw0 as (select document_id, s, row_number() over w - 1 as i, count(*) over (partition by document_id) as n,
 max(e) over (partition by document_id order by page rows between current row and 1 following) as e from pages_ where e > s window w as (partition by document_id order by page))"""],
    "select document_id, 'page_window_2_overlap_1' as strategy_name, i as chunk_id, 'page_window' as chunk_kind, s as start_index, e as end_index, e-s as token_length from pw0 where i = 0 or i+1 < n"))
_reg("c6_block", "block_based", _span_sql("block_based", "block", "blocks_", "block"))
_reg("c7_line", "line_based_debug", _span_sql("line_based_debug", "line", "lines", "line_number"))
_reg("c9_block_group", "block_group_800_overlap_1", None)
_reg("c10_line_group", "line_group_512_overlap_2", None)

_SENT = f"""se0 as (select document_id, line_number, s, e, text, string_split(regexp_replace(trim(text,' '), '([.!?])[ \\t\\n\\r\\f]+([A-Z])', '\\1'||chr(31)||'\\2', 'g'), chr(31)) as ps from lines where e > s),
se1 as (select document_id, line_number, s, e, case when e-s > 40 and len(list_filter(ps, lambda x: trim(x,' ')<>'')) > 1 then list_filter(ps, lambda x: trim(x,' ')<>'') else [text] end as ps from se0),
se2 as (select document_id, line_number, s, e, len(ps) as k, unnest(ps) as p, unnest(range(0,len(ps))) as i from se1),
se3 as (select *, len({S.words('p')}) as l from se2),
se4 as (select *, greatest(1, round_even((e-s)*l/greatest(1, sum(l) over (partition by document_id, line_number)),0))::bigint as st from se3),
se5 as (select *, sum(st) over (partition by document_id, line_number order by i)::bigint as c from se4),
se6 as (select *, min(e-(k-i-1)-c) over (partition by document_id, line_number order by i) as sl from se5),
se7 as (select *, case when i = k-1 then e else least(s+c, c+sl) end as ei from se6),
sent as (select document_id, line_number, i, coalesce(lag(ei) over (partition by document_id, line_number order by i), s) as s, ei as e from se7)"""
_reg("c8_sentence", "sentence_based", _span_sql("sentence_based", "sentence", "sent", "line_number, i", [LINES, _SENT]).replace(" where e > s", ""))
_reg("c11_hierarchical", "hierarchical_child_256_parent_1200", S.select([DOCW, """pa as (select document_id, n, s as ps, least(s+1200,n) as pe, s//1080 as pid from (select document_id, n, unnest(range(0,n,1080)) as s from docw) where s = 0 or s+120 < n),
ki as (select *, unnest(range(ps, pe, 224)) as s from pa)"""], """select document_id, 'hierarchical_child_256_parent_1200' as strategy_name, row_number() over (partition by document_id order by pid, s)-1 as chunk_id,
 'hierarchical_child' as chunk_kind, s::bigint as start_index, least(s+256,pe)::bigint as end_index, (least(s+256,pe)-s)::bigint as token_length from ki where s = ps or s+32 < pe"""))


@query("c13_service_fixed", S.select([DOCW], "select document_id, (s//192)::bigint as chunk_id, s::bigint as start_index, least(s+256,n)::bigint as end_index from (select document_id, n, unnest(range(0,n,192)) as s from docw)"))
def _(spark, d):
    return ch.fixed_tokens(inp.corpus(spark, d), 256, 64, early_stop=False).select("document_id", "chunk_id", "start_index", "end_index")


@query("c14_service_pack")
def _(spark, d):
    docs = inp.documents(spark, d)
    a = ch.packed_units(docs, "sentence", 256, 32).withColumn("unit", F.lit("sentence"))
    return a.unionByName(ch.packed_units(docs, "paragraph", 256, 32).withColumn("unit", F.lit("paragraph")))


@query("c16_page_range", S.select([DOCW, LINES], """select c.document_id, c.s//412 as chunk_id, min(page)::int as page_start, max(page)::int as page_end from
 (select document_id, s, least(s+512,n) as e from (select document_id, n, unnest(range(0,n,412)) as s from docw) where s = 0 or s+100 < n) c
 left join pages_ p on p.document_id = c.document_id and p.e > c.s and p.s < c.e group by 1,2"""))
def _(spark, d):
    c = inp.corpus(spark, d)
    spans = ch.finish(ch.DEFAULT_CHUNKERS["fixed_512_overlap_100"](c), c, "fixed_512_overlap_100")
    return ch.page_ranges(spans, c.pages).select("document_id", "chunk_id", "page_start", "page_end")


@query("s9_decode_span", S.select([DOCW], "select document_id, array_to_string(w[s+1:least(s+64,n)],' ') as text, s::bigint as start_index from (select *, unnest(range(0,n,64)) as s from docw)"))
def _(spark, d):
    from docloom.sources.corpus import decode

    c = inp.corpus(spark, d)
    return decode(ch.fixed_tokens(c, 64), c).select("document_id", "text", "start_index")


@query("s3_elements", S.select([LINES], "select document_id, line_number::int as line_number, s as start_index, e as end_index, text from lines where page = 1"))
def _(spark, d):
    return inp.corpus(spark, d).elements_of("line", 1).select("document_id", "line_number", "start_index", "end_index", "text")


# -------------------------------------------------------------------- chunks as units
def line_units(spark, d):
    """Pages of documents as retrieval units with spans and sections."""
    c = inp.corpus(spark, d)
    meta = inp.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("primary_section"))
    p = c.pages.join(meta, "document_id")
    return p.select(
        (F.col("document_id") * 1000 + F.col("page_number")).alias("doc_idx"), "document_id", F.col("page_number").cast("bigint").alias("chunk_id"),
        F.lit("page_based").alias("chunk_strategy_name"), F.greatest(F.col("start_index") - 16, F.lit(0)).alias("start_index"), "end_index", "token_length",
        F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "primary_section", "text")


_PU = """pu as (select document_id*1000+page as doc_idx, document_id, page, greatest(s-16,0) as s, e, e-s as tl from pages_)"""
_EDGES = """seqe as (select doc_idx as a, lead(doc_idx) over (partition by document_id order by s, e, doc_idx) as b from pu),
edges as (select a as source_doc_idx, b as target_doc_idx, 'previous_next' as edge_type, 1.0::double as weight from seqe where b is not null
 union all select b, a, 'next_previous', 1.0::double from seqe where b is not null
 union all select l.doc_idx, r.doc_idx, 'token_overlap', (least(l.e,r.e)-greatest(l.s,r.s))::double/greatest(1,least(l.tl,r.tl)) from pu l join pu r on l.document_id = r.document_id and l.doc_idx <> r.doc_idx and l.s < r.e and r.s < l.e where l.e > l.s and r.e > r.s)"""


@query("i10_graph", S.select([LINES, _PU, _EDGES], f"select source_doc_idx, target_doc_idx, edge_type, {S.q6('weight')} as weight from edges"))
def _(spark, d):
    return ix.rounded(ix.chunk_graph_index(line_units(spark, d))["edges"], "weight")


_BASEP = f"""pt as (select doc_idx, unnest({S.toks('text')}) as term from (select document_id*1000+page as doc_idx, string_agg(text, chr(10) order by line_number) as text from lines group by document_id, page)),
post as (select doc_idx, term, count(*) as tf from pt group by 1,2), dl as (select doc_idx, count(*) as doc_len from pt group by 1),
stats as (select (select count(*) from pages_) as n, (select count(*) from pt)::double/(select count(*) from pages_) as avgdl)"""


@query("r23_graph", S.select([LINES, _PU, _EDGES, _BASEP, S.VOC, S.QT, S.bm25_ctes(10), f"""g as (select query_id, target_doc_idx as doc_idx, score*weight as score from bm25 join edges on doc_idx = source_doc_idx),
 u1 as (select *, source as sec from pu join documents on doc_id = document_id),
 g2 as (select query_id, b.doc_idx, score*0.35::double as score from bm25 join u1 a using (doc_idx) join u1 b on a.document_id = b.document_id and a.sec = b.sec and a.doc_idx <> b.doc_idx),
 gx as (select query_id, doc_idx, {S.q6('max(score)')} as score from (select query_id, doc_idx, score from bm25 union all select * from g union all select * from g2) group by 1,2)"""],
    f"select query_id, doc_idx, score, rank from {S.ranked('gx', 10)}"))
def _(spark, d):
    u = line_units(spark, d)
    q = inp.queries(spark, d)
    base = rt.bm25(q, ix.bm25_index(u.select("doc_idx", "text"), rt.query_terms(q)), 10)
    return rt.graph_expansion(base, ix.chunk_graph_index(u), 10)


@query("r22_context")
def _(spark, d):
    c = inp.corpus(spark, d)
    u = line_units(spark, d).withColumn("parent_start", F.greatest(F.col("start_index") - 100, F.lit(0))).withColumn("parent_end", F.col("end_index") + 100)
    q = inp.queries(spark, d)
    base = rt.bm25(q, ix.bm25_index(u.select("doc_idx", "text"), rt.query_terms(q)), 10)
    return rt.context_expansion(base, u, c.documents)


@query("r20_cross_chunk", S.select([S.LEX, S.bm25_ctes(20), LINES,
    "pbm as (with " + _BASEP + ",\n" + S.VOC + ",\n" + S.bm25_ctes(20, "pb") + " select query_id, doc_idx, rank from pb)",
    rrf_sql("(select query_id, doc_idx, rank from bm25 union all select query_id, -1-doc_idx, rank from pbm)")], "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def _(spark, d):
    """Two chunk strategies (whole documents, pages) fused; page units get
    negative keys so the strategies stay apart."""
    q = inp.queries(spark, d)
    pages = line_units(spark, d).select("doc_idx", "text")
    pb = rt.bm25(q, ix.bm25_index(pages, rt.query_terms(q)), 20).withColumn("doc_idx", -1 - F.col("doc_idx"))
    return rt.fuse([bm25_base(spark, d, 20), pb], 10)


# ------------------------------------------------------------------ near duplicates
_M = ix.MERSENNE31
_MINS = ", ".join(f"min((h*{ix.affine_seed(s)[0]}+{ix.affine_seed(s)[1]}) % {_M}) as m{s}" for s in range(64))
_BANDS = " union all ".join(
    f"select doc_idx, {b} as band_id, '{b}:' || ('0x' || substr(md5('{b}:' || " + " || ',' || ".join(f"m{b * 8 + i}::varchar" for i in range(8)) + "),1,15))::bigint as bucket from sig"
    for b in range(8))
_MINHASH = f"""mt as (select doc_id as doc_idx, {S.toks('text')} as t from documents),
msh as (select doc_idx, unnest(case when len(t) < 5 then t else {S.ngrams('t', 5)} end) as sh from mt),
mh as (select doc_idx, ('0x' || substr(md5('0:' || sh),1,15))::bigint % {_M} as h from msh),
sig as (select doc_idx, count(*) as shingle_count, {_MINS} from mh group by 1 union all by name select doc_idx, 0 as shingle_count, {", ".join(f"0 as m{s}" for s in range(64))} from mt where len(t) = 0),
bk as ({_BANDS})"""


@query("i15_minhash", S.select([_MINHASH], "select doc_idx, band_id, bucket from bk"))
def _(spark, d):
    return ix.minhash_index(inp.texts(spark, d))["buckets"]


@query("i15_links", S.select([_MINHASH], """select left_doc_idx, doc_idx as right_doc_idx, count(*) as shared_bucket_count from bk join (select bucket, min(doc_idx) as left_doc_idx from bk group by 1 having count(*) > 1) using (bucket)
 where doc_idx <> left_doc_idx group by 1,2"""))
def _(spark, d):
    return ix.minhash_index(inp.texts(spark, d))["links"]


@query("r13_duplicates", S.select([S.LEX, S.bm25_ctes(1), _MINHASH, """sd as (select query_id, doc_idx as seed from bm25),
 nb as (select query_id, o.doc_idx, count(*)::double as score, 0 as is_seed from sd join bk b on b.doc_idx = seed join bk o on o.bucket = b.bucket and o.doc_idx <> seed group by 1,2 union all select query_id, seed, 1.0::double, 1 from sd)"""],
    "select query_id, doc_idx, score, rank from (select *, row_number() over (partition by query_id order by is_seed desc, score desc, doc_idx) as rank from nb) where rank <= 10"))
def _(spark, d):
    return rt.duplicates(bm25_base(spark, d, 1).select("query_id", "doc_idx"), ix.minhash_index(inp.texts(spark, d)), 10)


# ------------------------------------------------------------------ dense
def vectors(spark, d):
    e = inp.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_idx"), F.col("embedding").cast("array<double>").alias("v"))
    return e.select("doc_idx", sem.l2_normalize(F.col("v")).alias("vector"))


def query_vectors(spark, d):
    v = vectors(spark, d).withColumnRenamed("doc_idx", "query_id")
    return v.join(inp.queries(spark, d).select("query_id"), "query_id", "left_semi")


_DENSE = f"""ve as (select vec_id as doc_idx, list_transform(embedding, lambda x: x::double) as v from embeddings),
vn as (select doc_idx, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) as v from ve),
ds as (select q.doc_idx as query_id, e.doc_idx, {S.q6('(list_inner_product(q.v, e.v)+1)/2')} as score from vn q join benchmark on item_id = q.doc_idx, vn e)"""


@query("r28_dense", S.select([_DENSE], f"select query_id, doc_idx, score, rank from {S.ranked('ds', 10)}"))
def r28_dense(spark, d):
    return sem.dense(query_vectors(spark, d), vectors(spark, d), 10)


@query("r29_hybrid", S.select([S.LEX, S.bm25_ctes(40), _DENSE, f"dr as {S.ranked('ds', 40)}",
    f"hy as (select query_id, doc_idx, {S.q6('sum(w/(60.0::double+rank))')} as score from (select query_id, doc_idx, rank, 0.7::double as w from bm25 union all select query_id, doc_idx, rank, 0.3::double from dr) group by 1,2)"],
    f"select query_id, doc_idx, score, rank from {S.ranked('hy', 10)}"))
def _(spark, d):
    return sem.hybrid(bm25_base(spark, d, 40), sem.dense(query_vectors(spark, d), vectors(spark, d), 40), 10, alpha=0.3)


_EMB = f"""em as (select doc_idx, ('0x' || substr(md5('0:' || term),1,15))::bigint % 64 as dim, count(*) as n from tok group by 1,2),
en as (select doc_idx, dim::int as dim, {S.q6('n/sqrt(sum(n*n) over (partition by doc_idx))')} as value from em)"""


@query("s16_embed", S.select([S.TOK, _EMB], "select * from en"))
def _(spark, d):
    return ix.rounded(sem.hashed_embedding(inp.texts(spark, d)), "value")


def hashed_provider(df):
    return sem.dense_vectors(sem.hashed_embedding(df))


@query("r30_hyde", S.select([S.TOK, f"""em as (select doc_idx, ('0x' || substr(md5('0:' || term),1,15))::bigint % 64 as dim, count(*)::double as n from tok group by 1,2),
 en as (select doc_idx, dim, n/sqrt(sum(n*n) over (partition by doc_idx)) as v from em),
 qm as (select query_id, ('0x' || substr(md5('0:' || term),1,15))::bigint % 64 as dim, sum(qtf)::double as n from qt group by 1,2),
 qn as (select query_id, dim, n/sqrt(sum(n*n) over (partition by query_id)) as v from qm),
 hs as (select query_id, doc_idx, {S.q6('(sum(qn.v*en.v)+1)/2')} as score from qn join en using (dim) group by 1,2)"""][:1] + [S.QT] + [f"""em as (select doc_idx, ('0x' || substr(md5('0:' || term),1,15))::bigint % 64 as dim, count(*)::double as n from tok group by 1,2),
 en as (select doc_idx, dim, n/sqrt(sum(n*n) over (partition by doc_idx)) as v from em),
 qm as (select query_id, ('0x' || substr(md5('0:' || term),1,15))::bigint % 64 as dim, sum(qtf)::double as n from qt group by 1,2),
 qn as (select query_id, dim, n/sqrt(sum(n*n) over (partition by query_id)) as v from qm),
 hs as (select query_id, doc_idx, {S.q6('(sum(qn.v*en.v)+1)/2')} as score from qn join en using (dim) group by 1,2)"""],
    f"select query_id, doc_idx, score, rank from {S.ranked('hs', 10)}"))
def _(spark, d):
    v = sem.embed_units(inp.texts(spark, d), hashed_provider)
    return sem.hyde(inp.queries(spark, d), v, hashed_provider, None, 10)


# ------------------------------------------------------------------ layout, dates, numbers
def page_boxes(spark, d):
    """Block tags of the web pages as layout boxes; the ordinal is the height."""
    p = inp.spread(inp.table(spark, d, "pages"))
    tags = F.regexp_extract_all("html", F.lit("<(h1|h2|p|li|td)[ >]"), F.lit(1))
    b = p.select(F.col("page_id").alias("document_id"), F.size(tags).alias("n"), F.posexplode(tags).alias("pos", "element_type"))
    y = (F.col("pos") + 0.5) / F.col("n")
    x = (F.col("document_id") % 10 + 0.5) / 10
    return b.select("document_id", F.col("pos").cast("bigint").alias("element_id"), "element_type", (F.col("pos") / 10).cast("int").alias("page_number"),
                    x.alias("center_x_norm"), y.alias("center_y_norm"), x.alias("x0_norm"), y.alias("y0_norm"), x.alias("x1_norm"), y.alias("y1_norm"))


def layout_units(spark, d):
    b = page_boxes(spark, d)
    return b.groupBy("document_id").agg(F.collect_list("element_id").alias("source_element_ids")).select(
        F.col("document_id").alias("doc_idx"), "document_id", "source_element_ids", F.lit("").alias("text"))


_LAY = """lx as (select page_id as doc_idx, unnest(t) as element_type, unnest(range(0,len(t))) as pos, len(t) as n from (select page_id, regexp_extract_all(html,'<(h1|h2|p|li|td)[ >]',1) as t from pages)),
lay as (select doc_idx, pos as element_id, element_type, (pos//10)::int as page_number, least(9,floor((doc_idx%10+0.5)/10*10))::int as x_bin, least(9,floor((pos+0.5)/n*10))::int as y_bin,
 case when (pos+0.5)/n < 0.2 then 'top' when (pos+0.5)/n > 0.8 then 'bottom' else 'middle' end as zone from lx)"""


@query("i14_layout", S.select([_LAY], "select * from lay"))
def _(spark, d):
    p = ix.layout_index(layout_units(spark, d), page_boxes(spark, d))["postings"]
    return p.select("doc_idx", "element_id", "element_type", "page_number", "x_bin", "y_bin", "zone")


@query("r12_layout", S.select([_LAY, S.QT, f"""lf as (select *, case when page_number in (0,1) then 2.0 else 0 end + case when zone = 'top' then 1.5 else 0 end + case when element_type in ('h1') then 1.0 else 0 end + case when x_bin in (2,3) then 0.75 else 0 end as f,
  list_distinct({S.toks("page_number||' '||zone||' '||element_type")}) as ts, row_number() over () as pid from lay),
 lm as (select distinct query_id, pid from (select pid, unnest(ts) as term from lf) join qt using (term)),
 lz as (select item_id as query_id, doc_idx, {S.q6('sum(f + case when lm.pid is not null then 1.0 else 0 end)::double')} as score from benchmark join lf on true left join lm on lm.query_id = item_id and lm.pid = lf.pid where f > 0 or lm.pid is not null group by 1,2)"""],
    f"select query_id, doc_idx, score, rank from {S.ranked('lz', 10)}"))
def _(spark, d):
    i = ix.layout_index(layout_units(spark, d), page_boxes(spark, d))
    return rt.layout_spatial(inp.queries(spark, d), i, 10, pages=[0, 1], zones=["top"], element_types=["h1"], x_bins=[2, 3])


def order_notes(spark, d):
    """One short note per order: dates and amounts as text."""
    o = inp.spread(inp.table(spark, d, "orders"))
    t = F.concat(F.lit("Seen on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", follow up "), F.date_format(F.col("o_orderdate") + F.expr("interval 30 days"), "M/d/yyyy"),
                 F.lit(". Dose "), (F.col("o_custkey") % 900).cast("string"), F.lit(" mg/dL, rate "), (F.col("o_orderkey") % 120).cast("string"), F.lit(" bpm."))
    return o.select(F.col("o_orderkey").alias("doc_idx"), t.alias("text"))


NOTES = """notes as (select o_orderkey as doc_idx, 'Seen on ' || strftime(o_orderdate,'%Y-%m-%d') || ', follow up ' || strftime(o_orderdate + interval 30 days,'%-m/%-d/%Y') || '. Dose ' || (o_custkey%900)::varchar || ' mg/dL, rate ' || (o_orderkey%120)::varchar || ' bpm.' as text from orders)"""
_DATES = """nd as (select distinct doc_idx, unnest(regexp_extract_all(text,'[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}')) as date_value from notes)"""


@query("i13_temporal", S.select([NOTES, _DATES], "select date_value, doc_idx from nd"))
def _(spark, d):
    return ix.temporal_index(order_notes(spark, d))["postings"]


def date_queries(spark, d):
    """Event days as date questions."""
    e = inp.table(spark, d, "nation")
    return e.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("seen on 1997-"), F.lpad((F.col("n_nationkey") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("n_nationkey") + 3).cast("string"), 2, "0")).alias("query"))


@query("r11_temporal", S.select([NOTES, _DATES, f"""dq as (select n_nationkey::bigint as query_id, 'seen on 1997-' || lpad((n_nationkey%12+1)::varchar,2,'0') || '-' || lpad((n_nationkey+3)::varchar,2,'0') as q from nation),
 dt as (select distinct query_id, t from (select query_id, unnest({S.toks('q')}) as t from dq) where regexp_matches(t,'[0-9]')),
 dv as (select distinct date_value from nd), dh as (select distinct query_id, date_value from dv join dt on contains(lower(date_value), t) union select query_id, date_value from dq, dv where date_value = '1998-01-02'),
 dsx as (select query_id, doc_idx, count(*)::double as score from dh join nd using (date_value) group by 1,2)"""],
    f"select query_id, doc_idx, score, rank from {S.ranked('dsx', 10)}"))
def _(spark, d):
    return rt.temporal(date_queries(spark, d), ix.temporal_index(order_notes(spark, d)), 10, date_values=["1998-01-02"])


def number_queries(spark, d):
    n = inp.table(spark, d, "nation")
    k = F.col("n_nationkey")
    s = lambda c: c.cast("string")
    q = (F.when(k % 5 == 0, F.concat(F.lit("dose > "), s(k * 30))).when(k % 5 == 1, F.concat(F.lit("dose between "), s(k * 10), F.lit(" and "), s(k * 10 + 5)))
         .when(k % 5 == 2, F.concat(F.lit("around "), s(k * 20))).when(k % 5 == 3, F.concat(F.lit("rate <= "), s(k))).otherwise(F.lit("dose rate follow up")))
    return n.select(k.cast("bigint").alias("query_id"), q.alias("query"))


_NUMQ = """nq as (select n_nationkey::bigint as query_id, n_nationkey as k, case n_nationkey%5 when 0 then 'dose > '||(n_nationkey*30) when 1 then 'between' when 2 then 'around' when 3 then 'rate <=' else 'dose rate follow up' end as q from nation),
nn as (select distinct doc_idx, regexp_extract(m,'[0-9]+')::double as v, lower(regexp_extract(m,'[a-zA-Z/%]+$')) as unit from (select doc_idx, unnest(regexp_extract_all(text,'([0-9]+(?:[.][0-9]+)?)[ \\t\\n\\r\\f]*([a-zA-Z/%]+)?')) as m from notes)),
nr as (select query_id, doc_idx, count(*)::double as score from nq, nn where case k%5 when 0 then v > k*30 when 1 then v >= k*10 and v <= k*10+5 when 2 then v >= k*20-k*20*0.15::double and v <= k*20+k*20*0.15::double when 3 then v <= k else false end group by 1,2),
tok as (select doc_idx, unnest(regexp_extract_all(lower(text),'[a-zA-Z0-9]+')) as term from notes),
stats as (select (select count(*) from notes) as n, (select count(*) from tok)::double/(select count(*) from notes) as avgdl),
qt as (select query_id, unnest(['dose','rate','follow','up']) as term, 1 as qtf from nq where k%5 = 4)"""


@query("r26_numeric", S.select([NOTES, _NUMQ, S.POST, S.DL, S.VOC, S.bm25_ctes(10), f"nx as (select query_id, doc_idx, score, rank from {S.ranked('nr', 10)} union all select query_id, doc_idx, score, rank from bm25)"], "select * from nx"))
def _(spark, d):
    t, q = order_notes(spark, d), number_queries(spark, d)
    return rt.numeric_range(q, ix.numeric_index(t), ix.bm25_index(t, rt.query_terms(q)), 10)


@query("i17_numeric_context")
def _(spark, d):
    return ix.numeric_context(order_notes(spark, d))


_ = (tx, quantize, bm25_ix)


@query("udtf_fixed", ORACLES["c1_fixed"])
def _(spark, d):
    """The fixed chunker as a table function in SQL."""
    register_table_functions(spark, "docloom_")
    docs = inp.documents(spark, d)
    return spark.sql("""select doc_id as document_id, 'fixed_512' as strategy_name, c.chunk_id, 'fixed_token' as chunk_kind, c.start_index, c.end_index, c.end_index - c.start_index as token_length
 from {docs}, lateral docloom_fixed_tokens(text, 512, 0) c""", docs=docs)
