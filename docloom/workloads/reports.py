"""Evaluation, layout, query-understanding, context and citation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.scores import islands, quantize
from docloom.operators import chunking as ch
from docloom.operators import evaluation as ev
from docloom.operators import generation as gen
from docloom.operators import layout as lo
from docloom.operators import query_understanding as qu
from docloom.operators import reranking as rk
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.lexical import _KW, bm25_base, r1_bm25, r2_keyword
from docloom.workloads.registry import query
from docloom.workloads.rerank import BASE, KEYWORD, cands
from docloom.workloads.structure import DOCW, LINES

r6 = lambda c: quantize(F.col(c))


def chunk_set(spark, d):
    c = inp.corpus(spark, d)
    out = None
    for n in ("fixed_512_overlap_100", "page_based", "block_based"):
        x = ch.finish(ch.DEFAULT_CHUNKERS[n](c), c, n).select("document_id", "strategy_name", "chunk_id", "start_index", "end_index", "token_length")
        out = x if out is None else out.unionByName(x)
    return c, out


CS = [DOCW, LINES, """cs as (select document_id, 'fixed_512_overlap_100' as strategy_name, s::bigint as s, least(s+512,n)::bigint as e from (select document_id, n, unnest(range(0,n,412)) as s from docw) where s = 0 or s+100 < n
 union all select document_id, 'page_based', s, e from pages_ where e > s union all select document_id, 'block_based', s, e from blocks_ where e > s),
cl as (select strategy_name, (e-s)::double as x from cs)"""]


@query("a1_merge", S.select([*CS, """m0 as (select *, max(e) over (partition by document_id, strategy_name order by s, e rows between unbounded preceding and 1 preceding) as pe from cs),
 m1 as (select *, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by document_id, strategy_name order by s, e rows unbounded preceding) as g from m0)"""],
    "select document_id, strategy_name, min(s) as start_index, max(e) as end_index from m1 group by document_id, strategy_name, g"))
def _(spark, d):
    return islands(chunk_set(spark, d)[1], ["document_id", "strategy_name"], "start_index", "end_index")


@query("a2_coverage")
def _(spark, d):
    c, x = chunk_set(spark, d)
    return ev.coverage(x, c.documents)


@query("a3_align", S.select([*CS, """eb as (select document_id, 'line' as t, unnest([s,e]) as p from lines union select document_id, 'block', unnest([s,e]) from blocks_),
 pt as (select document_id, strategy_name, 'start' as side, s as p from cs union all select document_id, strategy_name, 'end', e from cs)"""],
    f"""select strategy_name, k.t as element_type, side, {S.q6('avg(case when eb.p is not null then 1 else 0 end)*100')} as aligned_pct from pt join (values ('line'),('block')) k(t) on true
 left join eb on eb.document_id = pt.document_id and eb.t = k.t and eb.p = pt.p group by 1,2,3"""))
def _(spark, d):
    c, x = chunk_set(spark, d)
    return ev.boundary_alignment(x, c.elements).withColumn("aligned_pct", r6("aligned_pct"))


@query("a3_points_inside", S.select(CS, """select strategy_name, count(*) as starts_inside from cs where exists (select 1 from blocks_ b where b.document_id = cs.document_id and b.s < cs.s and cs.s < b.e) group by 1"""))
def _(spark, d):
    c, x = chunk_set(spark, d)
    return ev.points_inside(x, c.elements, "block")


@query("a4_gini", S.select([*CS, "gr as (select *, row_number() over (partition by strategy_name order by x) as i from cl)"],
    f"select strategy_name, {S.q6('2*sum(i*x)/(count(*)*sum(x)) - (count(*)+1)::double/count(*)')} as gini from gr group by 1"))
def _(spark, d):
    return ev.gini(chunk_set(spark, d)[1], ["strategy_name"], "token_length").withColumn("gini", r6("gini"))


@query("a5_entropy", S.select([*CS, "bo as (select strategy_name, min(x) as lo, max(x) as hi, count(*) as n from cl group by 1)",
    "hb as (select strategy_name, case when hi = lo then 0 else least(19, floor((x-lo)/(hi-lo)*20)) end as b, count(*)::double/any_value(n) as p from cl join bo using (strategy_name) group by 1,2)"],
    f"select strategy_name, {S.q6('greatest(0, -sum(p*log2(p)))')} as entropy_bits from hb group by 1"))
def _(spark, d):
    return ev.entropy_bits(chunk_set(spark, d)[1], ["strategy_name"], "token_length").withColumn("entropy_bits", r6("entropy_bits"))


@query("a6_page_cov")
def _(spark, d):
    c, x = chunk_set(spark, d)
    return ev.page_coverage(x, c.pages).withColumn("coverage_pct", r6("coverage_pct"))


_P = lambda p: f"quantile_cont(x,{p})"


@query("a7_chunk_metrics", S.select(CS, f"""select strategy_name, count(*) as chunk_count, min(x) as min_tokens, {S.q6(_P(0.1))} as p10_tokens, {S.q6(_P(0.5))} as median_tokens, {S.q6('avg(x)')} as mean_tokens,
 {S.q6(_P(0.9))} as p90_tokens, {S.q6(_P(0.95))} as p95_tokens, max(x) as max_tokens, {S.q6('stddev_pop(x)')} as std_tokens, {S.q6(_P(0.75) + '-' + _P(0.25))} as iqr_tokens,
 count_if(x<10)::bigint as empty_chunks_lt_10, count_if(x<50)::bigint as tiny_chunks_lt_50, count_if(x<128)::bigint as small_chunks_lt_128, count_if(x>=128 and x<512)::bigint as medium_chunks_128_to_511,
 count_if(x>=512 and x<=1024)::bigint as large_chunks_512_to_1024, count_if(x>1024)::bigint as oversized_chunks_gt_1024, {S.q6('stddev_pop(x)/greatest(1e-9, avg(x))')} as cv_tokens from cl group by 1"""))
def _(spark, d):
    m = ev.length_metrics(chunk_set(spark, d)[1])
    for c in ("p10_tokens", "median_tokens", "mean_tokens", "p90_tokens", "p95_tokens", "std_tokens", "iqr_tokens", "cv_tokens"):
        m = m.withColumn(c, r6(c))
    return m


_COLS = ["document_type", "primary_section", "clinical_quality_score", "text", "date_values"]


@query("a8_completeness", S.select([S.UNITS], """select 'document' as chunk_strategy_name, k as "column", n as non_null_count, c as chunk_count, k <> 'date_values' as present, 100.0::double*n/c as coverage_pct from
 (select count(*) as c, [count(document_type), count(primary_section), count(clinical_quality_score), count(text), 0] as ns from units), (select unnest(['document_type','primary_section','clinical_quality_score','text','date_values']) as k, unnest(range(1,6)) as i) x, lateral (select ns[i] as n)"""))
def _(spark, d):
    return ev.completeness(inp.units(spark, d), "chunk_strategy_name", _COLS)


_FL = ["contains_lab", "contains_vital", "contains_negation"]


@query("a8_flag_prevalence", S.select([S.UNITS], " union all ".join(f"select document_type, '{f}' as flag, {S.q6(f'avg({f}::int::double)*100')} as true_pct from units group by 1" for f in _FL)))
def _(spark, d):
    return ev.flag_prevalence(inp.units(spark, d), "document_type", _FL).withColumn("true_pct", r6("true_pct"))


@query("a16_section_distribution", S.select([S.UNITS], f"select document_type, primary_section as value, count(*) as count, {S.q6('count(*)::double/sum(count(*)) over (partition by document_type)')} as share from units group by 1,2"))
def _(spark, d):
    return ev.distribution(inp.units(spark, d), "document_type", "primary_section").withColumn("share", r6("share"))


@query("a8_suspicious", S.select([S.UNITS], """select doc_idx, array_to_string(list_filter([case when token_length < 200 then 'short' end, case when contains_lab and clinical_quality_score < 0.5 then 'low quality' end, case when not contains_medication then 'no terms' end], lambda x: x is not null), '; ') as reasons
 from units where token_length < 200 or (contains_lab and clinical_quality_score < 0.5) or not contains_medication"""))
def _(spark, d):
    c = F.col
    return ev.suspicious(inp.units(spark, d), {"short": c("token_length") < 200, "low quality": c("contains_lab") & (c("clinical_quality_score") < 0.5), "no terms": ~c("contains_medication")}, ["doc_idx"])


@query("a9_inventory", "select source as strategy_name, k as index_name, k in ('bm25','tfidf') and max(doc_id%2) = 1 as exists from documents, (values ('bm25'),('tfidf'),('entity')) t(k) group by 1,2")
def _(spark, d):
    docs = inp.documents(spark, d)
    built = docs.filter("doc_id % 2 = 1").select(F.col("source").alias("strategy_name"), F.explode(F.array(F.lit("bm25"), F.lit("tfidf"))).alias("index_name"))
    return ev.index_inventory(docs.select(F.col("source").alias("strategy_name")).distinct(), ["bm25", "tfidf", "entity"], built)


def truth(spark, d):
    """Documents containing a benchmark passage verbatim.  Passages and
    documents meet on the passage's first five tokens (a shingle join), then
    the whole passage is compared."""
    from docloom.functions import text as tx

    q = inp.queries(spark, d).withColumn("g", F.array_join(F.slice(tx.tokens("query"), 1, 5), " "))
    docs = inp.texts(spark, d)
    grams = docs.select("doc_idx", F.explode(F.array_distinct(tx.word_ngrams(tx.tokens("text"), 5))).alias("g"))
    hit = grams.join(q, "g").join(docs, "doc_idx")
    return hit.filter(F.contains("text", F.col("query"))).select("query_id", "doc_idx").distinct()


_TRUTH = "tr as (select item_id as query_id, doc_id as doc_idx from benchmark join documents on contains(documents.text, benchmark.text) and len(" + S.toks("benchmark.text") + ") >= 5)"
_HITS = [S.LEX, _KW, S.bm25_ctes(10), f"kwr as {S.ranked('kw', 10)}",
         "hits as (select 'bm25' as retriever, query_id, doc_idx, rank from bm25 union all select 'keyword', query_id, doc_idx, rank from kwr)"]
_SCORES = """sco as (select retriever, query_id, coalesce(1.0::double/min(case when tr.doc_idx is not null then rank end),0) as mrr, count_if(tr.doc_idx is not null and rank<=1)::double/least(1,count(*)) as p1,
 count_if(tr.doc_idx is not null and rank<=3)::double/least(3,count(*)) as p3, count_if(tr.doc_idx is not null and rank<=5)::double/least(5,count(*)) as p5 from hits left join tr using (query_id, doc_idx) group by 1,2)"""


def hits(spark, d):
    a = r1_bm25(spark, d).withColumn("retriever", F.lit("bm25"))
    return a.unionByName(r2_keyword(spark, d).withColumn("retriever", F.lit("keyword")))


@query("a10_mrr", S.select([*_HITS, _TRUTH, _SCORES], f"select retriever, query_id, {S.q6('mrr')} as mrr, {S.q6('p1')} as precision_at_1, {S.q6('p3')} as precision_at_3, {S.q6('p5')} as precision_at_5 from sco"))
def _(spark, d):
    s = ev.retrieval_scores(hits(spark, d), truth(spark, d), 10, ["retriever"])
    return s.select("retriever", "query_id", *[r6(c).alias(c) for c in ("mrr", "precision_at_1", "precision_at_3", "precision_at_5")])


@query("a11_summary", S.select([*_HITS, _TRUTH, _SCORES], f"select retriever, count(*) as query_count, {S.q6('avg(mrr)')} as mean_mrr, {S.q6('avg(p5)')} as mean_precision_at_5 from sco group by 1"))
def _(spark, d):
    s = ev.retrieval_scores(hits(spark, d), truth(spark, d), 10, ["retriever"])
    m = ev.summarize(s, ["retriever"], ["mrr", "precision_at_5"])
    return m.withColumn("mean_mrr", r6("mean_mrr")).withColumn("mean_precision_at_5", r6("mean_precision_at_5"))


@query("a12_agreement", S.select([*_HITS, "hl as (select query_id, retriever, list(doc_idx) as l from hits group by 1,2)"],
    f"select x.retriever as a, y.retriever as b, {S.q6('avg(len(list_intersect(x.l,y.l))::double/(len(x.l)+len(y.l)-len(list_intersect(x.l,y.l))))')} as mean_jaccard from hl x join hl y using (query_id) group by 1,2"))
def _(spark, d):
    return ev.agreement(hits(spark, d)).withColumn("mean_jaccard", r6("mean_jaccard"))


@query("a13_diversity")
def _(spark, d):
    return ev.list_diversity(hits(spark, d), inp.units(spark, d), 10, ["retriever"])


@query("a14_movement", S.select([*BASE, f"k0 as (select query_id, doc_idx, rank as o, {S.q6(KEYWORD)} as s from cand)", "k1 as (select *, row_number() over (partition by query_id order by s desc, o) as n from k0)"],
    f"""select query_id, {S.q6('avg(abs(o-n))')} as mean_abs_rank_delta, max(abs(o-n))::double as max_abs_rank_delta, count_if(o>n)::bigint as promoted_count, count_if(o<n)::bigint as demoted_count,
 max(case when n = 1 then (o<>1)::int end) as top_result_changed, {S.q6('1.0-6.0*sum((o-n)*(o-n))/greatest(1.0, count(*)::double*(count(*)*count(*)-1))')} as spearman_rho from k1 group by 1"""))
def _(spark, d):
    m = ev.rank_movement(rk.keyword_overlap(cands(spark, d)))
    return m.withColumn("mean_abs_rank_delta", r6("mean_abs_rank_delta")).withColumn("spearman_rho", r6("spearman_rho"))


@query("a17_ranking", S.select([*_HITS, _TRUTH, _SCORES, f"fr as (select retriever as name, {S.q6('0.25*avg(p1) + 0.65*avg(mrr) + 0.10*(1.0/(1.0+count(*)/100.0::double))')} as final_score from sco group by 1)"],
    "select name, final_score, row_number() over (order by final_score desc, name) as config_rank from fr"))
def _(spark, d):
    s = ev.retrieval_scores(hits(spark, d), truth(spark, d), 10, ["retriever"])
    g = s.groupBy(F.col("retriever").alias("name")).agg(F.avg("precision_at_1").alias("foundation"), F.avg("mrr").alias("quality"), F.count("*").cast("double").alias("latency_ms"))
    return ev.config_ranking(g).select("name", "final_score", "config_rank")


# ------------------------------------------------- query understanding, context
@query("g1_expand")
def _(spark, d):
    return qu.expand(inp.queries(spark, d))


@query("g2_classify", "select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), $${p}$$) then '{n}'" for n, p in qu.QUERY_TYPES) + " else 'factual' end as query_type from conversations")
def _(spark, d):
    c = inp.table(spark, d, "conversations")
    return c.select("conv_id", "turn", qu.classify(F.col("text")).alias("query_type"))


def context_rows(spark, d):
    b = bm25_base(spark, d, 20)
    t = inp.texts(spark, d)
    return b.join(t, "doc_idx").select("query_id", F.col("doc_idx").alias("chunk_id"), "score", (F.col("doc_idx") % 7).cast("int").alias("page_start"), "text")


@query("g6_budget", S.select([S.LEX, S.bm25_ctes(20), DOCW, "gb as (select query_id, doc_idx as chunk_id, n as token_count, rank as citation_number, sum(n) over (partition by query_id order by rank)::bigint as used_tokens from bm25 join docw on document_id = doc_idx)"],
    "select query_id, chunk_id, token_count, citation_number, used_tokens from gb where used_tokens <= 3000"))
def _(spark, d):
    return gen.assemble(context_rows(spark, d), 3000).select("query_id", "chunk_id", "token_count", "citation_number", "used_tokens")


def labelled_rows(spark, d):
    """Hits with the pages, section and flags of their units."""
    u = inp.units(spark, d).select("doc_idx", "page_start", "page_end", F.col("primary_section").alias("section"),
                                   *[f"contains_{f}" for f in gen.CONTEXT_FLAGS], "text")
    return bm25_base(spark, d, 20).join(u, "doc_idx").withColumnRenamed("doc_idx", "chunk_id")


_STRIP = "regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


@query("g8_context", S.select([S.LEX, S.bm25_ctes(20), DOCW, S.UNITS, f"""gb as (select query_id, rank, n, sum(n) over (partition by query_id order by rank) <= 3000 as fits,
  '[' || rank || '] ' || case when page_start = page_end then 'Page ' || (page_start + 1) else 'Pages ' || (page_start + 1) || '\u2013' || (page_end + 1) end
   || coalesce(' | ' || nullif(primary_section, ''), '') || coalesce(' (' || nullif(concat_ws(', ', {", ".join(f"case when contains_{f} then '{f}' end" for f in gen.CONTEXT_FLAGS)}), '') || ')', '') as header,
  {_STRIP} as body from bm25 join docw on document_id = doc_idx join units using (doc_idx))""",
    "gt as (select query_id, string_agg(repeat('\u2500', least(60, length(header) + 4)) || chr(10) || header || chr(10) || repeat('\u2500', least(60, length(header) + 4)) || chr(10) || body, chr(10) || chr(10) order by rank) filter (fits) as t, "
    "coalesce(sum(n) filter (fits), 0)::bigint as total_tokens, count(*) filter (not fits) as truncated_count from gb group by 1)"],
    f"select item_id as query_id, coalesce(rtrim(t, chr(10)), '{gen.NO_EVIDENCE}') as formatted_text, coalesce(total_tokens, 0)::bigint as total_tokens, coalesce(truncated_count, 0) > 0 as truncated, coalesce(truncated_count, 0)::bigint as truncated_count from benchmark left join gt on query_id = item_id"))
def _(spark, d):
    return gen.contexts(inp.queries(spark, d), labelled_rows(spark, d), 3000).drop("citation_map")


_ASK = [*qu.QUERY_MEDICATIONS, *qu.QUERY_SECTIONS]
_SHORT = list(qu.QUERY_ABBREVIATIONS)
# those with a mark inside are no single word
_MARKED = "[" + ", ".join(f"case when regexp_matches(q, '(^|[^\\pL\\pN_]){a}($|[^\\pL\\pN_])') then '{a}' end" for a in _SHORT if not a.isalnum()) + "]"
_RE = lambda names: "regexp_extract_all(q, '(?i)\\b(" + "|".join(names) + ")\\b')"


@query("g3_entities", f"""with a as (select conv_id, turn, coalesce(text, '') || ' ' || upper(({_ASK!r})[(conv_id % {len(_ASK)})::int + 1]) || ' plan, ' || ({_SHORT!r})[(turn * 7 + conv_id)::int % {len(_SHORT)} + 1] || ' Plan' as q from conversations),
 b as (select *, regexp_extract_all(q, '[\\pL\\pN_]+') || {_MARKED} as w from a)
 select conv_id, turn, lower(array_to_string({_RE(qu.QUERY_MEDICATIONS)}, ',')) as medications,
  (select string_agg(s, ',' order by i) from (select s, min(i) as i from (select unnest(list_transform({_RE(qu.QUERY_SECTIONS)}, lambda x: lower(x))) as s, generate_subscripts({_RE(qu.QUERY_SECTIONS)}, 1) as i) group by s)) as sections,
  array_to_string(list_filter({_SHORT!r}, lambda k: list_contains(w, k)), ',') as abbreviations from b""")
def _(spark, d):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    c = inp.table(spark, d, "conversations")
    asked = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.upper(pick(_ASK, F.col("conv_id"))), F.lit(" plan, "), pick(_SHORT, F.col("turn") * 7 + F.col("conv_id")), F.lit(" Plan"))
    p = c.select("conv_id", "turn", qu.query_entities(asked).alias("e"))
    return p.select("conv_id", "turn", *[F.array_join(f"e.{f}", ",").alias(n) for f, n in (("medications", "medications"), ("sections", "sections"), ("abbreviations_found", "abbreviations"))])


def answers(spark, d):
    """Replies of the benchmark as answers: each passage cites chunk 1."""
    return inp.queries(spark, d).select("query_id", "query", F.concat("query", F.lit(" [1]")).alias("answer"))


@query("g10_citations")
def _(spark, d):
    return gen.resolve_citations(answers(spark, d), gen.assemble(context_rows(spark, d), 3000))


@query("g12_sentence_citations")
def _(spark, d):
    a = inp.queries(spark, d).select("query_id", "query", F.col("query").alias("answer"))
    return gen.sentence_citations(a, gen.assemble(context_rows(spark, d), 3000))


@query("a18_answer_metrics")
def _(spark, d):
    return gen.answer_metrics(answers(spark, d), gen.assemble(context_rows(spark, d), 3000))


# ---------------------------------------------------------------------- layout
def layout_lines(spark, d):
    c = inp.corpus(spark, d).elements_of("line")
    y = F.col("line_number") % 40
    x = c.select("document_id", "element_id", "page_number", "line_number", "text", (y < 4).alias("is_top_zone"), (y > 35).alias("is_bottom_zone"),
                 (8 + F.col("line_number") % 3 + F.length("text") % 2).cast("double").alias("max_font_size"), (F.length("text") % 5 == 0).alias("contains_bold"))
    return lo.text_shape(x)


@query("l2_headers")
def _(spark, d):
    r = lo.repeated_lines(layout_lines(spark, d))
    return r.filter("is_repeated_header_candidate or is_repeated_footer_candidate").select("document_id", "element_id", "norm")


@query("l3_headings")
def _(spark, d):
    return lo.heading_scores(layout_lines(spark, d)).select("document_id", "element_id", quantize(F.col("heading_score")).alias("heading_score"), "is_heading_candidate")


@query("l5_heading_path")
def _(spark, d):
    h = lo.heading_scores(layout_lines(spark, d))
    return lo.heading_paths(h, ["page_number", "element_id"]).select("document_id", "element_id", "heading_path")


@query("l8_reading_order", S.select([LINES, "ro as (select document_id, line_number*4+2 as element_id, page, ((line_number%4)+0.5)/4 as x, line_number/40.0::double as y from lines)",
    "rm as (select *, median(x) over (partition by document_id, page) as m from ro)"],
    "select document_id, element_id::bigint as element_id, row_number() over (partition by document_id, page order by (x>m)::int, y, x, element_id)-1 as reading_order from rm"))
def _(spark, d):
    c = inp.corpus(spark, d).elements_of("line")
    b = c.select("document_id", "element_id", "page_number", ((F.col("line_number") % 4 + 0.5) / 4).alias("center_x_norm"), (F.col("line_number") / 40.0).alias("y0_norm")).withColumn("x0_norm", F.col("center_x_norm"))
    return lo.reading_order(b).select("document_id", "element_id", "reading_order")


@query("h1_highlight")
def _(spark, d):
    """Benchmark passages located as word windows in the documents that hold them."""
    from docloom.functions import text as tx

    t = truth(spark, d)
    docs = inp.texts(spark, d).join(t.select("doc_idx").distinct(), "doc_idx", "left_semi")
    w = docs.select(F.col("doc_idx").alias("document_id"), F.lit(0).alias("page_number"), F.posexplode(tx.words("text")).alias("word_no", "text"))
    q = t.join(inp.queries(spark, d), "query_id").select(F.col("doc_idx").alias("document_id"), F.col("query_id").alias("quote_id"), F.col("query").alias("quote"))
    return lo.quote_windows(w, q).withColumn("score", r6("score"))
