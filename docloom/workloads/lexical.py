"""Index and lexical retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.scores import quantize
from docloom.operators import indexing as ix
from docloom.operators import retrieval as rt
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.registry import query

OUT = ["query_id", "doc_idx", "score", "rank"]


def qterms(spark, d):
    return rt.query_terms(inp.queries(spark, d))


def bm25_ix(spark, d):
    return ix.bm25_index(inp.texts(spark, d), only=qterms(spark, d))


def bm25_base(spark, d, k):
    return rt.bm25(inp.queries(spark, d), bm25_ix(spark, d), k)


# ------------------------------------------------------------------- indexes
@query("i1_bm25_vocab", S.select([S.TOK, S.POST, S.STATS, S.VOC], f"select term, df, {S.q6('idf')} as idf from voc"))
def _(spark, d):
    return ix.rounded(ix.bm25_index(inp.texts(spark, d))["vocab"], "idf")


@query("i1_bm25_postings", S.select([S.TOK, S.POST, S.DL], "select doc_idx, doc_len, term, tf from post join dl using (doc_idx)"))
def _(spark, d):
    return ix.bm25_index(inp.texts(spark, d))["postings"]


@query("i2_keyword", S.select([S.TOK, S.POST], "select doc_idx, term, tf from post"))
def _(spark, d):
    return ix.keyword_index(inp.texts(spark, d))["postings"].select("doc_idx", "term", "tf")


_FLAGS = ["contains_patient_id", "contains_vital", "contains_lab", "contains_medication", "contains_diagnosis", "contains_negation"]
_FLAG_SQL = " union all ".join(
    f"select doc_idx, '{f}', case when {f} then 'True' else 'False' end from units" for f in _FLAGS)


@query("i3_metadata", S.select([S.UNITS], f"""select doc_idx, field, value from (
 select doc_idx, 'document_type' as field, document_type as value from units union all
 select doc_idx, 'primary_section', primary_section from units union all {_FLAG_SQL} union all
 select distinct doc_idx, 'entity_type', entity_type from ents union all
 select doc_idx, 'section_name', primary_section from units union all select doc_idx, 'section_name', document_type from units)"""))
def _(spark, d):
    return ix.metadata_index(inp.units(spark, d))["postings"]


_TFIDF = """tv as (select term, ln((1+(select n from stats))/(1+count(*)))+1 as idf from post group by 1),
tw as (select doc_idx, term, tf, (0.5+0.5*tf/max(tf) over (partition by doc_idx))*idf as w from post join tv using (term)),
tp as (select doc_idx, term, tf, w/sqrt(sum(w*w) over (partition by doc_idx)) as weight from tw)"""


@query("i4_tfidf", S.select([S.TOK, S.POST, S.STATS, _TFIDF], f"select doc_idx, term, tf, {S.q6('weight')} as weight from tp"))
def _(spark, d):
    return ix.rounded(ix.tfidf_index(inp.texts(spark, d))["postings"], "weight").select("doc_idx", "term", "tf", "weight")


_PHRASE = f"""dt as (select doc_id as doc_idx, {S.toks('text')} as t from documents),
ph as (select doc_idx, phrase, count(*) as tf from (select doc_idx, unnest(list_concat({S.ngrams('t', 2)}, {S.ngrams('t', 3)})) as phrase from dt) group by 1,2)"""


@query("i5_phrase", S.select([_PHRASE], "select doc_idx, phrase, tf from ph"))
def _(spark, d):
    return ix.phrase_index(inp.texts(spark, d))["postings"].select("doc_idx", "phrase", "tf")


_CHAR = f"""ds as (select doc_id as doc_idx, string_split(array_to_string({S.toks('text')},' '),'') as s from documents),
ch as (select doc_idx, gram, count(*) as tf from (select doc_idx, unnest(list_concat({S.chargrams('s', 3)}, {S.chargrams('s', 4)}, {S.chargrams('s', 5)})) as gram from ds) group by 1,2)"""


@query("i6_char", S.select([_CHAR], "select gram, count(*) as df from ch group by 1"))
def _(spark, d):
    return ix.char_index(inp.texts(spark, d))["vocab"]


_FIELDED = f"""fl as (select field, term, doc_idx, count(*) as tf from (
 select 'body' as field, unnest({S.toks('text')}) as term, doc_idx from units union all
 select 'document_type', unnest({S.toks('document_type')}), doc_idx from units union all
 select 'primary_section', unnest({S.toks('primary_section')}), doc_idx from units union all
 select 'section_name', unnest({S.toks("primary_section||' '||document_type")}), doc_idx from units union all
 select 'entity_type', unnest({S.toks('entity_type')}), doc_idx from ents union all
 select 'entity_text', unnest({S.toks('text')}), doc_idx from ents union all
 select 'entity_normalized', unnest({S.toks('normalized_value')}), doc_idx from ents union all
 """ + " union all ".join(f"select 'clinical_flag', unnest(string_split('{f}','_')), doc_idx from units where {f}" for f in _FLAGS) + ") group by all)"


@query("i7_fielded", S.select([S.UNITS, _FIELDED], "select field, term, doc_idx, tf from fl"))
def _(spark, d):
    return ix.fielded_index(inp.units(spark, d))["postings"]


@query("i8_entity", S.select([S.UNITS], f"select doc_idx, entity_type, text as entity_text, normalized_value, {S.q6('confidence')} as confidence, is_negated from ents"))
def _(spark, d):
    p = ix.entity_index(inp.units(spark, d))["postings"]
    return ix.rounded(p, "confidence").select("doc_idx", "entity_type", "entity_text", "normalized_value", "confidence", "is_negated")


_SECPAGE = """sp as (select 'primary_section' as field, primary_section as value, doc_idx from units union all
 select 'document_type', document_type, doc_idx from units union all
 select 'page', unnest(range(page_start, page_end+1))::varchar, doc_idx from units union all
 select 'section_name', primary_section, doc_idx from units union all select 'section_name', document_type, doc_idx from units)"""


@query("i9_section_page", S.select([S.UNITS, _SECPAGE], "select field, value, doc_idx from sp"))
def _(spark, d):
    return ix.section_page_index(inp.units(spark, d))["postings"]


@query("i11_positional", f"""select doc_idx, term, count(*) as tf, min(pos) as first_position, max(pos) as last_position,
 string_agg(pos::varchar, ',' order by pos) as positions from (
 select doc_id as doc_idx, unnest({S.toks('text')}) as term, unnest(range(0, len({S.toks('text')})))::int as pos from documents) group by 1,2""")
def _(spark, d):
    p = ix.positional_index(inp.texts(spark, d))["postings"]
    return p.select("doc_idx", "term", "tf", "first_position", "last_position", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("i12_boolean", f"select doc_id as doc_idx, len(list_distinct({S.toks('text')}))::int as term_count, array_to_string(list_sort(list_distinct({S.toks('text')})),' ') as terms from documents")
def _(spark, d):
    b = ix.boolean_index(inp.texts(spark, d))["docs"]
    return b.select("doc_idx", "term_count", F.array_join("terms", " ").alias("terms"))


@query("i16_sentence", f"""with s as (select doc_id as doc_idx, string_split(regexp_replace(trim(text, ' '), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(31), 'g'), chr(31)) as ss from documents),
 e as (select doc_idx, unnest(ss) as sentence, unnest(range(0, len(ss)))::int as sentence_idx from s),
 p as (select term, doc_idx, sentence_idx, count(*) as n from (select doc_idx, sentence_idx, unnest({S.toks('sentence')}) as term from e) group by 1,2,3)
 select term, count(distinct doc_idx) as df, count(*) as sentence_df from p group by 1""")
def _(spark, d):
    return ix.sentence_index(inp.texts(spark, d))["vocab"]


_UNIT_CASE = "case " + " ".join(f"when u = '{k}' then '{v}'" for k, v in ix.UNIT_CLASS.items()) + " else 'generic' end"
_MAG = "case when v < 1 then 'sub_unit' when v < 10 then 'single_digit' when v < 100 then 'tens' when v < 1000 then 'hundreds' else 'thousands_plus' end"
_NUMERIC = f"""nm as (select doc_id as doc_idx, unnest(m) as m, unnest(range(0,len(m))) as i from (select doc_id, regexp_extract_all(text, '([0-9]+(?:[.][0-9]+)?)[ \\t\\n\\r\\f]*([a-zA-Z/%]+)?') as m from documents)),
nu as (select doc_idx, i, regexp_extract(m,'[0-9]+(?:[.][0-9]+)?')::double as v, lower(regexp_extract(m,'[a-zA-Z/%]+$')) as unit from nm),
nv as (select doc_idx, unit, arg_min(v, i) as v from nu group by doc_idx, unit, case when v < 1e12 then floor(v*1000+0.5)/1000 else v end),
np as (select doc_idx, v as numeric_value, unit, {_UNIT_CASE} as context_type, {_MAG} as magnitude_class from (select *, replace(unit,'/','') as u from nv))"""


@query("i17_numeric", S.select([_NUMERIC], "select * from np"))
def _(spark, d):
    return ix.numeric_index(inp.texts(spark, d))["postings"]


_COOC = """ty as (select doc_idx, entity_type as t, count(*) as n from ents group by 1,2 union all
 select doc_idx, t, 1 from (select doc_idx, unnest([case when contains_medication then 'medication_candidate' end, case when contains_diagnosis then 'diagnosis_or_problem_candidate' end,
  case when contains_vital then 'vital' end, case when contains_lab then 'lab_result' end]) as t from units) f
  where t is not null and not exists (select 1 from ents e where e.doc_idx = f.doc_idx and e.entity_type = f.t)),
co as (select a.doc_idx, a.t as type_a, b.t as type_b, least(a.n, b.n) as pair_count from ty a join ty b on a.doc_idx = b.doc_idx and a.t < b.t)"""


@query("i18_cooccurrence", S.select([S.UNITS, _COOC], "select type_a || '|' || type_b as pair, count(*) as pair_df, sum(pair_count)::bigint as total_count from co group by 1"))
def _(spark, d):
    return ix.cooccurrence_index(inp.units(spark, d))["vocab"]


# ---------------------------------------------------------------- retrievers
def _ranked(ctes, src, k=10):
    return S.select(ctes, f"select query_id, doc_idx, score, rank from {S.ranked(src, k)}")


@query("r1_bm25", S.select([S.LEX, S.bm25_ctes(10)], "select query_id, doc_idx, score, rank from bm25"))
def r1_bm25(spark, d):
    return bm25_base(spark, d, 10)


_KW = "kw as (select query_id, doc_idx, (sum(tf*qtf) + 2.0*count(*))::double as score, count(*) as matched from qt join post using (term) group by 1,2)"


@query("r2_keyword", _ranked([S.TOK, S.POST, S.QT, _KW], "kw"))
def r2_keyword(spark, d):
    return rt.keyword_exact(inp.queries(spark, d), ix.keyword_index(inp.texts(spark, d), qterms(spark, d)), 10)


@query("r2_keyword_all", _ranked([S.TOK, S.POST, S.QT, _KW, "ka as (select kw.* from kw join (select query_id, count(*) as n from qt group by 1) using (query_id) where matched = n)"], "ka"))
def r2_keyword_all(spark, d):
    return rt.keyword_exact(inp.queries(spark, d), ix.keyword_index(inp.texts(spark, d), qterms(spark, d)), 10, require_all_terms=True)


_TFQ = f"""qw0 as (select query_id, term, (0.5+0.5*qtf/max(qtf) over (partition by query_id))*idf as w from qt join tv using (term)),
qw as (select query_id, term, w/sqrt(sum(w*w) over (partition by (query_id))) as qw from (select q0.query_id, q0.term, (0.5+0.5*q0.qtf/q0.mx)*idf as w from (select *, max(qtf) over (partition by query_id) as mx from qt) q0 join tv using (term))),
tfs as (select query_id, doc_idx, {S.q6('sum(qw*weight)')} as score from qw join tp using (term) group by 1,2)"""


@query("r3_tfidf", _ranked([S.TOK, S.POST, S.STATS, S.QT, _TFIDF, _TFQ], "tfs"))
def r3_tfidf(spark, d):
    return rt.tfidf(inp.queries(spark, d), ix.tfidf_index(inp.texts(spark, d)), 10)


_QPH = f"""qd as (select item_id as query_id, {S.toks('text')} as t from benchmark),
qp as (select query_id, phrase, count(*) as qtf from (select query_id, unnest(list_concat({S.ngrams('t', 2)}, {S.ngrams('t', 3)})) as phrase from qd) group by 1,2),
phs as (select query_id, doc_idx, sum(qtf*len(string_split(phrase,' '))*tf)::double as score from qp join ph using (phrase) group by 1,2)"""


@query("r4_phrase", _ranked([_PHRASE, _QPH], "phs"))
def r4_phrase(spark, d):
    q = inp.queries(spark, d)
    return rt.phrase_ngram(q, ix.phrase_index(inp.texts(spark, d), rt.query_phrases(q)), 10)


_QCH = f"""qs as (select item_id as query_id, string_split(array_to_string({S.toks('text')},' '),'') as s from benchmark),
qc as (select query_id, gram, count(*) as qtf, sum(count(*)) over (partition by query_id) as total from (select query_id, unnest(list_concat({S.chargrams('s', 3)}, {S.chargrams('s', 4)}, {S.chargrams('s', 5)})) as gram from qs) group by 1,2),
chs as (select query_id, doc_idx, {S.q6('sum(least(tf,qtf))::double/any_value(total)')} as score from qc join ch using (gram) group by 1,2)"""


@query("r5_char", _ranked([_CHAR, _QCH], "chs"))
def r5_char(spark, d):
    q = inp.queries(spark, d)
    return rt.char_ngram(q, ix.char_index(inp.texts(spark, d), rt.query_char_grams(q)), 10)


_FW = "case field " + " ".join(f"when '{k}' then {v}::double" for k, v in rt.FIELD_WEIGHTS.items()) + " else 1::double end"
_FLS = f"fls as (select query_id, doc_idx, {S.q6(f'sum(qtf*{_FW}*tf)')} as score from qt join fl using (term) group by 1,2)"


@query("r6_fielded", _ranked([S.UNITS, _FIELDED, S.QT, _FLS], "fls"))
def r6_fielded(spark, d):
    return rt.fielded_lexical(inp.queries(spark, d), ix.fielded_index(inp.units(spark, d), qterms(spark, d)), 10)


_ENQ = f"""ex as (select doc_idx, text, confidence, unnest(list_distinct({S.toks("entity_type||' '||text||' '||normalized_value")})) as term from ents),
eh as (select query_id, doc_idx, text, confidence, count(*) as shared from ex join qt using (term) group by all),
es as (select query_id, doc_idx, {S.q6('sum(1+confidence+shared)')} as score from eh group by 1,2)"""


@query("r7_entity", _ranked([S.UNITS, S.QT, _ENQ], "es"))
def r7_entity(spark, d):
    return rt.entity(inp.queries(spark, d), ix.entity_index(inp.units(spark, d)), 10)


_R8 = f"""wp as (select *, row_number() over () as pid, ((field in ('primary_section','section_name') and lower(value) in ('src3','src7')) or (field = 'page' and value in ('2','5'))) as wanted,
  case when field in ('primary_section','section_name') then 2.0 else 1.0 end as w from sp),
wt as (select pid, unnest({S.toks('value')}) as term from wp),
hq as (select item_id as query_id, pid from wp, benchmark where wanted union select query_id, pid from wt join qt using (term)),
rs as (select query_id, doc_idx, {S.q6('sum(w)::double + any_value(clinical_quality_score)')} as score from hq join wp using (pid) join units using (doc_idx) group by 1,2)"""


@query("r8_section", _ranked([S.UNITS, S.QT, _SECPAGE, _R8], "rs"))
def r8_section(spark, d):
    return rt.section_page(inp.queries(spark, d), ix.section_page_index(inp.units(spark, d)), 10, sections=["src3", "src7"], pages=[2, 5])


_BOOL = f"""bs as (select query_id, doc_idx, {S.q6('count(*)::double/any_value(n)')} as score from qt join (select distinct doc_idx, term from post) using (term)
 join (select query_id, count(*) as n from qt group by 1) using (query_id) group by 1,2),
bq as (select bs.*, coalesce(quality,0) as quality from bs left join labels on doc_id = doc_idx)"""


@query("r9_boolean", S.select([S.TOK, S.POST, S.QT, _BOOL], f"select query_id, doc_idx, score, rank from {S.ranked('bq', 10, extra_order=', quality desc')}"))
def r9_boolean(spark, d):
    u = inp.units(spark, d)
    return rt.boolean_set(inp.queries(spark, d), ix.boolean_index(u, qterms(spark, d)), 10)


@query("r10_proximity")
def r10_proximity(spark, d):
    return rt.positional_proximity(inp.queries(spark, d), ix.positional_index(inp.texts(spark, d), qterms(spark, d)), 10)


@query("r14_filter", S.select([S.UNITS], f"""select doc_idx, {S.q6('1+clinical_quality_score')} as score from units
 where document_type = 'en' and primary_section in ('src1','src2','src3') and token_length >= 400 and contains_medication
 order by score desc, doc_idx limit 50"""))
def r14_filter(spark, d):
    return rt.metadata_filter(inp.units(spark, d), {
        "document_type": "en", "primary_section": ["src1", "src2", "src3"], "token_length": {"$gte": 400}, "contains_medication": True}, 50)


_BOOST = f"""bb as (select query_id, doc_idx, {S.q6("score/max(score) over (partition by query_id) + 0.2*clinical_quality_score + case when primary_section in ('src1','src2') then 0.2::double else 0 end + case when contains_lab then 0.15::double else 0 end")} as score
 from bm25 join units using (doc_idx)),
boost as {S.ranked('bb', None)}"""


def boosted(spark, d, k, fetch):
    return rt.metadata_boost(bm25_base(spark, d, fetch), inp.units(spark, d), k, ["src1", "src2"], ["contains_lab"])


@query("r15_boost", S.select([S.LEX, S.UNITS, S.bm25_ctes(50), _BOOST], "select query_id, doc_idx, score, rank from boost where rank <= 10"))
def r15_boost(spark, d):
    return boosted(spark, d, 10, 50)


_VARIANTS = "vq as (select item_id as query_id, unnest(range(0,len(vs)))::int as variant, unnest(vs) as q from (select item_id, case when trim(text,' ') = array_to_string({t},' ') then [trim(text,' ')] else list_concat([trim(text,' ')], {exp}, case when len({t})>0 then [array_to_string({t},' ')] else [] end) end as vs from benchmark))".format(
    t=S.toks("text"),
    exp="list_filter([" + ",".join(f"case when contains(lower(trim(text,' ')),'{k}') then trim(text,' ')||' {v}' end" for k, v in rt.QUERY_EXPANSIONS.items()) + "], lambda x: x is not null)")
_VQT = f"vqt as (select query_id, variant, term, count(*) as qtf from (select query_id, variant, unnest({S.toks('q')}) as term from vq) group by 1,2,3)"


def rrf_sql(src: str, name: str = "fused") -> str:
    return f"{name}_s as (select query_id, doc_idx, {S.q6('sum(1.0::double/(60.0::double+rank))')} as score from {src} group by 1,2),\n{name} as {S.ranked(name + '_s', None)}"


@query("r16_multi_query", S.select([S.LEX, _VARIANTS, _VQT, S.bm25_ctes(30, "vb", "vqt", "query_id, variant"), rrf_sql("vb")],
                                   "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def r16_multi_query(spark, d):
    q = inp.queries(spark, d)
    v = rt.default_variants(q)
    only = v.select(F.explode(ix.tx.tokens("query")).alias("term"))
    return rt.multi_query_bm25(q, ix.bm25_index(inp.texts(spark, d), only), 10, variants=v)


@query("r17_fusion", S.select([S.LEX, _KW, S.bm25_ctes(30), f"kwr as {S.ranked('kw', 30)}",
                              rrf_sql("(select query_id, doc_idx, rank from bm25 union all select query_id, doc_idx, rank from kwr)")],
                             "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def r17_fusion(spark, d):
    q, only = inp.queries(spark, d), qterms(spark, d)
    return rt.fuse([bm25_base(spark, d, 30), rt.keyword_exact(q, ix.keyword_index(inp.texts(spark, d), only), 30)], 10)


_ADV = ["bm25", "tfs", "kw", "fls", "phs", "chs", "bq"]


@query("r19_adv_fusion", S.select(
    [S.LEX, S.UNITS, _TFIDF, _TFQ, _KW, _FIELDED, _FLS, _PHRASE, _QPH, _CHAR, _QCH, _BOOL, S.bm25_ctes(30),
     *[f"{n}r as {S.ranked(n, 30, extra_order=', quality desc' if n == 'bq' else '')}" for n in _ADV[1:]],
     rrf_sql("(" + " union all ".join(f"select query_id, doc_idx, rank from {n if n == 'bm25' else n + 'r'}" for n in _ADV) + ")")],
    "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def r19_adv_fusion(spark, d):
    """Seven of the eight default lists; the proximity list has its own query
    and joins the fusion in ``LexicalSearch.advanced_fusion``."""
    q, t, u = inp.queries(spark, d), inp.texts(spark, d), inp.units(spark, d)
    only = qterms(spark, d)
    return rt.fuse([
        bm25_base(spark, d, 30), rt.tfidf(q, ix.tfidf_index(t), 30), rt.keyword_exact(q, ix.keyword_index(t, only), 30),
        rt.fielded_lexical(q, ix.fielded_index(u, only), 30), rt.phrase_ngram(q, ix.phrase_index(t, rt.query_phrases(q)), 30),
        rt.char_ngram(q, ix.char_index(t, rt.query_char_grams(q)), 30), rt.boolean_set(q, ix.boolean_index(u, only), 30)], 10)


@query("r21_mmr")
def r21_mmr(spark, d):
    return rt.mmr_diversity(boosted(spark, d, 50, 250), inp.texts(spark, d), 10)


_ABBR = "[" + ",".join("{'a':'%s','e':'%s'}" % (a, e) for a, es in rt.ABBREVIATIONS.items() for e in es) + "]"
_EXPV = f"""ab as (select unnest({_ABBR}, recursive := true)),
abo as (select a, e, row_number() over () as ord from ab),
bt as (select item_id, text, unnest({S.toks('text')}) as t, unnest(range(0,len({S.toks('text')}))) as tp from benchmark),
bp as (select item_id, any_value(text) as text, e, arg_min(t, tp*1000+ord) as t, min(tp*1000+ord) as o from bt join abo on t = a group by item_id, e),
vq as (select item_id as query_id, 0::int as variant, text as q from benchmark union all
 select item_id, v::int, regexp_replace(text, '\\b'||t||'\\b', e, 'gi') from (select *, row_number() over (partition by item_id order by o) as v from bp) where v <= 4)"""


@query("r24_expansion", S.select([S.LEX, _EXPV, _VQT, S.bm25_ctes(20, "vb", "vqt", "query_id, variant"), rrf_sql("vb")],
                                 "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def r24_expansion(spark, d):
    q = inp.queries(spark, d)
    v = rt.abbreviation_variants(q)
    only = v.select(F.explode(ix.tx.tokens("query")).alias("term"))
    return rt.variant_fusion(v, ix.bm25_index(inp.texts(spark, d), only), 10, 20)


_EFUS = f"""et0 as (select item_id as query_id, regexp_extract_all(text,'\\b[A-Z][a-z]{{2,}}(?: [A-Z][a-z]{{2,}})*\\b') as caps, list_filter({S.toks('text')}, lambda x: length(x) >= 4) as lt from benchmark),
et1 as (select query_id, unnest(list_transform(list_concat(ordc, ordt)[1:8], lambda x: lower(x))) as term, unnest(range(0, len(list_concat(ordc, ordt)[1:8]))) as term_no from (
 select query_id, list_filter(caps, lambda x, i: list_position(caps,x)=i) as ordc, list_filter(lt, lambda x, i: list_position(lt,x)=i and not list_contains(list_transform(caps, lambda c: lower(c)), x)) as ordt from et0)),
ev as (select distinct normalized_value as value, doc_idx from ents),
em as (select term, term as value from (select distinct term from et1) t where exists (select 1 from ev where value = term)),
ef as (select distinct t.term, v.value from (select distinct term from et1 where term not in (select term from em)) t join (select distinct value from ev) v on contains(v.value, t.term) or contains(t.term, v.value)),
el0 as (select distinct query_id, term_no, doc_idx from et1 join (select * from em union all select * from ef) using (term) join ev using (value)),
el as (select query_id, doc_idx, rank from (select *, row_number() over (partition by query_id, term_no order by doc_idx) as rank from el0) where rank <= 20)"""


@query("r25_entity_fusion", S.select([S.LEX, S.UNITS, _EFUS, S.bm25_ctes(20), rrf_sql("(select query_id, doc_idx, rank from bm25 union all select * from el)")],
                                     "select query_id, doc_idx, score, rank from fused where rank <= 10"))
def r25_entity_fusion(spark, d):
    return rt.entity_centric_fusion(inp.queries(spark, d), bm25_ix(spark, d), ix.entity_index(inp.units(spark, d)), 10)


_NEG = f"""ng as (select doc_idx, list_distinct(flatten(list({S.toks('text')}))) as neg from ents where is_negated group by 1),
nq as (select query_id, list(term) as qterms from qt group by 1),
ns as (select query_id, doc_idx, {S.q6("score*(1-0.35*case when contains_negation then coalesce(len(list_intersect(qterms, neg))::double/len(qterms),0) else 0 end)")} as score
 from bm25 join units using (doc_idx) join nq using (query_id) left join ng using (doc_idx))"""


@query("r27a_negation", _ranked([S.LEX, S.UNITS, S.bm25_ctes(30), _NEG], "ns"))
def r27a_negation(spark, d):
    return rt.negation_aware(bm25_base(spark, d, 30), inp.queries(spark, d), inp.units(spark, d), 10)


_SCOPE = f"""sc0 as (select query_id, doc_idx, score, primary_section in ('src1','src2','src3') as sc from bm25 join units using (doc_idx)),
sc1 as (select *, count_if(sc) over (partition by query_id) >= 3 as enough from sc0),
sc2 as (select query_id, doc_idx, {S.q6('case when not enough and sc then score*1.25 else score end')} as score from sc1 where not enough or sc)"""


@query("r27b_scoped", _ranked([S.LEX, S.UNITS, S.bm25_ctes(40), _SCOPE], "sc2"))
def r27b_scoped(spark, d):
    return rt.section_scoped(bm25_base(spark, d, 40), inp.units(spark, d), 10, sections=["src1", "src2", "src3"])


@query("r32_union", _ranked([S.LEX, _KW, S.bm25_ctes(10), f"kwr as {S.ranked('kw', 10)}",
                             f"um as (select query_id, doc_idx, {S.q6('max(score)')} as score from (select query_id, doc_idx, score from bm25 union all select query_id, doc_idx, score from kwr) group by 1,2)"], "um", 20))
def r32_union(spark, d):
    q, only = inp.queries(spark, d), qterms(spark, d)
    return rt.union_max([bm25_base(spark, d, 10), rt.keyword_exact(q, ix.keyword_index(inp.texts(spark, d), only), 10)], 10)


_ = quantize
