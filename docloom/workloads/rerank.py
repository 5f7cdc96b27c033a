"""Reranker queries: BM25 top 20 per benchmark passage, reordered."""

from __future__ import annotations

from docloom.operators import reranking as rk
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.lexical import bm25_base
from docloom.workloads.registry import register


def cands(spark, d):
    return rk.candidates(bm25_base(spark, d, 20), inp.queries(spark, d), inp.units(spark, d))


NORM = "case when max(score) over w <= min(score) over w then case when max(score) over w > 0 then 1.0 else 0.0 end else (score-min(score) over w)/(max(score) over w-min(score) over w) end"


def norm(x: str) -> str:
    return NORM.replace("score", x)


_LONG = "list_filter({}, lambda t: length(t) > 2)"
CAND = f"""ea as (select doc_idx, list(text) as etext, list(normalized_value) as enorm, list(entity_type) as etypes, count(*) as ne,
  list_distinct(flatten(list({S.toks("text||' '||normalized_value")}))) as ets,
  list_distinct(flatten(list({S.toks("text||' '||normalized_value")}) filter (is_negated))) as nts from ents group by 1),
c0 as (select b.query_id, b.doc_idx, b.score, b.rank, bm.text as q, u.*exclude(doc_idx), u.text as pv from bm25 b join benchmark bm on item_id = query_id join units u on u.doc_idx = b.doc_idx),
c1 as (select *, {S.toks('q')} as qt, {S.toks('pv')} as tt from c0),
cand as (select c1.*, list_distinct(qt) as qd, coalesce(ne,0) as ne, coalesce(etypes,[]) as etypes, coalesce(ets,[]) as ets, coalesce(nts,[]) as nts from c1 left join ea using (doc_idx))"""
BASE = [S.LEX, S.UNITS, S.bm25_ctes(20), CAND]


def sql_for(expr: str, extra: list[str] | None = None, src: str = "cand") -> str:
    body = f"""select query_id, doc_idx, rank as original_rank, score as original_score, rerank_score,
 row_number() over (partition by query_id order by rerank_score desc, rank)::int as rank from (
 select query_id, doc_idx, rank, score, {S.q6(expr)} as rerank_score from {src} window w as (partition by query_id))"""
    return S.select(BASE + (extra or []), body)


MATCH = "list_transform(qd, lambda t: least(len(list_filter(qt, lambda x: x=t)), len(list_filter(tt, lambda x: x=t))))"
KEYWORD = f"5.0::double*len(list_filter({MATCH}, lambda n: n>0))/len(qd) + ln(1+list_sum({MATCH}))"
METADATA = ("clinical_quality_score + case when primary_section <> '' then 0.15::double else 0 end + least(0.25::double, 0.05::double*ne) + 0.05::double*("
            + "+".join(f"{f}::int" for f in rk.QUALITY_FLAGS) + ")")


def _lst(xs):
    return "[" + ",".join(f"'{x}'" for x in xs) + "]"


ON = {n: f"list_has_any(qd, {_lst(t)})" for n, (t, _, _) in rk.INTENTS.items()}
NONE = "not (" + " or ".join(ON.values()) + ")"
CLINICAL = " + ".join(
    f"(case when ({NONE}) or {ON[n]} then {flag}::int::double + least(1, len(list_filter(etypes, lambda e: list_contains({_lst(types)}, e))))::double"
    f" + case when len(list_intersect(list_intersect(qd, {_lst(t)}), tt)) > 0 then 0.5 else 0 end else 0 end)"
    for n, (t, flag, types) in rk.INTENTS.items())
LEN = "case when token_length between 128 and 1200 then 1.0::double when token_length < 128 then token_length/128.0::double else 1200.0::double/token_length end"
LENGTH = f"0.65::double*{NORM} + 0.35::double*{LEN}"
DATE_RE = "([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})"
RECENT = (f"case when list_has_any(qd, {_lst(rk.TEMPORAL_TERMS)}) or regexp_matches(q, '\\b{DATE_RE}\\b') then 0.6::double*{NORM} + "
          f"0.4::double*least(1.0::double, 0.25::double*len(regexp_extract_all(pv, '\\b{DATE_RE}\\b'))) else {NORM} end")


def cover(terms: str) -> str:
    return f"coalesce(len(list_intersect({_LONG.format('qd')}, {_LONG.format(terms)}))::double/nullif(len({_LONG.format('qd')}),0),0)"


BONUS = {"src1": 0.25, "src2": -0.15, **rk.SECTION_BONUS}
SECTION = "case lower(trim(primary_section)) " + " ".join(f"when '{k}' then {v}::double" for k, v in BONUS.items()) + " else 0 end"
MIXED = [f"mx as (select *, {S.q6(KEYWORD)} as kws, {S.q6(METADATA)} as mds, {S.q6(CLINICAL)} as cls, {S.q6(LENGTH)} as lns from cand window w as (partition by query_id))"]
MIX = " + ".join(f"{w}::double*({norm(c)})" for w, c in ((0.35, "score"), (0.25, "kws"), (0.20, "mds"), (0.15, "cls"), (0.05, "lns")))
RESCORE = ["""ct as (select query_id, doc_idx, score, rank, count(*) over w as n, len(tt) as dlen, greatest(1.0, avg(len(tt)) over w) as avl, qt, tt, unnest(list_filter(qd, lambda t: length(t)>1)) as term from cand window w as (partition by query_id)),
cf as (select *exclude(qt,tt,n,avl), (select count(*) from cand c where c.query_id = ct.query_id) as n, (select greatest(1.0,avg(len(c.tt))) from cand c where c.query_id = ct.query_id) as avl,
 len(list_filter(qt, lambda x: x=term)) as qtf, len(list_filter(tt, lambda x: x=term)) as tf from ct),
cg as (select *, sum(case when tf>0 then 1 else 0 end) over (partition by query_id, term) as df from cf),
ch2 as (select query_id, doc_idx, score, rank, sum(case when tf>0 then qtf*ln(1+(n-df+0.5)/(df+0.5))*tf*2.2::double/(tf+1.2::double*(0.25::double+0.75::double*dlen/avl)) else 0 end) as raw from cg group by all)"""]

register("k1_passthrough", lambda s, d: rk.score_passthrough(cands(s, d)), sql_for("score"))
register("k2_keyword", lambda s, d: rk.keyword_overlap(cands(s, d)), sql_for(KEYWORD))
register("k3_proximity", lambda s, d: rk.phrase_proximity(cands(s, d)))
register("k4_quality", lambda s, d: rk.metadata_quality(cands(s, d)), sql_for(METADATA))
register("k5_intent", lambda s, d: rk.clinical_intent(cands(s, d)), sql_for(CLINICAL))
register("k6_length", lambda s, d: rk.length_penalty(cands(s, d)), sql_for(LENGTH))
register("k7_recency", lambda s, d: rk.recency_date(cands(s, d)), sql_for(RECENT))
register("k8_mmr", lambda s, d: rk.diversity_mmr(cands(s, d), 10))
register("k9_dedup", lambda s, d: rk.deduplicate(cands(s, d), 10))
register("k10_hybrid", lambda s, d: rk.hybrid_weighted(cands(s, d)), sql_for(MIX, MIXED, "mx"))
register("k11_entity", lambda s, d: rk.entity_coverage(cands(s, d)), sql_for(f"0.45::double*{NORM} + 0.55::double*{cover('ets')}"))
register("k12_section", lambda s, d: rk.section_priority(cands(s, d), bonus=BONUS),
         sql_for(f"greatest(0.0, least(1.0, {NORM} + {SECTION}))"))
register("k13_bm25_rescore", lambda s, d: rk.bm25_rescore(cands(s, d)), sql_for("raw/greatest(max(raw) over w, 1e-9)", RESCORE, "ch2"))
register("k14_negation", lambda s, d: rk.negation_filter(cands(s, d)),
         sql_for(f"greatest(0.0, {NORM} - 0.4::double*case when contains_negation then {cover('nts')} else 0 end)"))
register("k15_position", lambda s, d: rk.position_bias_correction(cands(s, d)), sql_for(f"0.6::double*{NORM} + 0.4::double/(rank+20)"))


def k16_chain(s, d):
    return rk.rerank_chain(["keyword_overlap", "position_bias_correction"], bm25_base(s, d, 20), inp.queries(s, d), inp.units(s, d), 10)


register("k16_chain", k16_chain)
