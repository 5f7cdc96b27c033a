"""SQL fragments the reference queries are assembled from (DuckDB dialect)."""

from __future__ import annotations

TOK_RE = "[a-zA-Z0-9]+"


def q6(x: str) -> str:
    return f"floor(({x})*1e6+0.5)/1e6"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x},'')),'{TOK_RE}')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"


def ngrams(t: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{t}[i+{j}]" for j in range(n))
    return f"list_transform(range(1, len({t})-{n}+2), lambda i: {joined})"


def chargrams(s: str, n: int) -> str:
    """``s`` is a list of single characters."""
    joined = " || ".join(f"{s}[i+{j}]" for j in range(n))
    return f"list_transform(range(1, len({s})-{n}+2), lambda i: {joined})"


TOK = f"tok as (select doc_id as doc_idx, unnest({toks('text')}) as term from documents)"
POST = "post as (select doc_idx, term, count(*) as tf from tok group by 1,2)"
DL = "dl as (select doc_idx, count(*) as doc_len from tok group by 1)"
STATS = "stats as (select (select count(*) from documents) as n, (select count(*) from tok)::double/(select count(*) from documents) as avgdl)"
VOC = "voc as (select term, count(*) as df, ln(1+((select n from stats)-count(*)+0.5)/(count(*)+0.5)) as idf from post group by 1)"
QT = f"qt as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({toks('text')}) as term from benchmark) group by 1,2)"
LEX = ",\n".join([TOK, POST, DL, STATS, VOC, QT])

BM25_EXPR = "qtf*idf*tf*2.5/(tf+1.5*(1-0.75+0.75*doc_len/(select avgdl from stats)))"


def ranked(src: str, k: int | None, part: str = "query_id", score: str = "score", extra_order: str = "") -> str:
    """Ranked rows of a (query_id, doc_idx, score) relation."""
    cond = f" where rank <= {k}" if k is not None else ""
    return (
        f"(select * from (select *, row_number() over (partition by {part} order by {score} desc{extra_order}, doc_idx) as rank "
        f"from {src}){cond})"
    )


def bm25_ctes(k: int | None, name: str = "bm25", qt: str = "qt", part: str = "query_id") -> str:
    return (
        f"{name}_s as (select {part}, doc_idx, {q6('sum(' + BM25_EXPR + ')')} as score from {qt} join post using (term) "
        f"join voc using (term) join dl using (doc_idx) group by all),\n"
        f"{name} as {ranked(name + '_s', k, part)}"
    )


ENTITY_WORD = "[A-Z][a-z]{7,}"
UNITS = f"""units as (
 select d.doc_id as doc_idx, lang as document_type, source as primary_section, n_chars as token_length,
  (d.doc_id % 7)::int as page_start, (d.doc_id % 7 + n_chars % 3)::int as page_end,
  contains(text,'@') as contains_patient_id, regexp_matches(text,'[0-9]') as contains_lab,
  regexp_matches(text,'[A-Z][a-z]{{9}}') as contains_medication, contains(text,'?') as contains_diagnosis,
  contains(text,'http') as contains_vital, regexp_matches(text,'(^|[^a-z])(not|nicht|pas|no)([^a-z]|$)') as contains_negation,
  coalesce(quality,0)::double as clinical_quality_score, text
 from documents d left join labels l on d.doc_id = l.doc_id),
ents as (select doc_idx, w as text, lower(w) as normalized_value,
  case length(w)%4 when 0 then 'medication_candidate' when 1 then 'diagnosis_or_problem_candidate' when 2 then 'vital' else 'lab_result' end as entity_type,
  0.5::double+(length(w)%5)/10.0::double as confidence, length(w)%3=0 as is_negated
 from (select doc_id as doc_idx, unnest(list_distinct(regexp_extract_all(text,'{ENTITY_WORD}'))) as w from documents))"""


def select(ctes: list[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body
