"""Extraction and enrichment queries over notes written from orders.

Every order becomes a ten-line note; its numbers, dates and phrases come from
the order's columns.  ``NOTE_LINE`` is one CASE expression valid in both SQL
dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import quantize
from docloom.operators import enrichment as en
from docloom.operators import extraction as xt
from docloom.operators import vocab as V
from docloom.sources.io import by_key, stored
from docloom.workloads import inputs as inp
from docloom.workloads import sqltext as S
from docloom.workloads.registry import query

NOTE_LINE = """case i
 when 0 then case o_orderkey % 3 when 0 then 'DISCHARGE SUMMARY' when 1 then 'Progress Note for office visit' else 'Radiology Report: CT scan' end
 when 1 then 'MRN: A' || cast(1000 + o_custkey as string) || ' DOB: 1/2/19' || cast(50 + o_custkey % 40 as string) || ' ' || cast(20 + o_custkey % 70 as string) || ' year old male'
 when 2 then 'Vital Signs:'
 when 3 then 'BP: ' || cast(100 + o_orderkey % 80 as string) || '/' || cast(60 + o_orderkey % 30 as string) || ' HR: ' || cast(60 + o_custkey % 50 as string) || ' bpm'
 when 4 then 'Medications:'
 when 5 then case o_orderkey % 4 when 0 then 'Take metformin 500 mg tablet daily.' when 1 then 'lisinopril 10 mg po bid. Not taking aspirin.' when 2 then 'Atorvastatin 40 mg at night.' else 'No current drugs.' end
 when 6 then 'Assessment and Plan:'
 when 7 then case o_custkey % 4 when 0 then 'No evidence of pneumonia. Patient has hypertension.' when 1 then 'History of diabetes mellitus, stable.' when 2 then 'Denies chest pain. Asthma J45.909 and type 2 diabetes.' else 'Follow up in clinic 3/14/2024 with MRI of knee after arthroscopy.' end
 when 8 then 'Laboratory Results:'
 else 'Glucose: ' || cast(80 + o_orderkey % 200 as string) || ' mg/dL, sodium low ' || cast(120 + o_custkey % 20 as string) || case o_orderkey % 5 when 0 then ', allergic to penicillin.' when 1 then '. NKDA, no reaction to latex.' when 2 then '; latex allergy, lactose intolerance.' when 3 then ', reaction to iodinated contrast medium; mild.' else ', allergy to a drug whose name and dose nobody at this clinic could find.' end end"""


def note_lines(spark, d):
    o = inp.spread(inp.table(spark, d, "orders")).select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("i").cast("bigint").alias("element_id"),
                    F.floor(F.col("i") / 5).cast("int").alias("page_number"), F.expr(NOTE_LINE).alias("text"))


NL = f"""nl as (select o_orderkey as document_id, i::bigint as element_id, (i//5)::int as page_number, {NOTE_LINE} as text
 from (select o_orderkey, o_custkey, unnest(range(0,10)) as i from orders))"""


def sectioned(spark, d):
    return xt.assign_sections(note_lines(spark, d))


_SEC = """ns as (select *, case element_id when 0 then case when text like 'Radio%' then null when text like 'DISCH%' then null end when 2 then 'vitals' when 4 then 'medications' when 6 then 'assessment' when 8 then 'labs' end as k from nl),
nsec as (select *exclude(k), last_value(k ignore nulls) over (partition by document_id order by element_id rows unbounded preceding) as section_name, k as section_key from ns)"""


@query("e1_doctype", S.select([NL, "nt as (select document_id, lower(string_agg(text, chr(10) order by element_id)) as b from nl group by 1)",
    "sc as (" + " union all ".join(
        f"select document_id, '{n}' as t, {-i} as o, floor(least(1.0, {' + '.join(f'case when regexp_matches(b, $${p}$$) then {w}::double else 0 end' for p, w in pats)})*1e6+0.5)/1e6 as s from nt"
        for i, (n, pats) in enumerate(V.DOCUMENT_TYPES.items())) + ")"],
    "select document_id, case when max(s) <= 0 then 'Unknown' else arg_max(t, s*1000+o) end as document_type, case when max(s) <= 0 then 0 else floor(least(0.97, 0.5+max(s))*1e6+0.5)/1e6 end as confidence from sc group by 1"))
def _(spark, d):
    t = by_key(note_lines(spark, d), "document_id").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return xt.classify_documents(t)


@query("e2_sections", S.select([NL, _SEC], """select document_id, section_name, min(page_number) as page_start, max(page_number) as page_end, min(element_id) as start_element, max(element_id) as end_element, count(*) as line_count
 from nsec where section_name is not null group by document_id, section_name"""))
def _(spark, d):
    s = xt.extract_sections(sectioned(spark, d))
    return s.select("document_id", "section_name", "page_start", "page_end", "start_element", "end_element", "line_count")


@query("e3_detect_section")
def _(spark, d):
    """Heading rules over the lines of the text corpus."""
    lines = inp.corpus(spark, d).elements_of("line").select("document_id", "element_id", "page_number", "text")
    return xt.detect_section(lines).filter("section_key is not null").select("document_id", "element_id", "section_key", quantize(F.col("section_confidence"), 3).alias("confidence"))


def _rule_sql(keep) -> str:
    parts = []
    for r in xt.rules():
        if r.entity_type not in keep:
            continue
        clean = "lower(trim(regexp_replace(text,'[ \\t\\n\\r\\f]+',' ','g')))"
        found = f"regexp_extract_all({clean if r.lower else 'text'}, $re${r.pattern}$re$)" + ("[1:1]" if r.fixed else "")
        m = "substr(text, 1, 80)" if r.fixed else f"trim(m, '{xt.ENDS}')" if r.ends else "m"
        norm = f"'{r.fixed}'" if r.fixed else f"regexp_extract({m}, $re${r.pattern}$re$, {r.group})" if r.group else m
        norm = f"trim(lower({norm}))" if r.norm_lower else f"trim({norm})"
        boost = f"least({r.cap}::double, {r.confidence}::double + case when section_name in ({','.join(repr(b) for b in r.boost)}) then 0.15::double else 0 end)" if r.boost else f"{r.confidence}::double"
        kept = [f"length({norm}) >= {r.min_len}"]
        kept += [f"not regexp_matches({clean}, $re${r.unless}$re$)"] if r.unless else []
        kept += [f"section_name in ({','.join(repr(x) for x in r.only)})"] if r.only else []
        parts.append(f"select document_id, element_id, '{r.entity_type}' as entity_type, {m} as entity_text, {norm} as normalized_value, {S.q6(boost)} as confidence, '{r.source}' as source from (select *, unnest({found}) as m from nsec) where {' and '.join(kept)}")
    return " union all ".join(parts)


def _entity_query(name, keep):
    sql = S.select([NL, _SEC], _rule_sql(keep))

    def run(spark, d):
        rs = [r for r in xt.rules() if r.entity_type in keep]
        e = xt.pattern_entities(sectioned(spark, d), rs)
        return e.select("document_id", "element_id", "entity_type", "entity_text", "normalized_value", quantize(F.col("confidence")).alias("confidence"), "source")

    query(name, sql)(run)


_entity_query("e5_dates", {"date"})
_entity_query("e6_patient_ids", {"patient_identifier"})
_entity_query("e7_vitals", {"vital"})
_entity_query("e8_labs", {"lab_result"})
_entity_query("e9_med_patterns", {"medication_class", "medication_candidate"})
_entity_query("e10_dx_patterns", {"diagnosis_code", "past_diagnosis"})
_entity_query("e11_imaging", {"imaging"})
_entity_query("e12_procedures", {"procedure"})
_entity_query("e13_allergies", {"allergy", "allergy_nkda"})
_entity_query("e14_demographics", {"demographics_dob", "demographics_gender"})


def terms(spark, words):
    return spark.createDataFrame([(w,) for w in words], "term string")


def _dict_sql(words, etype, conf, cap, boost):
    """Longest term of a line: its n-grams, of the lengths the terms have, meet the terms."""
    values = ",".join("('" + w.replace("'", "''") + "')" for w in words)
    return f"""select document_id, element_id, '{etype}' as entity_type, term as entity_text, {S.q6(f"least({cap}::double, {conf}::double + case when section_name in ({','.join(repr(b) for b in boost)}) then 0.15::double else 0 end)")} as confidence
 from (select ln.*, tv.term from (select *, unnest(range(1, len(w) + 1)) p from (select document_id, element_id, section_name, regexp_extract_all(lower(text), '[0-9a-z]+') w from nsec)) ln,
   (select distinct len(regexp_extract_all(term, '[0-9a-z]+')) z from (values {values}) v(term)) sz
  join (select term, len(regexp_extract_all(term, '[0-9a-z]+')) z, array_to_string(regexp_extract_all(term, '[0-9a-z]+'), ' ') g from (values {values}) v(term)) tv on tv.z = sz.z and tv.g = array_to_string(ln.w[p:p + sz.z - 1], ' ')
  qualify row_number() over (partition by document_id, element_id order by length(tv.term) desc, tv.term) = 1)"""


_MEDB, _DXB = ("medications", "plan", "discharge_instructions"), ("assessment", "chief_complaint", "hpi", "impression", "postoperative_diagnosis", "findings")


@query("e9_meds", S.select([NL, _SEC], _dict_sql(V.MEDICATIONS, "medication", 0.78, 0.92, _MEDB)))
def _(spark, d):
    e = xt.dictionary_entities(sectioned(spark, d), terms(spark, V.MEDICATIONS), "medication", 0.78, _MEDB, 0.92)
    return e.select("document_id", "element_id", "entity_type", "entity_text", quantize(F.col("confidence")).alias("confidence"))


@query("e10_dx", S.select([NL, _SEC], _dict_sql(V.CONDITIONS, "diagnosis_or_problem", 0.70, 0.88, _DXB)))
def _(spark, d):
    e = xt.dictionary_entities(sectioned(spark, d), terms(spark, V.CONDITIONS), "diagnosis_or_problem", 0.70, _DXB, 0.88)
    return e.select("document_id", "element_id", "entity_type", "entity_text", quantize(F.col("confidence")).alias("confidence"))


def entities(spark, d):
    return xt.extract_entities(sectioned(spark, d), terms(spark, V.MEDICATIONS), terms(spark, V.CONDITIONS))


_NEGRE = "(?i)" + "|".join(f"(?:{p})" for p in V.NEGATION)


_CLEAN = "lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')))"
_NEG_SQL = S.select([NL, _SEC, "dx as (" + _dict_sql(V.CONDITIONS, "diagnosis_or_problem", 0.70, 0.88, _DXB) + ")",
    f"""dn as (select dx.document_id, dx.element_id, entity_text, text, {_CLEAN} as low, string_split(regexp_replace(trim(text, ' '), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(31), 'g'), chr(31)) as ss from dx join nl using (document_id, element_id)),
 ds as (select document_id, element_id, unnest(ss) s, unnest(range(0, len(ss))) i from dn),
 dh as (select document_id, element_id, arg_min(s, i) h from ds join dx using (document_id, element_id) where contains(lower(trim(regexp_replace(s, '[ \\t\\n\\r\\f]+', ' ', 'g'))), entity_text) group by all),
 dw as (select dn.*, h, instr(low, entity_text) p from dn left join dh using (document_id, element_id))"""],
    f"""select document_id, element_id, entity_text, regexp_matches(coalesce(h, case when p > 0 then substr(low, greatest(1, p - 120), p - greatest(1, p - 120) + length(entity_text)) end, text), $${_NEGRE}$$) as is_negated from dw""")


@query("e18_negation", _NEG_SQL)
def _(spark, d):
    e = xt.dictionary_entities(sectioned(spark, d), terms(spark, V.CONDITIONS), "diagnosis_or_problem", 0.70, _DXB, 0.88)
    return e.select("document_id", "element_id", "entity_text", xt.is_negated(F.col("text"), F.col("entity_text")).alias("is_negated"))


# Lines of the text corpus and a dictionary out of the corpus itself: runs of one
# to seven words that begin a line of an eleventh document.
def corpus_lines(spark, d):
    e = inp.corpus(spark, d).elements_of("line")
    return e.select("document_id", "element_id", "page_number", F.lit(None).cast("string").alias("section_name"), "text")


def corpus_terms(spark, d):
    w = F.regexp_extract_all(tx.lower_clean("text"), F.lit(xt.TERM_WORD), F.lit(0))
    t = corpus_lines(spark, d).filter("document_id % 11 = 0").select(w.alias("w"), (F.length("text") % 7 + 1).cast("int").alias("n"))
    return t.filter(F.size("w") >= F.col("n")).select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("term")).distinct()


_CORPUS_TERMS = f"""cl as (select doc_id document_id, (line_number * 4 + 2)::bigint element_id, text, regexp_extract_all({_CLEAN}, '[0-9a-z]+') w from (
  select doc_id, unnest(ls) as text, unnest(range(0, len(ls))) line_number from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') ls from documents))),
ct as (select distinct array_to_string(w[1:z], ' ') term, z from (select w, length(text) % 7 + 1 z from cl where document_id % 11 = 0) where len(w) >= z),
cg as (select document_id, element_id, p - 1 "at", z n, array_to_string(w[p:p + z - 1], ' ') term from (select *, unnest(range(1, len(w) - z + 2)) p from cl, (select distinct z from ct) where len(w) >= z)),
cp as (select cg.document_id, cg.element_id, "at", cg.n, cg.term from cg join ct on ct.term = cg.term and ct.z = cg.n)"""


@query("e9_term_places", S.select([_CORPUS_TERMS], 'select document_id, element_id, "at"::int "at", n::int n, term from cp'))
def _(spark, d):
    return xt.term_places(corpus_lines(spark, d), corpus_terms(spark, d)).select("document_id", "element_id", "at", "n", "term")


@query("e10_longest_terms", S.select([_CORPUS_TERMS], "select document_id, element_id, term from cp qualify row_number() over (partition by document_id, element_id order by length(term) desc, term) = 1"))
def _(spark, d):
    return xt.dictionary_entities(corpus_lines(spark, d), corpus_terms(spark, d), "term", 0.5, text=False).select("document_id", "element_id", F.col("entity_text").alias("term"))


_LAB = "|".join(sorted(V.LAB_NAMES, key=lambda x: (-len(x), x)))
_LABV = rf"\b({_LAB})\b\s*[:\-=]?\s*(high|low|h|l)?\s*(\d+(?:\.\d+)?)\s*([a-zA-Z/%µμ]+(?:/[a-zA-Z0-9]+)*)?"
_LABR = rf"\b({_LAB})\b.*?(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)"
_GRP = lambda p, i: f"regexp_extract(m, $re${p}$re$, {i})"


@query("e8_lab_details", S.select([NL], f"""select document_id, element_id, 'lab_result' as entity_type, m as entity_text, {_GRP(_LABV, 1)} as lab_name, nullif({_GRP(_LABV, 2)}, '') as flag, {_GRP(_LABV, 3)} as "value",
  nullif({_GRP(_LABV, 4)}, '') as unit, {_GRP(_LABV, 2)} <> '' as is_abnormal, null::varchar as low, null::varchar as high from (select *, unnest(regexp_extract_all({_CLEAN}, $re${_LABV}$re$)) as m from nl)
 union all select document_id, element_id, 'lab_reference_range', m, {_GRP(_LABR, 1)}, null, null, null, null, {_GRP(_LABR, 2)}, {_GRP(_LABR, 3)} from (select *, unnest(regexp_extract_all({_CLEAN}, $re${_LABR}$re$)) as m from nl)"""))
def _(spark, d):
    return xt.lab_details(note_lines(spark, d))


_NAMED = r"\b([A-Z][A-Za-z0-9\-]{2,}(?:\s+[A-Z][A-Za-z0-9\-]{2,}){0,2})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)\b"
_ENDS = " union all ".join(f"select document_id, element_id, 'medication_class' as entity_type, unnest(regexp_extract_all(low, $re$[a-z]{{4,}}{e}\\b$re$)) as entity_text, null::varchar as dose, null::varchar as unit, '{c}' as drug_class, 'drug_suffix' as source from nc"
                           for e, c in V.DRUG_SUFFIXES.items())


@query("e9_med_details", S.select([NL, _SEC, "md as (" + _dict_sql(V.MEDICATIONS, "medication", 0.78, 0.92, _MEDB) + ")", f"nc as (select *, {_CLEAN} as low from nsec)"],
    f"""select document_id, element_id, 'medication' as entity_type, entity_text, nullif(regexp_extract(low, '\\b' || entity_text || $re${xt.DOSE}$re$, 1), '') as dose, nullif(regexp_extract(low, '\\b' || entity_text || $re${xt.DOSE}$re$, 2), '') as unit,
  null::varchar as drug_class, 'drug_dict' as source from md join nc using (document_id, element_id) union all {_ENDS}
 union all select document_id, element_id, 'medication_candidate', m, regexp_extract(m, $re${_NAMED}$re$, 2), regexp_extract(m, $re${_NAMED}$re$, 3), null, 'medication_dose_regex' from (select *, unnest(regexp_extract_all(text, $re${_NAMED}$re$)) as m from nc)
 union all select document_id, element_id, 'medication_line_candidate', substr(text, 1, 220), null, null, null, 'medication_line_rule' from nc
  where (coalesce(section_name in ('medications', 'plan'), false) or {' or '.join(f"contains(low, '{w}')" for w in xt.ROUTE)}) and regexp_matches(low, $re${xt.TAKE}$re$)"""))
def _(spark, d):
    return xt.medication_details(sectioned(spark, d), terms(spark, V.MEDICATIONS))


@query("e4_e19_entities")
def _(spark, d):
    return entities(spark, d).select("document_id", "element_id", "page_number", "section_name", "entity_type", "entity_text", "normalized_value",
                                     quantize(F.col("confidence")).alias("confidence"), "is_negated")


@query("e16_element_flags", S.select([NL], "select document_id, element_id, " + ", ".join(
    f"regexp_matches(lower(trim(regexp_replace(text,'[ \\t\\n\\r\\f]+',' ','g'))), $${p}$$) as {f}" for f, (_, p) in V.PRESENCE.items()) + " from nl"))
def _(spark, d):
    return xt.element_flags(note_lines(spark, d))


@query("e17_providers")
def _(spark, d):
    lines = inp.corpus(spark, d).elements_of("line")
    p = xt.providers(lines).withColumn("kind", F.lit("provider"))
    return p.unionByName(xt.facilities(note_lines(spark, d)).withColumnRenamed("name", "raw").withColumn("kind", F.lit("facility")))


# ------------------------------------------------------------------- enrichment
def note_chunks(spark, d):
    """Page chunks of the notes with their source elements."""
    n = note_lines(spark, d)
    return by_key(n, "document_id").groupBy("document_id", "page_number").agg(
        F.array_sort(F.collect_list("element_id")).alias("source_element_ids"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element_id", "text"))), lambda r: r["text"]), "\n").alias("text"),
    ).select("document_id", F.col("page_number").cast("bigint").alias("chunk_id"), F.col("page_number").alias("page_start"),
             F.col("page_number").alias("page_end"), "source_element_ids", "text")


_PAGE = """np as (select document_id, page_number::bigint as chunk_id, string_agg(text, chr(10) order by element_id) as text, lower(string_agg(text, ' ' order by element_id)) as low from nl group by 1,2)"""


def gathered(spark, d):
    """Chunks and entities are read several times here, so they are stored once
    first, and so is what the chunks gather."""
    return stored(en.gather_entities(stored(note_chunks(spark, d)), stored(entities(spark, d).drop("text"))))


_VIT = "vt as (select document_id, element_id//5 as chunk_id, entity_type, normalized_value from (" + _rule_sql({"vital"}) + ") group by all)"


@query("n3_gather", S.select([NL, _SEC, _VIT], "select document_id, chunk_id::bigint as chunk_id, count(*) as vitals from vt group by 1,2"))
def _(spark, d):
    g = gathered(spark, d).filter("entity_type = 'vital'")
    return g.groupBy("document_id", "chunk_id").agg(F.count("*").alias("vitals"))


def enriched(spark, d):
    s = xt.extract_sections(sectioned(spark, d))
    return en.enrich(note_chunks(spark, d), gathered(spark, d), en.section_of_page(s))


@query("n2_section_pages", S.select([NL, _SEC], """select document_id, page_number, arg_min(section_name, o) as section_name from
 (select document_id, section_name, unnest(range(min(page_number), max(page_number)+1))::int as page_number, min(element_id) as o from nsec where section_name is not null group by document_id, section_name) group by 1,2"""))
def _(spark, d):
    return en.section_of_page(xt.extract_sections(sectioned(spark, d)))


@query("n4_flags", S.select([NL, _PAGE], "select document_id, chunk_id, " + ", ".join(
    f"regexp_matches(low, $${V.PRESENCE[f][1]}$$) as {f}" for f in ("contains_date", "contains_negation", "contains_patient_id")) + " from np"))
def _(spark, d):
    return enriched(spark, d).select("document_id", "chunk_id", "contains_date", "contains_negation", "contains_patient_id")


@query("n5_n6_scores")
def _(spark, d):
    return enriched(spark, d).select("document_id", "chunk_id", "primary_section", "is_boilerplate", "entity_count", "concept_density",
                                     "clinical_importance_score", "clinical_quality_score")


_FOCUS = [w for f in V.FOCUS.values() for w in f[3]]


def _focus_sql(name):
    sections, types, of_types, vocab, of_words, inside = V.FOCUS[name]
    met = f"len(list_filter({vocab!r}, lambda x: contains(low, x)))" if inside else f"len(list_intersect({vocab!r}, string_split_regex(low, '[ \\t\\n\\r\\f]+')))"
    return f"""(coalesce(section in ({", ".join(repr(s) for s in sections)}), false) or (select count(*) from ents e where e.doc_idx = t.doc_id and entity_type in ({", ".join(repr(s) for s in types)})) >= {of_types} or {met} >= {of_words}) as {name}"""


# Whole documents, each with four words of the lists behind its text.
@query("n8_focus", S.select([S.UNITS, f"""tx as (select doc_id, lower(coalesce(text, '') || ' ' || array_to_string(list_transform(range(0, 4), lambda i: ({_FOCUS!r})[((doc_id * 5 + i * 3) % {len(_FOCUS)})::int + 1]), ' ')) as low from documents)""",
    "u as (select *, regexp_replace(low, '[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]', 'q', 'g') as plain from tx)",  # \\b there knows ASCII letters only
    "t as (select *, case " + " ".join(f"when regexp_matches(plain, $${p}$$) then '{k}'" for p, k in V.INFER_SECTION) + " end as section from u)"],
    "select doc_id, section, " + ", ".join(map(_focus_sql, V.FOCUS)) + " from t"))
def _(spark, d):
    words = F.array(*[F.lit(w) for w in _FOCUS])
    tail = [F.element_at(words, ((F.col("doc_id") * 5 + i * 3) % len(_FOCUS) + 1).cast("int")) for i in range(4)]
    kinds = F.transform("e", lambda x: x["entity_type"])
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    t = inp.documents(spark, d).select("doc_id", F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), *tail)).alias("low"), inp.derived_entities().alias("e"))
    t = t.withColumn("section", F.coalesce(*[F.when(F.col("low").rlike(p), F.lit(k)) for p, k in V.INFER_SECTION]))
    return t.select("doc_id", "section", *[c.alias(n) for n, c in en.focus_flags(F.col("low"), counts, F.col("section")).items()])


@query("n11_top_entities")
def _(spark, d):
    g = en.entity_aggregates(gathered(spark, d), 30)
    return g.select("document_id", "chunk_id", F.explode("top_entities").alias("e")).select("document_id", "chunk_id", "e.entity_type", "e.normalized_value", F.col("e._r").alias("rank"))


_ = tx
