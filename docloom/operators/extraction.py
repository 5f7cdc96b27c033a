"""Document type, section and entity extraction over line elements.

Rules run as one projection: each rule yields an array of matches and the
arrays are exploded together, so the lines are read once and nothing shuffles
until entities are de-duplicated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import quantize
from docloom.functions.udfs import has_bit, may_match, relaxed
from docloom.operators import vocab as V
from docloom.sources.io import by_key

ALT = "|".join


@dataclass(frozen=True)
class Rule:
    """One extraction rule: every match of ``pattern`` is an entity."""

    entity_type: str
    source: str
    pattern: str
    confidence: float
    group: int = 0            # group giving the normalised value
    boost: tuple[str, ...] = ()  # sections adding 0.15
    cap: float = 1.0
    lower: bool = False       # match on the cleaned lower-case line
    norm_lower: bool = False
    ends: bool = False        # the pattern takes the mark that ends a phrase; it is no part of the entity
    min_len: int = 0          # shortest normalised value
    unless: str = ""          # a cleaned line that matches gives nothing
    only: tuple[str, ...] = ()  # sections the rule is bound to
    fixed: str = ""           # one entity a line, with this value and the line's start as its text
    needs: tuple[str, ...] = ()  # strings, without spaces, of which the cleaned line holds one wherever the pattern matches
    digit: bool = False       # the pattern takes a digit
    seek: str = ""            # the same pattern, its alternatives as a tree


ENDS = ",;. "  # marks that end a phrase
NKDA = r"\b(?:nkda|nka|no known drug allergies?|no known allergies?)\b"


# What a line holds wherever a pattern matches: searching a line for a short
# string costs a small part of what searching it for a pattern does.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
VITAL_NEEDS = {
    "blood_pressure": ("bp", "pressure"), "heart_rate": ("hr", "rate", "p"), "temperature": ("t",), "respiratory_rate": ("rr", "resp"),
    "oxygen_saturation": ("spo2", "sat"), "weight": ("wt", "weight"), "height": ("ht",), "bmi": ("bmi", "mass"), "pain_score": ("pain", "vas", "nrs"),
    "gcs": ("gcs", "coma"), "blood_glucose": ("glucose", "fbs", "rbs", "ppbs", "sugar", "cbg", "fingerstick"), "inr": ("inr", "pt")}
IMAGING_NEEDS = ("ray", "radiograph", "cxr", "ct", "scan", "tomography", "mri", "magnetic", "ultrasound", "usg", "sonography", "echo", "pet", "spect",
                 "nuclear", "fluoroscopy", "mammo", "dexa", "densitometry", "angiogra", "venogram", "eeg", "emg", "nerve")
PROCEDURE_NEEDS = ("surgery", "operation", "procedure", "biopsy", "excision", "resection", "ablation", "scopy", "angiography", "plasty", "stent",
                   "catheterization", "tubation", "tracheostomy", "ectomy", "debridement", "amputation", "dialysis", "plasmapheresis", "fusion", "incision",
                   "drainage", "i&d", "suturing", "repair", "cpr", "cardioversion", "defibrillat", "injection", "aspiration", "centesis", "puncture", "lp",
                   "tap", "pacemaker", "icd")


def lab_names_pattern(lab_names: list[str] | None = None) -> str:
    """Alternatives of the names, longest first; names hold letters, digits, spaces and hyphens."""
    return ALT(sorted(lab_names or V.LAB_NAMES, key=lambda x: (-len(x), x)))


def tree(words: Sequence[str]) -> str:
    """An alternation of the words that prefers longer ones, as a tree of their letters:
    a place tries one word's letters, not all words."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    out = ALT(re.escape(c) + tree(rest) for c, rest in heads.items())
    return f"(?:{out})?" if "" in words else out if len(heads) == 1 else f"(?:{out})"


def rules(lab_names: list[str] | None = None) -> list[Rule]:
    labs = lab_names_pattern(lab_names)
    med, dx = ("medications", "plan", "discharge_instructions"), ("assessment", "chief_complaint", "hpi", "impression", "postoperative_diagnosis", "findings")
    out = [Rule("date", "date_regex", p, 0.80, needs=n, digit=True) for p, n in (
        (V.NUM_DATE, ("/", "-")), (rf"(?i)\b{V.MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", MONTHS), (rf"(?i)\b\d{{1,2}}\s+{V.MONTH},?\s+\d{{4}}\b", MONTHS))]
    out += [Rule("patient_identifier", "patient_id_regex", p, 0.88, 1, needs=n) for p, n in (
        (r"(?i)\b(?:MRN|UHID|Patient\s*ID|Patient\s*No\.?|Reg(?:istration)?\s*No\.?|Account\s*(?:No\.?|Number)?)\s*[:#\-]?\s*([A-Za-z0-9\-\/]{4,20})\b", ("mrn", "uhid", "patient", "reg", "account")),
        (r"(?i)\b(?:Case\s*ID|Case\s*No\.?|Record\s*No\.?|Chart\s*No\.?)\s*[:#\-]?\s*([A-Za-z0-9\-\/]{4,20})\b", ("case", "record", "chart")),
        (r"(?i)\b(?:DOB|Date of Birth)\s*[:\-]?\s*(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})\b", ("dob", "birth")),
        (r"(?i)\b(?:Acc(?:ession)?\s*No\.?|Acc\s*#)\s*[:#\-]?\s*([A-Za-z0-9\-\/]{4,20})\b", ("acc",)))]
    out += [Rule("vital", f"vital_{k}", "(?i)" + p, 0.85, needs=VITAL_NEEDS.get(k, ()), digit=True) for k, p in V.VITALS.items()]
    # a name of two endings counts for both
    out += [Rule("medication_class", "drug_suffix", rf"[a-z]{{4,}}{end}\b", 0.65, boost=med, cap=0.80, lower=True, needs=(end,)) for end in V.DRUG_SUFFIXES]
    value = r")\b\s*[:\-=]?\s*(high|low|h|l)?\s*(\d+(?:\.\d+)?)\s*([a-zA-Z/%]+(?:/[a-zA-Z0-9]+)*)?"
    out += [
        Rule("lab_result", "lab_regex", rf"\b({labs}{value}", 0.82, lower=True, digit=True, seek=rf"\b({tree(lab_names or V.LAB_NAMES)}{value}"),
        Rule("lab_reference_range", "lab_refrange_regex", rf"\b({labs})\b.*?(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)", 0.72, lower=True, needs=("-", "–", "—"), digit=True),
        Rule("medication_candidate", "medication_dose_regex", r"\b([A-Z][A-Za-z0-9\-]{2,}(?:\s+[A-Z][A-Za-z0-9\-]{2,}){0,2})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)\b", 0.60, boost=med, cap=0.78,
             needs=("g", "ml", "iu", "unit"), digit=True),
        Rule("diagnosis_code", "icd10_regex", r"\b[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?\b", 0.75, digit=True),
        Rule("past_diagnosis", "history_of_pattern", r"\b(?:history of|hx of|h/o|known case of|known h/o|dx of|diagnosis of|diagnosed with)\s+([a-z][a-z \-]{3,50}?)(?:[,;.]|$)", 0.68, 1, dx, 0.82, True,
             ends=True, min_len=7, needs=("history", "hx", "h/o", "known", "dx", "diagnos")),
        Rule("procedure_code", "cpt_like_regex", r"\b[1-9][0-9]{4}\b", 0.65, digit=True),
        Rule("imaging", "imaging_keyword", "(?i)" + V.IMAGING, 0.78, norm_lower=True, needs=IMAGING_NEEDS),
        Rule("procedure", "procedure_keyword", "(?i)" + V.PROCEDURE, 0.72, norm_lower=True, needs=PROCEDURE_NEEDS),
        Rule("allergy_nkda", "nkda_pattern", NKDA, 0.92, lower=True, fixed="NKDA", needs=("nka", "nkda", "known"))]
    out += [Rule("allergy", "allergy_pattern_v2", p, 0.72, 1, ("allergies",), 0.88, True, ends=True, min_len=3, unless=NKDA, needs=(n,)) for p, n in (
        (r"\ball(?:ergic|ergy)\s+to\s+([a-z][a-z0-9 \-]{2,40}?)(?:[,;.]|$)", "allerg"),
        (r"\b([a-z][a-z0-9 \-]{2,30}?)\s+allergy\b", "allergy"),
        (r"\b([a-z][a-z0-9 \-]{2,30}?)\s+intolerance\b", "intolerance"),
        (r"\breaction to\s+([a-z][a-z0-9 \-]{2,30}?)(?:[,;.]|$)", "reaction"))]
    out += [
        Rule("allergy", "allergy_section_capitalized", r"^\s*[A-Z][A-Za-z0-9 \-]{2,40}\s*$", 0.68, norm_lower=True, ends=True, min_len=3,
             unless=NKDA, only=("allergies",)),
        Rule("demographics_age", "age_pattern", r"(?i)\b(\d{1,3})[- ]?(?:years?[- ]?old|yo|y/?o|y\.o\.)", 0.85, 1, needs=("y",), digit=True),
        Rule("demographics_age", "age_labeled", r"(?i)\bage\s*[:\-]?\s*(\d{1,3})\b", 0.85, 1, needs=("age",), digit=True),
        Rule("demographics_gender", "gender_pattern", r"(?i)\b(male|female|man|woman|boy|girl)\b", 0.80, norm_lower=True, needs=("male", "man", "boy", "girl")),
        Rule("demographics_dob", "dob_pattern", r"(?i)\b(?:dob|date of birth|birthday|d\.o\.b\.?)\s*[:\-]?\s*(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2})", 0.90, 1, needs=("dob", "birth", "d.o.b"), digit=True),
        Rule("demographics_name", "name_label_pattern", r"\b(?:[Pp]atient|[Pp]atient [Nn]ame|[Nn]ame|[Pp]t\.?)\s*[:\-]\s*([A-Z][A-Za-z]+(?:[\s,]+[A-Z][A-Za-z]+){1,4})\b", 0.75, 1, needs=(":", "-")),
        Rule("social_smoking", "smoking_pattern", r"\b(?:former smoker|current smoker|never smoker|non[- ]?smoker|smokes?|smoking|tobacco)\b", 0.75, lower=True, needs=("smok", "tobacco")),
        Rule("social_alcohol", "alcohol_pattern", r"\b(?:alcohol|etoh|drinks?|drinking)\b", 0.72, lower=True, needs=("alcohol", "etoh", "drink")),
        Rule("social_substance", "substance_pattern", r"\b(?:cocaine|heroin|marijuana|cannabis|methamphetamine|illicit drugs?)\b", 0.75, lower=True, needs=("cocaine", "heroin", "marijuana", "cannabis", "methamphetamine", "illicit")),
        Rule("social_occupation", "occupation_pattern", r"\b(?:occupation|works as|employed as|retired)\s*[:\-]?\s*([a-z][a-z \-]{2,40})", 0.65, 1, lower=True, needs=("occupation", "works", "employed", "retired")),
    ]
    return out


def _confidence(r: Rule) -> Column:
    base = F.lit(r.confidence)
    if not r.boost:
        return base
    hit = F.coalesce(F.col("section_name").isin(list(r.boost)), F.lit(False))
    return F.least(F.lit(r.cap), base + F.when(hit, 0.15).otherwise(0.0))


FOUND = "array<struct<entity_type:string,entity_text:string,normalized_value:string,confidence:double,source:string,rule_no:int>>"


def _first_test(r: Rule) -> tuple[int, str]:
    """What a line (0) or the cleaned line (1) holds wherever the rule finds something."""
    p = relaxed(r.pattern)
    return (int(r.lower), p) if p is not None else (1, ALT(map(re.escape, r.needs)) or "[0-9]" * r.digit)


def _matches(r: Rule, no: int) -> Column:
    """Matches of rule ``no`` in a line whose ``may`` has its bit; other lines are not searched."""
    body = F.col("clean") if r.lower else F.col("text")
    conf = _confidence(r)

    def row(m: Column) -> Column:
        if r.fixed:
            m = F.substring("text", 1, 80)
        m = F.btrim(m, F.lit(ENDS)) if r.ends else m
        norm = F.lit(r.fixed) if r.fixed else F.regexp_extract(m, r.pattern, r.group) if r.group else m
        norm = F.trim(F.lower(norm) if r.norm_lower else norm)
        return F.struct(F.lit(r.entity_type).alias("entity_type"), m.alias("entity_text"), norm.alias("normalized_value"),
                        conf.alias("confidence"), F.lit(r.source).alias("source"), F.lit(no).alias("rule_no"))

    found = F.regexp_extract_all(body, F.lit(r.seek or r.pattern), F.lit(0))
    may = has_bit(F.col("may"), no)
    if r.only:
        may = may & F.coalesce(F.col("section_name").isin(list(r.only)), F.lit(False))
    found = F.transform(F.slice(found, 1, 1) if r.fixed else found, row)
    if r.min_len:
        found = F.filter(found, lambda e: F.length(e["normalized_value"]) >= r.min_len)
    if r.unless:
        found = F.filter(found, lambda e: ~F.col("clean").rlike(r.unless))
    return F.when(may, found).otherwise(F.array().cast(FOUND))


def any_of(column: str, strings: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(F.col(column), F.lit(x)) for x in strings])


def pattern_entities(lines: DataFrame, which: list[Rule] | None = None) -> DataFrame:
    """All regex entities of the lines: one scan, one explode.  ``lines`` has
    document_id, element_id, page_number, section_name, text.

    Java's patterns try each alternative at each place of a line; a linear test for all
    rules comes first, and a rule searches only the lines that passed its own."""
    which = which or rules()
    base = lines.withColumn("clean", tx.lower_clean("text"))
    base = base.withColumn("may", may_match([_first_test(r) for r in which])("text", "clean"))
    # an array of its own column is compiled, concat takes longer over many arrays, and
    # the filter that inline gets (not its outer form) would find everything once more
    base = base.withColumn("_found", F.flatten(F.array(*[_matches(r, i) for i, r in enumerate(which)])))
    ex = base.select("document_id", "element_id", "page_number", "section_name", "text", F.inline_outer("_found")).filter("entity_type is not null")
    ages = (F.col("entity_type") != "demographics_age") | F.col("normalized_value").try_cast("int").between(0, 130)
    return ex.filter(ages)


LINE = ["document_id", "element_id", "page_number", "section_name", "text"]
TERM_WORD = "[0-9a-z]+"


def _term_words(text: str) -> Column:
    return F.regexp_extract_all(tx.lower_clean(text), F.lit(TERM_WORD), F.lit(0))


MARK_BITS = 22  # bits of the marks, as a power of two: half a megabyte whatever the dictionary holds


def _marks(grams: DataFrame) -> Column:
    """Bits at the hashes of the strings of ``grams`` (column ``g``), as one array of fixed size."""
    h = F.xxhash64("g")
    words = grams.select(_slot(h).alias("i"), _bit(h).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    every = grams.sparkSession.range(1 << (MARK_BITS - 6)).select(F.col("id").alias("i")).join(words, "i", "left")
    rows = F.array_sort(F.collect_list(F.struct("i", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return every.agg(F.transform(rows, lambda r: r["b"]).alias("m")).scalar()


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _slot(h: Column) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit((1 << (MARK_BITS - 6)) - 1))


def _marked(marks: Column, gram: Column) -> Column:
    """Whether ``gram`` may be among the marked strings (never false for one that is)."""
    h = F.xxhash64(gram)
    return F.get(marks, _slot(h).cast("int")).bitwiseAND(_bit(h)) != 0


def term_places(lines: DataFrame, terms: DataFrame, overlaps: bool = True) -> DataFrame:
    """Every place of a dictionary term in the lines: ``LINE`` columns, ``at`` (word
    number), ``n`` (words), ``term`` and the other columns of ``terms``.

    Terms may have any number of words: the runs of words that a line begins at a
    place, of the lengths the terms have, meet the terms by equality.  Before the
    join, runs go whose first word or whole no term has by its hash, so about as
    many rows travel as there are places, however many terms begin alike.  Without
    ``overlaps`` the leftmost of the places of a line are kept, the longest of
    those that begin together (ties alphabetical)."""
    return _places(lines, terms, LINE, overlaps)


def _places(lines: DataFrame, terms: DataFrame, line: list[str], overlaps: bool = True) -> DataFrame:
    """``term_places`` with the columns ``line`` of the lines."""
    more = [c for c in terms.columns if c != "term"]
    t = terms.dropDuplicates(["term"]).withColumn("_w", _term_words("term")).filter(F.size("_w") > 0)
    t = t.select("term", *more, F.size("_w").alias("n"), F.col("_w")[0].alias("_first"), F.array_join("_w", " ").alias("_g"))
    sizes = F.coalesce(t.agg(F.array_sort(F.collect_set("n")).alias("s")).scalar(), F.array().cast("array<int>"))
    marks = _marks(t.select(F.explode(F.array("_first", "_g")).alias("g")))
    base = lines.select(*line, _term_words("text").alias("_t"))
    at = base.select(*line, "_t", F.posexplode("_t").alias("at", "_first")).filter(_marked(marks, F.col("_first"))).drop("_first")
    run = at.withColumn("n", F.explode(sizes)).filter(F.col("at") + F.col("n") <= F.size("_t"))
    run = run.select(*line, "at", "n", F.array_join(F.slice("_t", F.col("at") + 1, F.col("n")), " ").alias("_g")).filter(_marked(marks, F.col("_g")))
    hit = run.join(t.select("_g", "term", *more), "_g").select(*line, "at", "n", "term", *more)
    if overlaps:
        return hit
    rows = F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("_n"), "term", *more)))
    g = hit.groupBy(*line).agg(rows.alias("_r"))
    none = F.filter("_r", lambda r: F.lit(False))
    last = lambda acc: F.coalesce(F.element_at(acc, -1)["at"] - F.element_at(acc, -1)["_n"], F.lit(0))
    kept = F.aggregate("_r", none, lambda acc, r: F.when((F.size(acc) == 0) | (r["at"] >= last(acc)), F.array_append(acc, r)).otherwise(acc))
    return g.select(*line, F.inline(kept)).select(*line, "at", (-F.col("_n")).alias("n"), "term", *more)


def dictionary_entities(lines: DataFrame, terms: DataFrame, entity_type: str, confidence: float,
                        boost: tuple[str, ...] = (), cap: float = 1.0, source: str = "dictionary", text: bool = True) -> DataFrame:
    """The longest dictionary term of each line (ties alphabetical).  Without
    ``text`` that column is left out: only a hash of it, which tells lines of one
    number apart, travels."""
    line = LINE if text else [*LINE[:-1], "_line"]
    places = _places(lines if text else lines.withColumn("_line", F.xxhash64("text")), terms.select("term"), line)
    best = places.groupBy(*line).agg(F.min(F.struct((-F.length("term")).alias("n"), "term"))["term"].alias("entity_text"))
    r = Rule(entity_type, source, "", confidence, 0, boost, cap)
    return best.select(*[c for c in line if c != "_line"], F.lit(entity_type).alias("entity_type"), "entity_text", F.col("entity_text").alias("normalized_value"),
                       _confidence(r).alias("confidence"), F.lit(source).alias("source"), F.lit(1000).alias("rule_no"))


def several_dictionaries(lines: DataFrame, *dictionaries: tuple[DataFrame, Rule]) -> DataFrame:
    """``dictionary_entities`` of all (terms, rule) in one pass over the lines."""
    every = reduce(DataFrame.unionByName, [t.select("term", F.lit(i).alias("_d")) for i, (t, _) in enumerate(dictionaries)])
    every = every.groupBy("term").agg(F.collect_set("_d").alias("_of"))
    places = _places(lines, every, LINE).select(*LINE, "term", F.explode("_of").alias("_d"))
    best = places.groupBy(*LINE, "_d").agg(F.min(F.struct((-F.length("term")).alias("n"), "term"))["term"].alias("entity_text"))
    of = lambda value: F.element_at(F.array(*[value(r) for _, r in dictionaries]), F.col("_d") + 1)
    return best.select(*LINE, of(lambda r: F.lit(r.entity_type)).alias("entity_type"), "entity_text", F.col("entity_text").alias("normalized_value"),
                       of(_confidence).alias("confidence"), of(lambda r: F.lit(r.source)).alias("source"), F.lit(1000).alias("rule_no"))


# Dose after a name, words that mark a medication line.
DOSE = r"\b\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)\b"
ROUTE = ("tablet", "tab", "capsule", "cap", "injection", "inj", "syrup", "mg", "mcg", "daily", "bid", "tid", "qid", "prn", "po", "iv", "im", "once daily", "twice daily", "sc",
         "subcutaneous", "inhale", "apply", "patch", "drops", "sublingual", "transdermal", "topical")
TAKE = r"\b(take|tab|tablet|cap|capsule|inj|injection|apply|instil|inhale)\b"


def _groups(body: Column, pattern: str, *names: str) -> Column:
    """All matches with their groups, as structs.  The text is searched once, where
    it has a digit at all; groups are read from the short matches."""
    found = F.when(body.rlike("[0-9]"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    return F.transform(found, lambda m: F.struct(m.alias(names[0]), *[F.regexp_extract(m, pattern, i).alias(n) for i, n in enumerate(names[1:], 1)]))


def lab_details(lines: DataFrame, lab_names: list[str] | None = None) -> DataFrame:
    """Laboratory values with ``lab_name, flag, value, unit, is_abnormal``, null where
    a part is not written, and reference ranges with ``low, high``."""
    labs, clean = lab_names_pattern(lab_names), tx.lower_clean("text")
    value = rf"\b({labs})\b\s*[:\-=]?\s*(high|low|h|l)?\s*(\d+(?:\.\d+)?)\s*([a-zA-Z/%µμ]+(?:/[a-zA-Z0-9]+)*)?"
    span = rf"\b({labs})\b.*?(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)"
    base = lines.select("document_id", "element_id", clean.alias("clean"))
    put = lambda c: F.when(F.col(c) != "", F.col(c))
    v = base.select("document_id", "element_id", F.inline(_groups(F.col("clean"), value, "entity_text", "lab_name", "flag", "value", "unit")))
    r = base.select("document_id", "element_id", F.inline(_groups(F.col("clean"), span, "entity_text", "lab_name", "low", "high")))
    none = F.lit(None).cast("string")
    return v.select("document_id", "element_id", F.lit("lab_result").alias("entity_type"), "entity_text", "lab_name", put("flag").alias("flag"), "value", put("unit").alias("unit"),
                    (F.col("flag") != "").alias("is_abnormal"), none.alias("low"), none.alias("high")).unionByName(
        r.select("document_id", "element_id", F.lit("lab_reference_range").alias("entity_type"), "entity_text", "lab_name", none.alias("flag"), none.alias("value"), none.alias("unit"),
                 F.lit(None).cast("boolean").alias("is_abnormal"), "low", "high"))


def medication_details(lines: DataFrame, medications: DataFrame) -> DataFrame:
    """All medication rows with their parts: dictionary drugs (``dose, unit`` where
    they follow the name), class endings (``drug_class``), unlisted names with a
    dose, and lines that read like a prescription."""
    known = dictionary_entities(lines, medications, "medication", 0.78, ("medications", "plan", "discharge_instructions"), 0.92, "drug_dict")
    after = F.concat(F.lit("\\b\\Q"), "entity_text", F.lit("\\E" + DOSE))
    none = F.lit(None).cast("string")
    grp = lambda i: F.nullif(F.call_function("regexp_extract", tx.lower_clean("text"), after, F.lit(i)), F.lit(""))
    cols = ["document_id", "element_id", "entity_type", "entity_text", "dose", "unit", "drug_class", "source"]
    known = known.withColumn("dose", grp(1)).withColumn("unit", grp(2)).withColumn("drug_class", none).select(*cols)
    clean = lines.withColumn("clean", tx.lower_clean("text"))

    def row(kind: str, text: Column, dose: Column, unit: Column, drug_class: Column, source: str) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), text.alias("entity_text"), dose.alias("dose"), unit.alias("unit"), drug_class.alias("drug_class"), F.lit(source).alias("source"))

    empty = F.array().cast("array<string>")

    def of_class(end: str, name: str) -> Column:
        found = F.when(F.contains(F.col("clean"), F.lit(end)), F.regexp_extract_all("clean", F.lit(rf"[a-z]{{4,}}{end}\b"), F.lit(0))).otherwise(empty)
        return F.transform(found, lambda m: row("medication_class", m, none, none, F.lit(name), "drug_suffix"))

    ends = [of_class(e, c) for e, c in V.DRUG_SUFFIXES.items()]
    name = r"\b([A-Z][A-Za-z0-9\-]{2,}(?:\s+[A-Z][A-Za-z0-9\-]{2,}){0,2})\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)\b"
    found = F.when(F.col("clean").rlike("[0-9]"), F.regexp_extract_all("text", F.lit(name), F.lit(0))).otherwise(empty)
    named = F.transform(found, lambda m: row("medication_candidate", m, F.regexp_extract(m, name, 2), F.regexp_extract(m, name, 3), none, "medication_dose_regex"))
    cue = F.coalesce(F.col("section_name").isin("medications", "plan"), F.lit(False)) | any_of("clean", ROUTE)
    start = F.when(cue & F.col("clean").rlike(TAKE), F.array(F.substring("text", 1, 220))).otherwise(empty)
    line = F.transform(start, lambda m: row("medication_line_candidate", m, none, none, none, "medication_line_rule"))
    found = clean.select("document_id", "element_id", F.inline(F.concat(*ends, named, line))).select(*cols)
    return known.unionByName(found)


LOOK_BACK = 120  # characters, where no sentence holds the entity


def is_negated(sentence_text: Column, entity: Column) -> Column:
    """Negation cue in the first sentence that holds the entity; where none does,
    in the entity and the ``LOOK_BACK`` characters before it; else anywhere.

    A text without a cue inside or outside words has none in any part of it, one of a
    single sentence is searched as it is."""
    words = [p.removeprefix(r"\b").removesuffix(r"\b") for p in V.NEGATION]  # each stands between word boundaries
    cues = rf"(?i)\b(?:{ALT(words)})\b"
    some = tx.lower_clean(sentence_text).rlike(tree([w for w in words if not any(v in w for v in words if v != w)]))
    whole = ~sentence_text.rlike("[.!?][ \\t\\n\\r\\f]")
    low, ent = tx.lower_clean(sentence_text), tx.lower_clean(entity)
    hold = F.get(F.filter(tx.sentences(sentence_text), lambda s: F.contains(tx.lower_clean(s), ent)), F.lit(0))
    at = F.call_function("locate", ent, low)
    before = F.greatest(F.lit(1), at - LOOK_BACK)
    near = F.when(at > 0, F.substring(low, before, at - before + F.length(ent)))
    part = F.coalesce(hold, near, sentence_text).rlike(cues)
    return F.when(sentence_text.isNotNull() & ~some, F.lit(False)).when(whole, sentence_text.rlike(cues)).otherwise(part)


def extract_entities(lines: DataFrame, medications: DataFrame, conditions: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """All extractors, de-duplicated, with sentence-scoped negation."""
    dx = ("assessment", "chief_complaint", "hpi", "impression", "postoperative_diagnosis", "findings")
    e = pattern_entities(lines)
    e = e.unionByName(several_dictionaries(lines, (medications, Rule("medication", "drug_dict", "", 0.78, 0, ("medications", "plan", "discharge_instructions"), 0.92)),
                                           (conditions, Rule("diagnosis_or_problem", "condition_dict", "", 0.70, 0, dx, 0.88))))
    e = e.withColumn("is_negated", is_negated(F.col("text"), F.col("entity_text")))
    return dedupe_entities(e.filter(F.col("confidence") >= min_confidence))


def dedupe_entities(e: DataFrame) -> DataFrame:
    """Best confidence per (type, value, page, section); first line wins ties."""
    key = ["document_id", "entity_type", "normalized_value", "page_number", "section_name"]
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "element_id", "rule_no", "entity_text")
    return e.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# ------------------------------------------------------------------ documents
def classify_documents(first_pages: DataFrame) -> DataFrame:
    """(document_id, text) -> best document type: weights of matching patterns,
    capped at 1; the first type wins ties.  In-row: no rule × document join.  A
    pattern searches only documents that passed its linear test."""
    scored, tests = [], []
    for i, (name, pats) in enumerate(V.DOCUMENT_TYPES.items()):
        s = F.lit(0.0)
        for p, w in pats:
            s = s + F.when(has_bit(F.col("_may"), len(tests)) & F.col("_b").rlike(p), w).otherwise(0.0)
            tests.append((0, relaxed(p) or ""))
        scored.append(F.struct(quantize(F.least(F.lit(1.0), s)).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("name")))
    d = first_pages.withColumn("_b", F.lower(F.col("text"))).withColumn("_may", may_match(tests)("_b"))
    d = d.select("document_id", F.array_max(F.array(*scored)).alias("best"))
    none = F.col("best.score") <= 0
    return d.select("document_id", F.when(none, "Unknown").otherwise(F.col("best.name")).alias("document_type"),
                    F.when(none, 0.0).otherwise(quantize(F.least(F.lit(0.97), 0.5 + F.col("best.score")))).alias("confidence"))


def detect_section(lines: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Section key and confidence per line: exact heading, heading-like line
    containing an alias, then fuzzy word overlap with the aliases that share a word."""
    table = aliases or V.SECTIONS
    flat = [(k, a) for k, al in table.items() for a in al]
    first: dict[str, str] = {}
    for k, a in flat:
        first.setdefault(a, k)
    exact = constant(first, "map<string,string>")
    ordered = constant([{"k": k, "a": a} for k, a in flat], "array<struct<k:string,a:string>>")
    with_word: dict[str, list[dict]] = {}  # the aliases that hold a word
    for i, (k, a) in enumerate(flat):
        for w in sorted(set(_alpha(a))):
            with_word.setdefault(w, []).append({"k": k, "w": sorted(set(_alpha(a))), "o": -i})
    words = constant(with_word, "map<string,array<struct<k:string,w:array<string>,o:int>>>")
    d = lines.withColumn("norm", tx.normalize_heading("text"))
    t = F.trim("text")
    caps = (F.upper(t) == t) & t.rlike("[A-Z]")
    d = d.withColumn("headlike", t.endswith(":") | caps)
    ok = (F.col("norm") != "") & (F.length("norm") <= 100)
    inside = F.get(F.filter(ordered, lambda x: F.contains(F.col("norm"), x["a"])), F.lit(0))["k"]
    known = F.filter("nw", lambda w: w.isin(list(with_word)))
    fuzzy = F.array_max(F.transform(F.flatten(F.transform(known, lambda w: F.element_at(words, w))), lambda x: F.struct(
        (F.size(F.array_intersect("nw", x["w"])) / F.size(F.array_union("nw", x["w"]))).alias("j"), x["o"].alias("o"), x["k"].alias("k"))))
    eq = F.when(F.col("norm").isin(list(first)), F.element_at(exact, F.col("norm")))
    d = d.withColumn("_eq", F.when(ok, eq)).withColumn("_in", F.when(ok & F.col("headlike") & (F.length("norm") <= 90), inside))
    open_ = ok & F.col("headlike") & F.col("_eq").isNull() & F.col("_in").isNull() & (F.size(F.split("norm", " ")) <= 8)
    d = d.withColumn("nw", F.when(open_, F.array_distinct(F.regexp_extract_all("norm", F.lit("[a-z]+"), F.lit(0)))))
    d = d.withColumn("_fz", fuzzy)  # null for a heading without a word of an alias
    close = F.col("_fz.j") >= 0.45
    key = F.coalesce(F.when(F.col("headlike"), F.col("_in")), F.col("_eq"), F.when(close, F.col("_fz.k")))
    conf = (F.when(F.col("headlike") & F.col("_in").isNotNull(), F.when(F.col("_eq") == F.col("_in"), 0.97).otherwise(0.88))
            .when(F.col("_eq").isNotNull(), 0.97).when(close, F.round(0.65 + F.col("_fz.j") * 0.15, 3)).otherwise(0.0))
    return d.withColumn("section_key", key).withColumn("section_confidence", conf).drop("norm", "headlike", "nw", "_eq", "_in", "_fz")


def constant(value: object, ddl: str) -> Column:
    """A lookup literal as one foldable expression (folded once by Catalyst)."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _alpha(s: str) -> list[str]:
    return re.findall("[a-z]+", s)


def assign_sections(lines: DataFrame, **kw) -> DataFrame:
    """Carry the last detected heading forward inside each document."""
    w = Window.partitionBy("document_id").orderBy("element_id").rowsBetween(Window.unboundedPreceding, 0)
    d = by_key(detect_section(lines, **kw), "document_id")
    return d.withColumn("section_name", F.last("section_key", ignorenulls=True).over(w)).withColumn(
        "section_id", F.count("section_key").over(w))


def extract_sections(sectioned: DataFrame) -> DataFrame:
    """Sections as islands of lines between headings."""
    g = sectioned.filter("section_id > 0").groupBy("document_id", "section_id").agg(
        F.first("section_name").alias("section_name"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"),
        F.min("element_id").alias("start_element"), F.max("element_id").alias("end_element"), F.count("*").alias("line_count"))
    return g


def element_flags(lines: DataFrame) -> DataFrame:
    """Per-line presence flags."""
    c = tx.lower_clean("text")
    return lines.select("document_id", "element_id", *[c.rlike(p).alias(f) for f, (_, p) in V.PRESENCE.items()])


def providers(lines: DataFrame, limit: int = 10) -> DataFrame:
    """Names with credentials, first ``limit`` distinct per document."""
    ex = lines.select("document_id", "element_id", F.posexplode(F.regexp_extract_all("text", F.lit(V.CREDENTIAL), F.lit(0))).alias("pos", "raw"))
    first = ex.groupBy("document_id", "raw").agg(F.min(F.struct("element_id", "pos")).alias("at"))
    w = Window.partitionBy("document_id").orderBy("at", "raw")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("document_id", "raw", "rank")


def facilities(lines: DataFrame, top_lines: int = 25, limit: int = 5) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("element_id")
    top = lines.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top_lines).filter(F.col("text").rlike(V.FACILITY))
    return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("document_id", tx.normalize_space("text").alias("name"), "rank")
