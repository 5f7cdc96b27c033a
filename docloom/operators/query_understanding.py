"""Query expansion, classification and entity hints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviation -> full term (case-sensitive), in order; callers add more.
QUERY_ABBREVIATIONS = {
    "HTN": "hypertension", "DM": "diabetes mellitus", "DM2": "type 2 diabetes mellitus", "DM1": "type 1 diabetes mellitus",
    "T2DM": "type 2 diabetes mellitus", "T1DM": "type 1 diabetes mellitus", "CAD": "coronary artery disease", "CHF": "congestive heart failure",
    "HF": "heart failure", "AF": "atrial fibrillation", "AFib": "atrial fibrillation", "AFIB": "atrial fibrillation",
    "COPD": "chronic obstructive pulmonary disease", "CKD": "chronic kidney disease", "ESRD": "end-stage renal disease",
    "CVA": "cerebrovascular accident stroke", "TIA": "transient ischemic attack", "MI": "myocardial infarction heart attack",
    "STEMI": "ST-elevation myocardial infarction", "NSTEMI": "non-ST-elevation myocardial infarction", "PE": "physical examination",
    "DVT": "deep vein thrombosis", "RA": "rheumatoid arthritis", "SLE": "systemic lupus erythematosus", "IBD": "inflammatory bowel disease",
    "UC": "ulcerative colitis", "GERD": "gastroesophageal reflux disease", "UTI": "urinary tract infection", "PNA": "pneumonia",
    "SOB": "shortness of breath dyspnea", "CP": "chest pain", "HA": "headache", "Fx": "fracture",
    "BG": "blood glucose", "BS": "blood sugar glucose", "HbA1c": "hemoglobin A1c glycated hemoglobin", "A1C": "hemoglobin A1c glycated hemoglobin",
    "Cr": "creatinine", "BUN": "blood urea nitrogen", "GFR": "glomerular filtration rate", "eGFR": "estimated glomerular filtration rate",
    "K": "potassium", "Na": "sodium", "Hgb": "hemoglobin", "Hct": "hematocrit", "WBC": "white blood cell count", "RBC": "red blood cell count",
    "Plt": "platelet count", "INR": "international normalized ratio coagulation", "PT": "physical therapy",
    "aPTT": "activated partial thromboplastin time", "TSH": "thyroid stimulating hormone", "LFTs": "liver function tests",
    "AST": "aspartate aminotransferase liver", "ALT": "alanine aminotransferase liver", "ALP": "alkaline phosphatase", "TBili": "total bilirubin",
    "LDL": "low-density lipoprotein cholesterol", "HDL": "high-density lipoprotein cholesterol", "TG": "triglycerides",
    "BP": "blood pressure", "HR": "heart rate pulse", "RR": "respiratory rate", "O2sat": "oxygen saturation", "SpO2": "oxygen saturation", "BMI": "body mass index",
    "ACEI": "ACE inhibitor angiotensin converting enzyme inhibitor", "ARB": "angiotensin receptor blocker", "BB": "beta blocker",
    "CCB": "calcium channel blocker", "ASA": "aspirin", "NSAID": "nonsteroidal anti-inflammatory drug", "PPI": "proton pump inhibitor",
    "SSRI": "selective serotonin reuptake inhibitor", "TCA": "tricyclic antidepressant", "Abx": "antibiotics", "abx": "antibiotics",
    "IV": "intravenous", "PO": "oral by mouth", "IM": "intramuscular", "SQ": "subcutaneous", "PRN": "as needed", "QD": "once daily",
    "BID": "twice daily", "TID": "three times daily", "QID": "four times daily",
    "HPI": "history of present illness", "PMH": "past medical history", "FH": "family history", "SH": "social history", "ROS": "review of systems",
    "Dx": "diagnosis", "Rx": "prescription treatment", "Tx": "treatment", "Sx": "symptoms", "CC": "chief complaint", "H&P": "history and physical",
    "DC": "discharge", "ED": "emergency department", "ICU": "intensive care unit", "OR": "operating room", "OT": "occupational therapy",
    "f/u": "follow-up", "F/U": "follow-up",
}
# Query types and their patterns, in order of precedence.
QUERY_TYPES = [
    ("medication", r"\b(medic\w+|drug|dose|dosage|prescri\w+|mg|mcg|tablet|capsule|pill|inject\w+|formulat\w+|pharmac\w+|treat\w+|therap\w+)\b"),
    ("lab", r"\b(lab\w*|result\w*|level\w*|value\w*|test\w*|panel\w*|culture\w*|biopsy|imaging|x-ray|ct\b|mri\b|ultrasound|ecg|ekg)\b"),
    ("diagnostic", r"\b(diagnos\w+|impression|assessment|condition|disease|disorder|finding|patholog\w+|abnormal\w*|etiol\w+)\b"),
    ("temporal", r"\b(when|date|time|yesterday|today|last|prior|previous|history|ago|admission|discharge|visit\w*)\b"),
    ("comparison", r"\b(compar\w+|chang\w+|differ\w+|better|worse|improv\w+|deterior\w+|progress\w+|trend\w*|vs\.?\b|versus)\b"),
    ("synthesis", r"\b(summar\w+|overview|overall|explain|descri\w+|tell me about|what is the|clinical picture|status)\b"),
]
# Medications and sections that a query may name.
QUERY_MEDICATIONS = ["metformin", "lisinopril", "aspirin", "atorvastatin", "amlodipine", "omeprazole", "metoprolol", "losartan", "enalapril",
                     "warfarin", "heparin", "insulin", "prednisone", "amoxicillin", "azithromycin", "hydrochlorothiazide", "furosemide", "simvastatin"]
QUERY_SECTIONS = ["assessment", "plan", "history", "examination", "medications", "labs", "vitals", "diagnosis", "impression", "hpi", "pmh", "ros"]


def expand_text(q: Column, table: dict[str, str] | None = None) -> Column:
    """Replace abbreviations one after the other (later ones see earlier
    replacements)."""
    items = (table or QUERY_ABBREVIATIONS).items()
    return reduce(lambda c, kv: F.regexp_replace(c, f"(?<![0-9A-Za-z_]){kv[0]}(?![0-9A-Za-z_])", kv[1]), items, q)


def expand(queries: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """The query, plus its expanded form when that differs."""
    e = expand_text(F.col("query"), table)
    vs = F.array_distinct(F.array(F.col("query"), e))
    return queries.select("query_id", F.posexplode(vs).alias("variant", "v")).withColumnRenamed("v", "query")


def classify(q: Column) -> Column:
    low = F.lower(q)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in QUERY_TYPES], F.lit("factual"))


def _named(q: Column, names: list[str]) -> Column:
    return F.transform(F.regexp_extract_all(q, F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(names)})(?![\p{{L}}\p{{N}}_])"), F.lit(1)), F.lower)


def query_entities(q: Column, table: dict[str, str] | None = None, medications: list[str] | None = None) -> Column:
    """Struct of ``medications`` (each mention, in order), ``diagnoses`` and
    ``labs`` (none are looked for), ``sections`` (once each, in order) and
    ``abbreviations_found`` (in the table's order).  A null query has none."""
    none = F.expr("cast(array() as array<string>)")
    q = F.coalesce(q, F.lit(""))
    short = [F.when(q.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{a}\E(?![\p{{L}}\p{{N}}_])"), F.lit(a)) for a in (table or QUERY_ABBREVIATIONS)]
    return F.struct(_named(q, medications or QUERY_MEDICATIONS).alias("medications"), none.alias("diagnoses"), none.alias("labs"),
                    F.array_distinct(_named(q, QUERY_SECTIONS)).alias("sections"), F.array_compact(F.array(*short)).alias("abbreviations_found"))


def process(queries: DataFrame) -> DataFrame:
    """Query understanding: the query's variants, type and entities."""
    q = F.col("query")
    return queries.select("query_id", "query", F.array_distinct(F.array(q, expand_text(q))).alias("expanded"), classify(q).alias("query_type"), query_entities(q).alias("entities"))
