import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


PASSAGES = [
    (0, "History of Present Illness", "Patient has high blood pressure 145/90 and chest pain. Known hypertension.", False),
    (1, "Assessment", "No evidence of myocardial infarction. Diagnosis of infarction ruled out.", True),
    (2, "Medications", "metformin 500 mg daily, lisinopril 10 mg, aspirin 81 mg.", False),
    (3, "Assessment and Plan", "Continue metformin. Follow up on 03/14/2024.", False),
    (4, "Laboratory Results", "Glucose 210 mg/dL, hemoglobin 13.5 and creatinine 1.1 mg/dL.", False),
    (5, "Review of Systems", "Denies fever and denies cough.", True),
    (6, "Radiology", "Chest x-ray shows no acute process. BP 120/80.", True),
    (7, "Discharge Summary", "Discharged home 2024-03-20 with stable hypertension and diabetes.", False),
]


@pytest.fixture(scope="session")
def units(spark):
    ent = ("doc_idx long, primary_section string, text string, contains_negation boolean, document_id long, chunk_strategy_name string, chunk_id long, "
           "document_type string, token_length int, page_start int, page_end int, clinical_quality_score double, contains_medication boolean, contains_lab boolean, "
           "contains_diagnosis boolean, contains_vital boolean, entities array<struct<entity_type:string,text:string,normalized_value:string,confidence:double,section_name:string,is_negated:boolean>>")
    rows = []
    for i, sec, text, neg in PASSAGES:
        e = [("diagnosis_or_problem_candidate", "infarction", "infarction", 0.9, None, True)] if i == 1 else [("vital", "bp", "bp", 0.8, None, False)]
        rows.append((i, sec, text, neg, 1, "fixed", i, "note", len(text.split()), i // 3, i // 3, 0.5 + i / 20, i == 2, i == 4, i == 1, i == 0, e))
    return spark.createDataFrame(rows, ent)


@pytest.fixture(scope="session")
def ask(spark):
    return lambda *qs: spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "query_id long, query string")
