"""Dictionary matching, medication and laboratory parts, scoped negation."""

import dataclasses

from pyspark.sql import functions as F

from docloom.operators import extraction as xt


def lines(spark, *texts, section=None):
    return spark.createDataFrame([(1, i, 0, section, t) for i, t in enumerate(texts)],
                                 "document_id long, element_id long, page_number int, section_name string, text string")


def terms(spark, *ws):
    return spark.createDataFrame([(w, len(w)) for w in ws], "term string, weight int")


LONG = "acute on chronic diastolic congestive heart failure with preserved function"


def test_terms_of_any_length_at_every_place(spark):
    t = terms(spark, "heart failure", "failure", LONG, "Crohn's disease", "...", "covid-19", "heart failure")
    got = xt.term_places(lines(spark, f"Has {LONG}; failure. CROHN'S  Disease", "Covid 19 heart", None, ""), t)
    assert sorted((r.element_id, r["at"], r.n, r.term) for r in got.collect()) == [
        (0, 1, 10, LONG), (0, 6, 2, "heart failure"), (0, 7, 1, "failure"), (0, 11, 1, "failure"), (0, 12, 3, "Crohn's disease"), (1, 0, 2, "covid-19")]
    apart = xt.term_places(lines(spark, f"Has {LONG}; failure. CROHN'S  Disease"), t, overlaps=False)
    assert sorted((r["at"], r.term, r.weight) for r in apart.collect()) == [(1, LONG, len(LONG)), (11, "failure", 7), (12, "Crohn's disease", 15)]
    assert xt.term_places(lines(spark, "a b"), terms(spark)).count() == 0 and xt.term_places(lines(spark), t).count() == 0


def test_medication_parts(spark):
    got = xt.medication_details(lines(spark, "Take metformin 500 mg daily", "pantoprazole then Newdrug 5 ml", "aspirin"), terms(spark, "metformin", "aspirin"))
    rows = {(r.element_id, r.entity_type, r.entity_text, r.dose, r.unit, r.drug_class) for r in got.collect()}
    assert rows == {(0, "medication", "metformin", "500", "mg", None), (2, "medication", "aspirin", None, None, None),
                    (0, "medication_line_candidate", "Take metformin 500 mg daily", None, None, None),
                    (1, "medication_class", "pantoprazole", None, None, "azole antifungal/PPI"), (1, "medication_class", "pantoprazole", None, None, "proton pump inhibitor"),
                    (1, "medication_candidate", "Newdrug 5 ml", "5", "ml", None)}


def test_laboratory_parts(spark):
    got = xt.lab_details(lines(spark, "Total cholesterol: high 240 mg/dL, C-reactive protein 5", "sodium 140 (135 - 145)", "no digits: sodium"))
    rows = sorted(((r.element_id, r.lab_name, r.flag, r.value, r.unit, r.is_abnormal, r.low, r.high) for r in got.collect()), key=repr)
    assert rows == [(0, "c-reactive protein", None, "5", None, False, None, None), (0, "total cholesterol", "high", "240", "mg/dl", True, None, None),
                    (1, "sodium", None, "140", None, False, None, None), (1, "sodium", None, None, None, None, "135", "145")]


def test_negation_is_scoped(spark):
    rows = [("No fever. Patient has asthma.", "asthma", False), ("Denies asthma. Has fever.", "asthma", True), ("Not seen by dr. st. john today", "dr. st. john", True),
            ("Not " + "x" * 130 + " by st. john", "st. john", False), ("nothing here", "asthma", False), ("no mention", "asthma", True)]
    df = spark.createDataFrame(rows, "text string, entity string, want boolean")
    got = df.select("want", xt.is_negated(F.col("text"), F.col("entity")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_terms_that_begin_alike(spark):
    ws = ["the " + "abcdefghij"[i // 10] + " " + "abcdefghij"[i % 10] for i in range(100)]
    text = spark.createDataFrame([(1, 2, 0, None, "The a b the j j, the"), (1, 2, 0, None, "the c d"), (1, 2, 0, None, "the c d"), (None, 3, 0, None, "the the e f")],
                                 "document_id long, element_id long, page_number int, section_name string, text string")
    places = xt.term_places(text, terms(spark, *ws))
    assert sorted((r.element_id, r["at"], r.n, r.term) for r in places.collect()) == [
        (2, 0, 3, "the a b"), (2, 0, 3, "the c d"), (2, 0, 3, "the c d"), (2, 3, 3, "the j j"), (3, 1, 3, "the e f")]
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(n" not in plan  # no list of all the terms that begin alike
    with_text = xt.dictionary_entities(text, terms(spark, *ws), "term", 0.5)
    without = xt.dictionary_entities(text, terms(spark, *ws), "term", 0.5, text=False)
    assert "text" not in without.columns
    assert sorted(with_text.drop("text").collect(), key=repr) == sorted(without.collect(), key=repr) and without.count() == 3


def test_rules_skip_lines_without_what_they_need(spark):
    texts = ["Take metformin 500 mg, lisinopril", "BP: 120/80, MRN: A1234 DOB: 1/2/1950", "history of asthma, on 3 March 2024", "Chest X-RAY after ARTHROSCOPY", "allergic to dust. 45 y/o woman", None, ""]
    rs = [r for r in xt.rules() if r.entity_type != "allergy" or not r.only]
    bare = [dataclasses.replace(r, needs=(), digit=False) for r in rs]
    assert sum(bool(r.needs or r.digit) for r in rs) > 40
    got = [sorted(map(repr, xt.pattern_entities(lines(spark, *texts), x).collect())) for x in (rs, bare)]
    assert got[0] == got[1] and len(got[0]) >= 10
