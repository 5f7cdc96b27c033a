"""Linear tests before the patterns of rules, document types and headings."""

import random
import re

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.udfs import has_bit, may_match, relaxed
from docloom.operators import extraction as xt
from docloom.operators import vocab as V

TEXTS = [None, "", "  BP:  120/80\tHR 88", "Glucose: 120 mg/dL, sodium low 130; troponin i 5", "No evidence of pneumonia. Denies chest pain", "History of asthma\u2028",
         "PROGRESS NOTE of an office visit", "Chest X-ray, CT scan of knee after arthroscopy 3/14/2024", "ruled\tout infarction", "Current Drug Allergies:", "Discharge Plan", "µg 5 é",
         "Age\x0b45 patient: John Smith", "Take Newdrug 5 ml daily, pantoprazole", "high value, low mood", "3) MEDICATIONS --", "piano. Clear of it"]


def lines(spark):
    rnd = random.Random(5)
    words = " ".join(t for t in TEXTS if t).split()
    rows = TEXTS + [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(300)]
    return spark.createDataFrame([(i // 9, i, 0, ["allergies", None, "plan"][i % 3], t) for i, t in enumerate(rows)],
                                 "document_id long, element_id long, page_number int, section_name string, text string")


def test_relaxed_patterns():
    assert relaxed(r"(?i)\bage\s*[\s:]?$") == r"(?i)age[\s\x0b]*[\s\x0b:]?"
    for p in (r"(?=a)b", r"[^a]b", r"(a)\1", r"[a-z&&[b]]", r"\p{L}", r"a\Sb", "a++"):
        assert relaxed(p) is None
    assert all(relaxed(r.pattern) for r in xt.rules())


def test_linear_tests_miss_nothing(spark):
    patterns = [r.pattern for r in xt.rules()] + [p for ps in V.DOCUMENT_TYPES.values() for p, _ in ps]
    df = lines(spark).withColumn("low", F.lower("text")).withColumn("may", may_match([(i % 2, relaxed(p)) for i, p in enumerate(patterns)])("text", "low"))
    lost = [F.count_if(F.col(("text", "low")[i % 2]).rlike(p) & ~has_bit(F.col("may"), i)) for i, p in enumerate(patterns)]
    assert set(df.agg(*[c.alias(str(i)) for i, c in enumerate(lost)]).first()) == {0}
    broken = spark.createDataFrame([(bytes([255, 97]),), (b"b",)], "b binary").coalesce(1).select(F.expr("cast(b as string)").alias("t"))
    assert broken.select(has_bit(may_match([(0, "x")])("t"), 0)).collect() == [(True,), (True,)]  # no UTF-8: the pattern decides


def test_rules_find_what_plain_patterns_find(spark):
    df = lines(spark)
    got = {tuple(r) for r in xt.pattern_entities(df).select("element_id", "source", "entity_text").collect()}
    plain = df.withColumn("clean", tx.lower_clean("text"))
    rs = [r for r in xt.rules() if not (r.only or r.unless or r.ends or r.fixed or r.min_len or r.source.startswith("age"))]
    found = plain.select("element_id", *[F.regexp_extract_all("clean" if r.lower else "text", F.lit(r.pattern), F.lit(0)).alias(f"r{i}") for i, r in enumerate(rs)]).collect()
    want = {(x.element_id, r.source, m) for x in found for i, r in enumerate(rs) for m in x[f"r{i}"] or ()}
    sources = {s for _, s, _ in want}
    assert {x for x in got if x[1] in sources} == want and len(sources) > 10


def test_rules_are_searched_once(spark):
    """Spark adds a filter on the size of an inlined column, which finds everything once more."""
    plan = xt.pattern_entities(lines(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" in plan and "size(flatten" not in plan


def test_document_types_and_negation_as_by_plain_patterns(spark):
    df = lines(spark).select(F.col("element_id").alias("document_id"), "text")
    scores = []
    for i, (name, pats) in enumerate(V.DOCUMENT_TYPES.items()):
        s = sum((F.when(F.lower("text").rlike(p), w).otherwise(0.0) for p, w in pats), F.lit(0.0))
        scores.append(F.struct((F.floor(F.least(F.lit(1.0), s) * 1e6 + 0.5) / 1e6).alias("s"), F.lit(-i), F.lit(name).alias("n")))
    want = df.select("document_id", F.array_max(F.array(*scores)).alias("b")).select("document_id", F.when(F.col("b.s") <= 0, "Unknown").otherwise(F.col("b.n")))
    typed = xt.classify_documents(df)
    assert sorted(typed.select("document_id", "document_type").collect()) == sorted(want.collect())
    assert "ArrowEvalPython" in typed._jdf.queryExecution().executedPlan().toString()
    assert all(re.fullmatch(r"\\b[a-z/ ]+\\b", p) for p in V.NEGATION)
    cues = "(?i)" + "|".join(f"(?:{p})" for p in V.NEGATION)
    first = F.get(F.filter(tx.sentences("text"), lambda s: F.contains(tx.lower_clean(s), F.col("e"))), F.lit(0))
    low = tx.lower_clean("text")
    near = F.when(F.call_function("locate", F.col("e"), low) > 0, low)  # shorter than the look-back
    for word in ("a", "o", "infarction"):
        x = df.filter("length(text) < 110 or text is null").withColumn("e", F.lit(word)).withColumn("want", F.coalesce(first, near, F.col("text")).rlike(cues))
        got = x.withColumn("got", xt.is_negated(F.col("text"), F.col("e")))
        cut = F.call_function("locate", F.col("e"), low)
        bad = got.filter(first.isNotNull() | (cut == 0)).filter(~F.col("got").eqNullSafe(F.col("want")))
        assert bad.count() == 0


def test_alternatives_as_a_tree(spark):
    words = ["ck", "ck-mb", "ckmb", "troponin", "troponin i", "t3", "free t3", "25-oh vitamin d"]
    found = f"\\b({xt.tree(words)})\\b", f"\\b({xt.lab_names_pattern(words)})\\b"
    texts = spark.createDataFrame([("ck-mb 3 ck ckm ckmb free t3 t3 troponin i, troponin in 25-oh vitamin d",)], "t string")
    a, b = texts.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(1)) for p in found]).first()
    assert a == b and len(a) == 8
