"""Context text as a generator gets it, entities named by queries, focus of chunks."""

from pyspark.sql import functions as F

from docloom.operators import enrichment as en
from docloom.operators import generation as gen
from docloom.operators import query_understanding as qu
from docloom.plans.answering import extractive_answer


def hits(spark):
    rows = [(1, 10, 0.9, 0, 0, "plan", True, False, " Take aspirin. Rest.\n"), (1, 10, 0.5, 0, 0, "plan", True, False, "again"),
            (1, 11, 0.8, 1, 3, None, False, None, "four words stand here"), (1, 12, 0.7, 4, 4, "", True, True, "one two"), (2, 10, 0.3, 0, 0, "labs", False, False, "a b c d e f g h i j k l")]
    return spark.createDataFrame(rows, "query_id int, chunk_id int, score double, page_start int, page_end int, section string, contains_medication boolean, contains_lab boolean, text string")


def test_context_blocks_budget_and_notice(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, query string")
    got = {r.query_id: r for r in gen.contexts(q, hits(spark), 8).collect()}
    rule = "─"
    assert got[1].formatted_text == "\n".join([
        rule * 34, "[1] Page 1 | plan (medication)", rule * 34, "Take aspirin. Rest.", "",
        rule * 17, "[2] Pages 2–4", rule * 17, "four words stand here"])
    assert (got[1].total_tokens, got[1].truncated, got[1].truncated_count, got[1].citation_map) == (7, True, 1, {10: 1, 11: 2})
    # the first chunk overflows: nothing stays, and all are counted
    assert (got[2].formatted_text, got[2].total_tokens, got[2].truncated_count) == (gen.NO_EVIDENCE, 0, 1)
    assert (got[3].formatted_text, got[3].truncated, got[3].citation_map) == (gen.NO_EVIDENCE, False, None)
    plain = {r.query_id: r.formatted_text for r in gen.format_context(gen.assemble(hits(spark), 8), flags=False).collect()}
    assert plain == {1: got[1].formatted_text.replace(" (medication)", "").replace(rule * 34, rule * 21)}
    prompts = gen.format_context(gen.assemble(hits(spark), 8))
    assert [r.answer for r in extractive_answer(prompts).collect()] == ["Take aspirin. [1]"]


def test_long_header_and_sentence_label(spark):
    row = spark.range(1).select(gen.source_label(F.lit(2), F.lit(None).cast("int"), F.lit("s"), F.lit(4)).alias("a"), gen.source_label(F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("string")).alias("b"))
    assert row.first() == ("Sentence 5 | Page 3 | s", "Page 1")
    c = spark.createDataFrame([(1, 1, "s" * 90, "t")], "query_id int, citation_number int, section string, text string")
    assert gen.format_context(c).first().formatted_text.split("\n")[0] == "─" * 60


def test_query_entities(spark):
    rows = [(1, "Is METFORMIN or aspirin, then metformin, in the Plan or plan? HTN and f/u, not HTNx"), (2, None), (3, "replan the aspirine")]
    got = {r.query_id: r.e for r in spark.createDataFrame(rows, "query_id int, q string").select("query_id", qu.query_entities(F.col("q")).alias("e")).collect()}
    assert got[1].asDict() == {"medications": ["metformin", "aspirin", "metformin"], "diagnoses": [], "labs": [], "sections": ["plan"], "abbreviations_found": ["HTN", "f/u"]}
    assert all(not any(got[i]) for i in (2, 3))
    p = qu.process(spark.createDataFrame([(1, "HTN plan"), (2, "plain")], "query_id int, query string")).orderBy("query_id").collect()
    assert [r.expanded for r in p] == [["HTN plan", "hypertension plan"], ["plain"]] and p[0].query_type == "factual"


def test_focus_of_chunks(spark):
    rows = [
        ("ct scan contrast", {}, None), ("scanner ct contrasts", {}, None), ("", {"imaging": 2}, None), ("", {"imaging": 1}, "comparison"),
        ("presurgery, hemostasis. predraining", {}, None), ("", {"procedure": 1, "procedure_code": 1}, None), ("mg daily bid po", {}, None), ("mg daily bid", {"medication": 2}, None),
        ("ruler histories", {}, None), ("rule of history", None, None), (None, None, None), ("", {"past_diagnosis": 2}, "other")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, low string, counts map<string,int>, section string")
    flags = en.focus_flags(F.col("low"), F.col("counts"), F.col("section"))
    got = [tuple(r)[1:] for r in d.select("i", *flags.values()).orderBy("i").collect()]
    want = {0: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 9: 3, 11: 3}
    assert list(flags) == ["is_radiology_content", "is_operative_content", "is_medication_focused", "is_diagnostic_focused"]
    assert got == [tuple(want.get(i) == k for k in range(4)) for i in range(len(rows))]
