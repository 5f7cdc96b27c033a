import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking as ch
from docloom.operators import evaluation as ev
from docloom.operators import extraction as xt
from docloom.operators import indexing as ix
from docloom.operators import query_understanding as qu
from docloom.operators import reranking as rk
from docloom.operators import retrieval as rt
from docloom.operators import semantic as sem
from docloom.plans.answering import answer
from docloom.plans.config import EngineConfig, preset
from docloom.plans.registry import IndexManager, LexicalSearch, Registry
from docloom.sources.corpus import build_corpus
from docloom.streaming import requests as rq


def ids(df, q=0):
    return [r.doc_idx for r in df.filter(F.col("query_id") == q).orderBy("rank").collect()]


def test_bm25_finds_medications(units, ask):
    assert 2 in ids(rt.bm25(ask("metformin lisinopril aspirin"), ix.bm25_index(units), 3))
    assert ix.bm25_index(units)["vocab"].filter("idf <= 0").count() == 0


def test_numeric_range(units, ask):
    q = ask("glucose > 200", "between 140 and 150", "no numbers here")
    got = rt.numeric_range(q, ix.numeric_index(units.drop("entities")), ix.bm25_index(units), 10)
    assert 4 in ids(got, 0) and ids(got, 1) == [0] and 2 not in ids(got, 1)
    b = {r.query_id: r for r in rt.numeric_bounds(ask("glucose between 70 and 120", "around 150", ">= 5")).collect()}
    assert (b[0].gte, b[0].lte) == (70.0, 120.0) and b[1].gte == pytest.approx(127.5) and b[2].gte == 5.0 and b[2].gt is None


def test_numeric_context_offsets(units):
    for r in ix.numeric_context(units).join(units.select("doc_idx", "text"), "doc_idx").collect():
        assert float(r.text[r.start:].split()[0].rstrip(",.").split("/")[0].split("-")[0] or 0) == r.numeric_value


def test_section_scoped_and_negation(units, ask):
    q = ask("diagnosis myocardial infarction")
    base = rt.bm25(q, ix.bm25_index(units), 8)
    assert 1 in ids(rt.section_scoped(base, units, 5))
    before = {r.doc_idx: r.score for r in base.collect()}
    after = {r.doc_idx: r.score for r in rt.negation_aware(base, q, units, 8).collect()}
    assert after[1] < before[1]


def test_index_invariants(units):
    v = ix.sentence_index(units)["vocab"]
    assert v.filter("sentence_df < df").count() == 0
    assert ix.cooccurrence_index(units)["postings"].filter("type_a > type_b").count() == 0
    assert sorted(ix.DEFAULT_INDEXERS) == sorted(set(ix.DEFAULT_INDEXERS)) and len(ix.DEFAULT_INDEXERS) == 18


def test_minhash_links_copies(spark):
    t = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(0, t), (1, t), (2, "something else entirely here now today"), (3, "")], "doc_idx long, text string")
    i = ix.minhash_index(d)
    assert [(r.left_doc_idx, r.right_doc_idx, r.shared_bucket_count) for r in i["links"].collect()] == [(0, 1, 8)]
    got = rt.duplicates(spark.createDataFrame([(0, 1)], "query_id long, doc_idx long"), i, 5)
    assert ids(got) == [1, 0]


def test_graph_expansion_matches_pair_edges(units, ask):
    """Group edges give the scores an explicit pair list would give."""
    c = units.withColumn("start_index", F.col("doc_idx") * 20).withColumn("end_index", F.col("doc_idx") * 20 + 25).withColumn("primary_section", F.lit("s"))
    g = ix.chunk_graph_index(c)
    base = rt.bm25(ask("metformin hypertension"), ix.bm25_index(units), 3)
    got = {r.doc_idx: r.score for r in rt.graph_expansion(base, g, 8).collect()}
    b = {r.doc_idx: r.score for r in base.collect()}
    want = dict(b)
    edges = [(r.source_doc_idx, r.target_doc_idx, r.weight) for r in g["edges"].collect()]
    edges += [(i, j, 0.35) for i in range(8) for j in range(8) if i != j]
    for s, t, w in edges:
        if s in b:
            want[t] = max(want.get(t, 0), b[s] * w)
    assert {k: round(v, 4) for k, v in got.items()} == {k: round(v, 4) for k, v in want.items()}


def test_variants(ask):
    v = [r.query for r in rt.abbreviation_variants(ask("MI and HTN")).orderBy("variant").collect()]
    assert v[0] == "MI and HTN" and "myocardial infarction and HTN" in v and len(v) <= 5
    assert qu.expand(ask("HTN today")).count() == 2


def test_mmr_brute_force():
    texts = [{"a", "b"}, {"a", "b"}, {"c"}]
    assert [i for i, _ in rt.mmr_select([1.0, 0.95, 0.8], texts, 3, 0.5)] == [0, 2, 1]


@pytest.mark.parametrize("name", list(rk.DEFAULT_RERANKERS))
def test_reranker_contract(units, ask, name):
    q = ask("blood pressure diagnosis metformin")
    base = rt.bm25(q, ix.bm25_index(units), 6)
    out = rk.DEFAULT_RERANKERS[name](rk.candidates(base, q, units)).orderBy("rank").collect()
    assert out and set(out[0].asDict()) == set(rk.OUT)
    assert [r.rank for r in out] == list(range(1, len(out) + 1)) and len({r.doc_idx for r in out}) == len(out)
    if name not in ("diversity_mmr", "deduplicate"):
        s = [r.rerank_score for r in out]
        assert s == sorted(s, reverse=True)


def test_chunkers_cover_documents(spark):
    text = "\n".join(f"Line {i} has some words here. And a second sentence." for i in range(130))
    c = build_corpus(spark.createDataFrame([(1, text), (2, ""), (3, "short")], "doc_id long, text string"))
    total = c.documents.agg(F.sum("token_count")).first()[0]
    for name, fn in ch.DEFAULT_CHUNKERS.items():
        s = ch.finish(fn(c), c, name)
        cov = ev.coverage(s, c.documents).agg(F.sum("covered_tokens")).first()[0]
        assert cov == total, name
        assert s.groupBy("document_id", "chunk_id").count().filter("count > 1").count() == 0, name


def test_pack_spans_brute_force():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        ends = np.cumsum(rnd.integers(1, 50, 40))
        starts = np.concatenate([[0], ends[:-1]])
        i, want = 0, []
        while i < 40:
            j = i + 1
            while j < 40 and ends[j] - starts[i] <= 120:
                j += 1
            want.append((i, j))
            if j >= 40:
                break
            i = max(i + 1, j - 1)
        assert ch.pack_spans(starts, ends, 120, 1) == want


def test_dense_is_exact(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_idx long, vector array<double>")
    got = ids(sem.dense(df.filter("doc_idx = 7").select(F.lit(0).cast("long").alias("query_id"), "vector"), df, 5))
    assert got == [int(i) for i in np.argsort(-(v @ v[7]))[:5]]


def test_gini_entropy(spark):
    df = spark.createDataFrame([("a", x) for x in (10, 10, 10, 10)] + [("b", x) for x in (0, 0, 0, 1000)], "s string, x int")
    g = {r.s: r.gini for r in ev.gini(df, ["s"], "x").collect()}
    assert g["a"] == 0 and g["b"] > 0.7
    e = {r.s: r.entropy_bits for r in ev.entropy_bits(df, ["s"], "x").collect()}
    assert e["a"] == 0.0 and e["b"] == pytest.approx(0.8112781)


def test_sections_and_entities(spark):
    rows = [(1, 0, 0, "Medications:"), (1, 1, 0, "Take metformin 500 mg daily."), (1, 2, 0, "ASSESSMENT"), (1, 3, 0, "No evidence of pneumonia. BP: 120/80")]
    lines = spark.createDataFrame(rows, "document_id long, element_id long, page_number int, text string")
    s = {r.element_id: r.section_name for r in xt.assign_sections(lines).collect()}
    assert s == {0: "medications", 1: "medications", 2: "assessment", 3: "assessment"}
    t = lambda *w: spark.createDataFrame([(x,) for x in w], "term string")
    e = xt.extract_entities(xt.assign_sections(lines), t("metformin"), t("pneumonia")).collect()
    by = {(r.entity_type, r.normalized_value): r for r in e}
    assert by[("medication", "metformin")].confidence == pytest.approx(0.92)
    assert by[("diagnosis_or_problem", "pneumonia")].is_negated is True
    assert any(r.entity_type == "vital" for r in e)


def test_registry_collision_and_errors():
    r = Registry("thing", {"a": lambda: 1})
    with pytest.raises(ValueError):
        r.register("a", lambda: 2)
    r.register("a", lambda: 2, force=True)
    r.register("bad", lambda: 1 / 0)
    assert r.run_all(None, lambda n, f: f()) == {"a": 2} and "bad" in r.errors


def test_config_round_trip():
    c = preset("precise")
    assert EngineConfig.from_json(c.to_json()) == c
    assert EngineConfig().with_env({"DOCLOOM_RETRIEVAL_TOP_K": "20"}).retrieval.top_k == 20


def test_stored_index_and_answers(units, ask, tmp_path):
    m = IndexManager(str(tmp_path))
    opened = m.build_all("fixed", units, ["bm25", "keyword_inverted"])
    search = LexicalSearch(units, opened)
    assert len(search.names()) == 27
    cfg = EngineConfig()
    cfg.retrieval.retrievers = ["bm25", "keyword_exact"]
    a = answer(ask("metformin dose"), units, search, cfg)
    assert a.answers.count() == 1 and a.citations.first().citation_number == 1
    assert 0 <= a.metrics.first().overall <= 1


def test_request_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    msg = lambda i, p: json.dumps({"request_id": i, "reply_topic": "r", "payload": json.dumps(p)})
    (src / "a.txt").write_text("\n".join([msg("1", {"text": "a b c d", "chunk_size": 2}), msg("1", {"text": "dup"}), "not json", msg("2", {"chunk_size": 2})]))
    q = rq.serve(rq.read_requests(spark, str(src)), rq.chunk_handler, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(90)
    got = {r.request_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(got) == {"1", "2"} and got["1"].ok and not got["2"].ok
    # redelivered later, in a batch of its own
    (src / "b.txt").write_text("\n".join([msg("1", {"text": "late"}), msg("3", {"text": "x"})]))
    q = rq.serve(rq.read_requests(spark, str(src)), rq.chunk_handler, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(90)
    assert sorted(r.request_id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_phrases_end_and_allergy_rules(spark):
    from docloom.operators import extraction as xt

    lines = [
        "history of diabetes mellitus, stable", "history of gout.", "history of a very long phrase that goes on and on past the bound of fifty letters",
        "Allergic to penicillin; latex allergy", "Lactose intolerance", "NKDA. Allergic to nothing", "Shellfish", "reaction to iodine"]
    d = spark.createDataFrame([(0, i, 1, "allergies", t) for i, t in enumerate(lines)], "document_id long, element_id long, page_number int, section_name string, text string")
    got = {(r.element_id, r.entity_type, r.entity_text, r.normalized_value, r.confidence)
           for r in xt.pattern_entities(d, [r for r in xt.rules() if r.entity_type in {"past_diagnosis", "allergy", "allergy_nkda"}]).collect()}
    assert got == {
        (0, "past_diagnosis", "history of diabetes mellitus", "diabetes mellitus", 0.68),
        (3, "allergy", "allergic to penicillin", "penicillin", 0.87), (3, "allergy", "latex allergy", "latex", 0.87),
        (4, "allergy", "lactose intolerance", "lactose", 0.87), (4, "allergy", "Lactose intolerance", "lactose intolerance", 0.68),
        (5, "allergy_nkda", "NKDA. Allergic to nothing", "NKDA", 0.92), (6, "allergy", "Shellfish", "shellfish", 0.68),
        (7, "allergy", "reaction to iodine", "iodine", 0.87)}


def test_query_abbreviations_in_full(spark, ask):
    from docloom.operators import query_understanding as qu

    got = {r.query_id: r.query for r in qu.expand(ask("PE for MI", "plain", "f/u of K and PT")).collect() if r.variant == 1}
    assert got == {0: "physical examination for myocardial infarction heart attack", 2: "follow-up of potassium and physical therapy"}


def test_dense_keeps_many_vectors_of_one_query_and_rounded_ties(spark):
    from docloom.operators import semantic

    v = spark.createDataFrame([(9, [1.0]), (5, [0.99999990]), (1, [0.99999970]), (2, [-1.0])], "doc_idx long, vector array<double>")
    one = spark.createDataFrame([(0, [1.0])], "query_id long, vector array<double>")
    assert [r.doc_idx for r in semantic.dense(one, v, 1).collect()] == [1]
    many = spark.createDataFrame([(0, [float(i % 2)]) for i in range(2999)] + [(0, [-1.0])], "query_id long, vector array<double>")
    assert semantic.dense(many, v.filter("doc_idx = 2"), 5000).count() >= 1


def test_filtered_hits_keep_the_hit_contract(units, ask):
    from docloom.operators import retrieval

    got = retrieval.filtered_hits(ask("a", "b"), units, {"contains_lab": True}, 3).collect()
    assert {(r.query_id, r.doc_idx, r["rank"]) for r in got} == {(0, 4, 1), (1, 4, 1)}
