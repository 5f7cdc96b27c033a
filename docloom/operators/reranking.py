"""Rerankers: candidates in, reordered candidates out.

Candidates are the ranked lists of a query batch joined to their units
(``candidates``).  Every reranker keeps ``query_id, doc_idx, original_rank,
original_score`` and adds ``rerank_score`` and the new ``rank``; ties keep the
retrieval order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import minmax, quantize, topk
from docloom.functions.udfs import min_cover_span
from docloom.operators.retrieval import mmr_select

Q = ["query_id"]
OUT = ["query_id", "doc_idx", "original_rank", "original_score", "rerank_score", "rank"]
PREVIEW_CHARS: int | None = None  # whole texts; a number cuts what the rerankers see

# Intent -> (query terms, flag, entity types).
INTENTS: dict[str, tuple[list[str], str, list[str]]] = {
    "medication": (
        ["medication", "medications", "medicine", "drug", "dose", "tablet", "prescription", "rx"],
        "contains_medication", ["medication_candidate", "medication_line_candidate"]),
    "diagnosis": (
        ["diagnosis", "assessment", "impression", "problem", "dx"],
        "contains_diagnosis", ["diagnosis_code_candidate", "diagnosis_or_problem_candidate"]),
    "vital": (["vital", "vitals", "blood", "pressure", "temperature", "pulse"], "contains_vital", ["vital"]),
    "lab": (["lab", "labs", "laboratory", "result", "test"], "contains_lab", ["lab_result"]),
}
# Fixed values.
TEMPORAL_TERMS = ["date", "recent", "latest", "today", "yesterday", "follow", "followup", "follow-up", "history"]
QUALITY_FLAGS = ["contains_medication", "contains_lab", "contains_diagnosis", "contains_vital"]
SECTION_BONUS = {
    "assessment": 0.25, "assessment and plan": 0.25, "plan": 0.20, "impression": 0.22, "findings": 0.20,
    "diagnosis": 0.22, "diagnoses": 0.22, "discharge diagnosis": 0.22, "discharge summary": 0.18,
    "history of present illness": 0.15, "hpi": 0.15, "physical examination": 0.12, "physical exam": 0.12,
    "results": 0.15, "laboratory results": 0.18, "lab results": 0.18, "recommendations": 0.18,
    "problem list": 0.20, "active problems": 0.20,
    "demographics": -0.15, "administrative": -0.15, "header": -0.12, "footer": -0.12, "signature": -0.10,
    "attestation": -0.10, "page header": -0.08, "page footer": -0.08,
}


def candidates(ranked: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked lists with query tokens ``qt``, preview tokens ``tt`` and the
    unit's metadata.  Lists are short, so they are the side that gets joined."""
    c = ranked.select("query_id", "doc_idx", F.col("rank").alias("original_rank"), F.col("score").alias("original_score"))
    c = c.join(queries.select("query_id", "query"), "query_id").join(docs, "doc_idx")
    c = c.withColumn("text_preview", F.col("text") if PREVIEW_CHARS is None else F.substring("text", 1, PREVIEW_CHARS))
    return c.withColumn("qt", tx.tokens("query")).withColumn("tt", tx.tokens("text_preview")).withColumn("qd", F.array_distinct("qt"))


def finish(c: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    c = c.withColumn("rerank_score", quantize(score))
    return topk(c, Q, [F.desc("rerank_score"), F.asc("original_rank")], k).select(*OUT)


def _norm() -> Column:
    return minmax(F.col("original_score"), Q)


def _count(arr: str, t: Column) -> Column:
    return F.size(F.filter(arr, lambda x: x == t))


def _sum(arr: Column, zero: float | int = 0) -> Column:
    return F.aggregate(arr, F.lit(zero), lambda a, x: a + x)


def _entity_terms(c: DataFrame, only: Callable[[Column], Column] | None = None) -> DataFrame:
    ents = F.col("entities") if only is None else F.filter("entities", only)
    text = F.array_join(F.flatten(F.transform(ents, lambda e: F.array(F.coalesce(e["text"], F.lit("")), F.coalesce(e["normalized_value"], F.lit(""))))), " ")
    c = c.withColumn("et", tx.distinct_tokens(F.coalesce(text, F.lit("")))).withColumn("ql", F.filter("qd", lambda t: F.length(t) > 2))
    return c.withColumn("share", F.when(F.size("ql") > 0, F.size(F.array_intersect("ql", F.filter("et", lambda t: F.length(t) > 2))) / F.size("ql")).otherwise(0.0))


# ---- score columns (used alone and by the weighted mix)
def keyword_score(c: DataFrame) -> DataFrame:
    c = c.withColumn("mt", F.transform("qd", lambda t: F.least(_count("qt", t), _count("tt", t))))
    cover = F.size(F.filter("mt", lambda n: n > 0)) / F.greatest(F.size("qd"), F.lit(1))
    return c.withColumn("keyword", quantize(cover * 5.0 + F.log1p(_sum(F.col("mt")).cast("double"))))


def metadata_score(c: DataFrame) -> DataFrame:
    flags = sum((F.when(F.col(f), 1).otherwise(0) for f in QUALITY_FLAGS), F.lit(0))
    s = (F.coalesce("clinical_quality_score", F.lit(0.0))
         + F.when(F.coalesce("primary_section", F.lit("")) != "", 0.15).otherwise(0.0)
         + F.least(F.lit(0.25), 0.05 * F.coalesce(F.size("entities"), F.lit(0))) + 0.05 * flags)
    return c.withColumn("metadata", quantize(s))


def intent_score(c: DataFrame) -> DataFrame:
    lists = {n: F.array(*[F.lit(t) for t in terms]) for n, (terms, _, _) in INTENTS.items()}
    for n, terms in lists.items():
        c = c.withColumn(f"_on_{n}", F.arrays_overlap("qd", terms))
    none = ~(F.col("_on_medication") | F.col("_on_diagnosis") | F.col("_on_vital") | F.col("_on_lab"))
    total = F.lit(0.0)
    for n, (_, flag, types) in INTENTS.items():
        ents = F.size(F.filter("entities", _type_in(types)))
        text = F.size(F.array_intersect(F.array_intersect("qd", lists[n]), "tt")) > 0
        s = F.when(F.col(flag), 1.0).otherwise(0.0) + F.least(F.lit(1.0), F.coalesce(ents, F.lit(0)).cast("double")) + F.when(text, 0.5).otherwise(0.0)
        total = total + F.when(none | F.col(f"_on_{n}"), s).otherwise(0.0)
    return c.withColumn("clinical", quantize(total))


def _type_in(types: Sequence[str]) -> Callable[[Column], Column]:
    return lambda e: e["entity_type"].isin(list(types))


def length_score(c: DataFrame, target_min: int = 128, target_max: int = 1200) -> DataFrame:
    n = F.coalesce("token_length", F.lit(0)).cast("double")
    s = F.when(n.between(target_min, target_max), 1.0).when(n < target_min, n / max(1.0, target_min)).otherwise(target_max / F.greatest(n, F.lit(1.0)))
    return c.withColumn("length", quantize(0.65 * _norm() + 0.35 * s))


# ---- rerankers
def score_passthrough(c: DataFrame, k: int | None = None) -> DataFrame:
    return finish(c, F.col("original_score"), k)


def keyword_overlap(c: DataFrame, k: int | None = None) -> DataFrame:
    return finish(keyword_score(c), F.col("keyword"), k)


def phrase_proximity(c: DataFrame, k: int | None = None, proximity_window: int = 20) -> DataFrame:
    c = c.withColumn("hits", F.transform("qd", lambda t: F.array_compact(F.transform("tt", lambda x, i: F.when(x == t, i)))))
    c = c.withColumn("hits", F.filter("hits", lambda p: F.size(p) > 0)).withColumn("span", min_cover_span("hits"))
    prox = F.when(F.col("span").isNull(), 0.0).otherwise(
        1.0 / F.greatest(F.col("span").cast("double"), F.lit(1.0)) + F.when(F.col("span") <= proximity_window, 1.0).otherwise(0.0))
    lead = F.array_join(F.slice("qd", 1, 3), " ")
    phrase = F.when(F.contains(F.array_join("tt", " "), lead), 1.0).otherwise(0.0)
    return finish(c, 4.0 * F.size("hits") / F.greatest(F.size("qd"), F.lit(1)) + prox + phrase, k)


def metadata_quality(c: DataFrame, k: int | None = None) -> DataFrame:
    return finish(metadata_score(c), F.col("metadata"), k)


def clinical_intent(c: DataFrame, k: int | None = None) -> DataFrame:
    return finish(intent_score(c), F.col("clinical"), k)


def length_penalty(c: DataFrame, k: int | None = None, target_min: int = 128, target_max: int = 1200) -> DataFrame:
    return finish(length_score(c, target_min, target_max), F.col("length"), k)


def recency_date(c: DataFrame, k: int | None = None) -> DataFrame:
    pat = "(?<![0-9A-Za-z_])(?:" + tx.DATE + ")(?![0-9A-Za-z_])"
    temporal = F.arrays_overlap("qd", F.array(*[F.lit(t) for t in TEMPORAL_TERMS])) | F.col("query").rlike(pat)
    dates = F.regexp_count("text_preview", F.lit(pat)) + F.coalesce(F.size(F.filter("entities", _type_in(["date"]))), F.lit(0))
    return finish(c, F.when(temporal, 0.6 * _norm() + 0.4 * F.least(F.lit(1.0), 0.25 * dates)).otherwise(_norm()), k)


def _grouped(c: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    small = c.withColumn("norm", _norm()).select("query_id", "doc_idx", "original_rank", "original_score", "norm", F.array_distinct("tt").alias("tt"))
    return small.groupBy("query_id").applyInPandas(
        fn, "query_id long, doc_idx long, original_rank int, original_score double, rerank_score double, rank int")


def diversity_mmr(c: DataFrame, k: int | None = None, lambda_mult: float = 0.75) -> DataFrame:
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("original_rank").reset_index(drop=True)
        got = mmr_select(list(pdf["norm"]), [set(t) for t in pdf["tt"]], k or len(pdf), lambda_mult)
        out = pdf.loc[[i for i, _ in got], ["query_id", "doc_idx", "original_rank", "original_score"]].copy()
        out["rerank_score"] = [round(max(0.0, v), 6) for _, v in got]
        out["rank"] = range(1, len(out) + 1)
        return out

    return _grouped(c, pick)


def deduplicate(c: DataFrame, k: int | None = None, similarity_threshold: float = 0.92) -> DataFrame:
    """Keep-first by unit and by near-equal preview tokens."""
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("original_rank").drop_duplicates("doc_idx").reset_index(drop=True)
        kept: list[tuple[int, set]] = []
        for i, toks in enumerate(pdf["tt"]):
            t = set(toks)
            if not any(t and o and len(t & o) / len(t | o) >= similarity_threshold for _, o in kept):
                kept.append((i, t))
            if k and len(kept) >= k:
                break
        out = pdf.loc[[i for i, _ in kept], ["query_id", "doc_idx", "original_rank", "original_score"]].copy()
        out["rerank_score"] = out["original_score"]
        out["rank"] = range(1, len(out) + 1)
        return out

    return _grouped(c, keep)


def hybrid_weighted(c: DataFrame, k: int | None = None, weights: Sequence[float] = (0.35, 0.25, 0.20, 0.15, 0.05)) -> DataFrame:
    c = length_score(intent_score(metadata_score(keyword_score(c))))
    parts = ["original_score", "keyword", "metadata", "clinical", "length"]
    return finish(c, sum((w * minmax(F.col(p), Q) for w, p in zip(weights, parts)), F.lit(0.0)), k)


def entity_coverage(c: DataFrame, k: int | None = None, retrieval_weight: float = 0.45, entity_weight: float = 0.55) -> DataFrame:
    return finish(_entity_terms(c), retrieval_weight * _norm() + entity_weight * F.col("share"), k)


def section_priority(c: DataFrame, k: int | None = None, bonus: dict[str, float] | None = None) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in (bonus or SECTION_BONUS).items() for x in kv])
    b = F.coalesce(F.element_at(table, F.lower(F.trim(F.coalesce("primary_section", F.lit(""))))), F.lit(0.0))
    return finish(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _norm() + b)), k)


def bm25_rescore(c: DataFrame, k: int | None = None, k1: float = 1.2, b: float = 0.75, parity: bool = False) -> DataFrame:
    """BM25 with document frequencies of the candidate list itself.  ``parity``
    counts a candidate once per repetition of the term in the query."""
    by_q = Window.partitionBy("query_id")
    c = c.withColumn("n", F.count("*").over(by_q)).withColumn("dl", F.size("tt")).withColumn("avgdl", F.greatest(F.lit(1.0), F.avg("dl").over(by_q)))
    tf = F.transform(F.filter("qd", lambda t: F.length(t) > 1), lambda t: F.struct(t.alias("term"), _count("qt", t).alias("qtf"), _count("tt", t).alias("tf")))
    x = c.select("query_id", "doc_idx", "original_rank", "original_score", "n", "dl", "avgdl", tf.alias("tfs"))
    ex = x.select("*", F.explode_outer("tfs").alias("t")).select("*", "t.*").drop("tfs", "t")
    df = F.sum(F.when(F.col("tf") > 0, F.col("qtf") if parity else F.lit(1)).otherwise(0)).over(Window.partitionBy("query_id", "term"))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    part = F.when(F.col("tf") > 0, F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    ex = ex.withColumn("part", part)
    g = ex.groupBy("query_id", "doc_idx", "original_rank", "original_score").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("raw"))
    return finish(g, F.col("raw") / F.greatest(F.max("raw").over(by_q), F.lit(1e-9)), k)


def negation_filter(c: DataFrame, k: int | None = None, negation_penalty: float = 0.40) -> DataFrame:
    c = _entity_terms(c, lambda e: e["is_negated"])
    pen = F.when(F.col("contains_negation"), F.col("share")).otherwise(0.0)
    return finish(c, F.greatest(F.lit(0.0), _norm() - negation_penalty * pen), k)


def position_bias_correction(c: DataFrame, k: int | None = None, retrieval_weight: float = 0.60,
                             correction_weight: float = 0.40, correction_k: int = 20) -> DataFrame:
    return finish(c, retrieval_weight * _norm() + correction_weight / (F.col("original_rank") + float(correction_k)), k)


# Registered names, in report order.
DEFAULT_RERANKERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    score_passthrough, keyword_overlap, phrase_proximity, metadata_quality, clinical_intent, length_penalty,
    recency_date, diversity_mmr, deduplicate, hybrid_weighted, entity_coverage, section_priority, bm25_rescore,
    negation_filter, position_bias_correction)}


def rerank_chain(names: Sequence[str], ranked: DataFrame, queries: DataFrame, docs: DataFrame, k: int | None = None,
                 registry: dict[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Rerankers applied in sequence; each sees the previous order as its
    input order and keeps the retrieval score."""
    table = registry or DEFAULT_RERANKERS
    cur, out = ranked, None
    for n in names:
        if n not in table:
            raise KeyError(f"unknown reranker: {n}")
        out = table[n](candidates(cur, queries, docs))
        cur = out.select("query_id", "doc_idx", F.col("original_score").alias("score"), "rank")
    if out is None:
        raise ValueError("no rerankers given")
    return out if k is None else out.filter(F.col("rank") <= k)
