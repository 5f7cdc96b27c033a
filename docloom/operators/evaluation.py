"""Evaluation analytics: chunking, retrieval, reranking and final scores.

Every report is a group-by over long tables (one row per chunk, hit or cell);
distributions use exact percentiles, which Spark merges from partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.scores import islands, minmax, quantize, range_join


# -------------------------------------------------------------------- chunking
def gini(df: DataFrame, part: Sequence[str], x: str) -> DataFrame:
    """Gini per partition from (value, count) pairs: ranks come from running
    counts over distinct values, so no partition is sorted row by row."""
    g = df.groupBy(*part, x).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*part).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("hi", F.sum("n").over(w)).withColumn("v", F.col(x).cast("double"))
    ranks = (F.col("hi") * (F.col("hi") + 1) - (F.col("hi") - F.col("n")) * (F.col("hi") - F.col("n") + 1)) / 2
    t = g.groupBy(*part).agg(F.sum(ranks * F.col("v")).alias("dot"), F.sum(F.col("n") * F.col("v")).alias("total"), F.sum("n").alias("cnt"))
    return t.select(*part, F.when(F.col("total") == 0, 0.0).otherwise(
        2 * F.col("dot") / (F.col("cnt") * F.col("total")) - (F.col("cnt") + 1) / F.col("cnt")).alias("gini"))


def entropy_bits(df: DataFrame, part: Sequence[str], x: str, bins: int = 20) -> DataFrame:
    """Shannon entropy of an equal-width histogram; the last bin is closed."""
    b = df.groupBy(*part).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("total"))
    v = df.groupBy(*part, x).agg(F.count("*").alias("n")).join(b, list(part))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    h = v.groupBy(*part, at.alias("bin"), "total").agg(F.sum("n").alias("n")).withColumn("p", F.col("n") / F.col("total"))
    return h.groupBy(*part).agg(F.greatest(F.lit(0.0), -F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"))


def coverage(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Covered, missing and overlapping tokens and gaps per document and strategy."""
    key = ["document_id", "strategy_name"]
    m = islands(chunks, key, "start_index", "end_index")
    w = Window.partitionBy(*key).orderBy("start_index")
    gap = F.col("start_index") - F.coalesce(F.lag("end_index").over(w), F.lit(0))
    m = m.withColumn("gap", gap)
    c = m.groupBy(*key).agg(F.sum(F.col("end_index") - F.col("start_index")).alias("covered_tokens"), F.count_if(F.col("gap") > 0).alias("inner_gaps"),
                            F.max("end_index").alias("last_end"), F.max("gap").alias("inner_max"))
    t = chunks.groupBy(*key).agg(F.sum(F.col("end_index") - F.col("start_index")).alias("chunk_tokens"), F.count("*").alias("chunk_count"))
    j = c.join(t, key).join(documents.select("document_id", F.col("token_count").alias("total_tokens")), "document_id")
    tail = F.greatest(F.col("total_tokens") - F.col("last_end"), F.lit(0))
    return j.select(*key, "chunk_count", "total_tokens", "chunk_tokens", "covered_tokens",
                    F.greatest(F.col("total_tokens") - F.col("covered_tokens"), F.lit(0)).alias("missing_tokens"),
                    (F.col("inner_gaps") + (tail > 0).cast("int")).alias("gap_count"), F.greatest("inner_max", tail, F.lit(0)).alias("max_gap_tokens"),
                    F.greatest(F.col("chunk_tokens") - F.col("covered_tokens"), F.lit(0)).alias("overlap_tokens"))


def boundary_alignment(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Share of chunk starts and ends on element boundaries, by element type."""
    b = elements.select("document_id", "element_type", F.explode(F.array("start_index", "end_index")).alias("pos")).distinct()
    kinds = elements.select("element_type").distinct().agg(F.collect_list("element_type").alias("kinds")).scalar()
    pts = chunks.select("document_id", "strategy_name", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start_index").alias("pos")), F.struct(F.lit("end").alias("side"), F.col("end_index").alias("pos")))).alias("p"))
    pts = pts.select("document_id", "strategy_name", "p.side", "p.pos", F.explode(kinds).alias("element_type"))
    j = pts.join(b.withColumn("hit", F.lit(1)), ["document_id", "element_type", "pos"], "left")
    return j.groupBy("strategy_name", "element_type", "side").agg((F.avg(F.coalesce("hit", F.lit(0))) * 100).alias("aligned_pct"))


def points_inside(chunks: DataFrame, elements: DataFrame, element_type: str, width: int = 256) -> DataFrame:
    """Chunk starts strictly inside an element (a one-token interval join)."""
    p = chunks.select("document_id", "strategy_name", "chunk_id", F.col("start_index").alias("p"), (F.col("start_index") + 1).alias("p1"))
    e = elements.filter(F.col("element_type") == element_type).select("document_id", (F.col("start_index") + 1).alias("s"), F.col("end_index").alias("e"))
    hit = range_join(p, e, ["document_id"], "p", "p1", "s", "e", width).select("document_id", "strategy_name", "chunk_id").distinct()
    return hit.groupBy("strategy_name").agg(F.count("*").alias("starts_inside"))


def page_coverage(chunks: DataFrame, pages: DataFrame, width: int = 512) -> DataFrame:
    """Covered tokens of every page under each strategy's merged chunks."""
    m = islands(chunks, ["document_id", "strategy_name"], "start_index", "end_index")
    p = pages.select("document_id", "page_number", F.col("start_index").alias("ps"), F.col("end_index").alias("pe"))
    hit = range_join(m, p, ["document_id"], "start_index", "end_index", "ps", "pe", width)
    part = F.greatest(F.lit(0), F.least("end_index", "pe") - F.greatest("start_index", "ps"))
    c = hit.groupBy("document_id", "strategy_name", "page_number").agg(F.sum(part).alias("covered_tokens"))
    s = chunks.select("strategy_name").distinct().agg(F.collect_set("strategy_name").alias("s")).scalar()
    grid = p.select("*", F.explode(s).alias("strategy_name"))
    j = grid.join(c, ["document_id", "strategy_name", "page_number"], "left").withColumn("covered_tokens", F.coalesce("covered_tokens", F.lit(0)))
    n = F.col("pe") - F.col("ps")
    return j.select("document_id", "strategy_name", "page_number", n.alias("page_tokens"), "covered_tokens",
                    (F.col("covered_tokens") / F.greatest(F.lit(1), n) * 100).alias("coverage_pct"))


def length_metrics(chunks: DataFrame) -> DataFrame:
    """Length distribution per strategy."""
    x = F.col("token_length").cast("double")
    pct = lambda p: F.percentile(x, F.lit(p))
    out = chunks.groupBy("strategy_name").agg(
        F.count("*").alias("chunk_count"), F.min(x).alias("min_tokens"), pct(0.1).alias("p10_tokens"), pct(0.5).alias("median_tokens"), F.avg(x).alias("mean_tokens"),
        pct(0.9).alias("p90_tokens"), pct(0.95).alias("p95_tokens"), F.max(x).alias("max_tokens"), F.stddev_pop(x).alias("std_tokens"),
        (pct(0.75) - pct(0.25)).alias("iqr_tokens"), F.count_if(x < 10).alias("empty_chunks_lt_10"), F.count_if(x < 50).alias("tiny_chunks_lt_50"),
        F.count_if(x < 128).alias("small_chunks_lt_128"), F.count_if((x >= 128) & (x < 512)).alias("medium_chunks_128_to_511"),
        F.count_if((x >= 512) & (x <= 1024)).alias("large_chunks_512_to_1024"), F.count_if(x > 1024).alias("oversized_chunks_gt_1024"))
    return out.withColumn("cv_tokens", F.col("std_tokens") / F.greatest(F.lit(1e-9), F.col("mean_tokens")))


def duplicate_spans(chunks: DataFrame) -> DataFrame:
    g = chunks.groupBy("strategy_name", "document_id", "start_index", "end_index").agg(F.count("*").alias("n"))
    return g.groupBy("strategy_name").agg(F.sum(F.col("n") - 1).alias("duplicate_span_count"))


# ------------------------------------------------------------------ enrichment
def completeness(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Non-null count and share per column: one aggregate, then unpivot."""
    have = [c for c in columns if c in df.columns]
    agg = df.groupBy(group).agg(F.count("*").alias("chunk_count"), *[F.count(c).alias(c) for c in have])
    for c in columns:
        if c not in have:
            agg = agg.withColumn(c, F.lit(0).cast("bigint"))
    long = agg.unpivot([group, "chunk_count"], list(columns), "column", "non_null_count")
    return long.withColumn("present", F.col("column").isin(have)).withColumn("coverage_pct", 100.0 * F.col("non_null_count") / F.greatest(F.lit(1), F.col("chunk_count")))


def flag_prevalence(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    agg = df.groupBy(group).agg(*[(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")) * 100).alias(f) for f in flags])
    return agg.unpivot([group], list(flags), "flag", "true_pct")


def distribution(df: DataFrame, group: str, value: str, default: str = "NO_SECTION") -> DataFrame:
    g = df.groupBy(group, F.coalesce(F.col(value), F.lit(default)).alias("value")).agg(F.count("*").alias("count"))
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(group)))


def flag_consistency(df: DataFrame, group: str, pairs: dict[str, Column]) -> DataFrame:
    """Rows whose flag differs from the expected expression."""
    agg = df.groupBy(group).agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False)) != F.coalesce(e, F.lit(False))).alias(f) for f, e in pairs.items()])
    return agg.unpivot([group], list(pairs), "flag", "mismatches")


def suspicious(df: DataFrame, rules: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()), "; ")
    return df.select(*keep, reasons.alias("reasons")).filter("reasons <> ''")


# -------------------------------------------------------------------- indexing
def index_inventory(strategies: DataFrame, expected: Sequence[str], built: DataFrame) -> DataFrame:
    """One row per (strategy, expected index) with an ``exists`` flag."""
    grid = strategies.select("strategy_name", F.explode(F.array(*[F.lit(e) for e in expected])).alias("index_name"))
    b = built.select("strategy_name", "index_name").distinct().withColumn("exists", F.lit(True))
    return grid.join(b, ["strategy_name", "index_name"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def index_metrics(relations: dict[str, DataFrame], name: str) -> DataFrame:
    """Row count of every relation of one index."""
    out = None
    for rel, df in relations.items():
        r = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("index_name"), F.lit(rel).alias("relation"), "rows")
        out = r if out is None else out.unionByName(r)
    return out


def index_scorecard(inventory: DataFrame, issues: DataFrame) -> DataFrame:
    """.20 exists + .25 files + .25 docs + .30 signal - min(1, .45e + .15w + .03i).
    ``inventory`` carries files_ok, docs_ok and signal in [0, 1]."""
    sev = issues.groupBy("strategy_name", "index_name").pivot("severity", ["error", "warning", "info"]).count().fillna(0)
    j = inventory.join(sev, ["strategy_name", "index_name"], "left").fillna(0, ["error", "warning", "info"])
    pen = F.least(F.lit(1.0), 0.45 * F.col("error") + 0.15 * F.col("warning") + 0.03 * F.col("info"))
    base = 0.20 * F.col("exists").cast("double") + 0.25 * F.col("files_ok") + 0.25 * F.col("docs_ok") + 0.30 * F.col("signal")
    return j.withColumn("health", F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - pen)))


# ------------------------------------------------------------------- retrieval
def retrieval_scores(hits: DataFrame, truth: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """MRR, precision at 1/3/5 (over min(n, hits)) and coverage per list.
    ``hits``: keys + query_id, doc_idx, rank; ``truth``: query_id, doc_idx."""
    h = hits.filter(F.col("rank") <= k).join(truth.select("query_id", "doc_idx").distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_idx"], "left")
    rel = F.col("rel").isNotNull()
    n = F.count("*")
    prec = lambda m: F.count_if(rel & (F.col("rank") <= m)) / F.least(F.lit(m), n)
    return h.groupBy(*keys, "query_id").agg(
        F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias("mrr"), prec(1).alias("precision_at_1"), prec(3).alias("precision_at_3"),
        prec(5).alias("precision_at_5"), F.least(F.lit(1.0), F.countDistinct("doc_idx") / F.lit(k)).alias("coverage_ratio"), n.alias("result_count"))


def keyword_hits(hits: DataFrame, docs: DataFrame, keywords: DataFrame, chars: int | None = None) -> DataFrame:
    """Share of expected keywords (``query_id, keyword``) found in any preview."""
    t = hits.select("query_id", "doc_idx").join(docs.select("doc_idx", F.lower(F.col("text") if chars is None else F.substring("text", 1, chars)).alias("t")), "doc_idx")
    j = keywords.join(t, "query_id", "left").withColumn("hit", F.coalesce(F.contains("t", F.lower("keyword")), F.lit(False)))
    per = j.groupBy("query_id", "keyword").agg(F.bool_or("hit").alias("hit"))
    return per.groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("keyword_hit_rate"))


def summarize(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str], latency: str | None = None) -> DataFrame:
    """Means of the metrics; median and 95th percentile of the latency column."""
    agg = [F.count("*").alias("query_count"), *[F.avg(m).alias(f"mean_{m}") for m in metrics]]
    if latency:
        agg += [F.percentile(latency, F.lit(0.5)).alias("p50"), F.percentile(latency, F.lit(0.95)).alias("p95")]
    return scores.groupBy(*keys).agg(*agg)


def agreement(hits: DataFrame, name: str = "retriever") -> DataFrame:
    """Mean Jaccard of result sets per pair of retrievers.  Lists are cut at k,
    so shared items are counted by one equi-join on (query, item)."""
    n = hits.groupBy("query_id", name).agg(F.countDistinct("doc_idx").alias("n"))
    a = hits.select("query_id", "doc_idx", F.col(name).alias("a")).distinct()
    shared = a.join(a.withColumnRenamed("a", "b"), ["query_id", "doc_idx"]).groupBy("query_id", "a", "b").agg(F.count("*").alias("shared"))
    pairs = n.select("query_id", F.col(name).alias("a"), F.col("n").alias("na")).join(n.select("query_id", F.col(name).alias("b"), F.col("n").alias("nb")), "query_id")
    j = pairs.join(shared, ["query_id", "a", "b"], "left").withColumn("s", F.coalesce("shared", F.lit(0)))
    return j.groupBy("a", "b").agg(F.avg(F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("mean_jaccard"))


# ------------------------------------------------------------------- reranking
def list_diversity(hits: DataFrame, docs: DataFrame, k: int, keys: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Section count and near-duplicate share inside each top-k list."""
    h = hits.filter(F.col("rank") <= k).join(docs.select("doc_idx", "primary_section", tx.distinct_tokens(F.col("text")).alias("t")), "doc_idx")
    g = h.groupBy(*keys, "query_id").agg(F.countDistinct("primary_section").alias("section_diversity"), F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("l"), F.count("*").alias("n"))
    dup = F.aggregate(F.transform("l", lambda x: F.size(F.filter("l", lambda y: (y["rank"] > x["rank"]) & (tx.jaccard(x["t"], y["t"]) >= threshold)))), F.lit(0), lambda s, v: s + v)
    pairs = F.greatest(F.lit(1.0), F.col("n") * (F.col("n") - 1) / 2)
    return g.select(*keys, "query_id", "section_diversity", (dup / pairs).alias("duplicate_text_ratio"))


def rank_movement(reranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank deltas against the original order, Spearman's rho, top changed."""
    d = F.col("original_rank") - F.col("rank")
    n = F.count("*").cast("double")
    return reranked.groupBy(*keys, "query_id").agg(
        F.avg(F.abs(d)).alias("mean_abs_rank_delta"), F.max(F.abs(d)).cast("double").alias("max_abs_rank_delta"), F.count_if(d > 0).alias("promoted_count"),
        F.count_if(d < 0).alias("demoted_count"), F.max(F.when(F.col("rank") == 1, (F.col("original_rank") != 1).cast("int"))).alias("top_result_changed"),
        F.when(n < 2, 0.0).otherwise(1.0 - 6.0 * F.sum(d * d) / F.greatest(F.lit(1.0), n * (n * n - 1))).alias("spearman_rho"))


def baseline_deltas(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "reranker", baseline: str = "baseline") -> DataFrame:
    b = scores.filter(F.col(name) == baseline).select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    j = scores.join(b, list(keys), "left")
    for m in metrics:
        j = j.withColumn(f"delta_{m}", F.coalesce(F.col(m) - F.col(f"_b_{m}"), F.lit(0.0))).drop(f"_b_{m}")
    return j


def rerank_quality(df: DataFrame) -> DataFrame:
    """.35 keywords + .25 MRR + .15 hit + .15 (1 - duplicates) + .10 diversity."""
    q = (0.35 * F.col("keyword_hit_rate") + 0.25 * F.col("mrr") + 0.15 * F.col("hit_at_k") + 0.15 * (1 - F.col("duplicate_text_ratio"))
         + 0.10 * F.least(F.lit(5.0), F.col("section_diversity")) / 5)
    return df.withColumn("quality_score", q)


# ----------------------------------------------------------------------- final
def config_ranking(df: DataFrame) -> DataFrame:
    """Rank configurations: .25 foundation + .65 quality + .10 latency score."""
    latency = 1.0 / (1.0 + F.col("latency_ms") / 100.0)
    s = df.withColumn("latency_score", latency).withColumn(
        "final_score", quantize(0.25 * F.col("foundation") + 0.65 * F.col("quality") + 0.10 * F.col("latency_score")))
    # one row per configuration, a handful in all
    return s.withColumn("config_rank", F.row_number().over(Window.orderBy(F.desc("final_score"), F.asc("name"))))


def component_score(df: DataFrame, weights: dict[str, float], invert: Sequence[str] = ()) -> DataFrame:
    """Weighted min-max scorecard over all rows of a report."""
    d = df.withColumn("_all", F.lit(1))
    total = sum((w * minmax(F.col(c).cast("double"), ["_all"], c in invert) for c, w in weights.items()), F.lit(0.0))
    return d.withColumn("component_score", quantize(total)).drop("_all")
