"""Query to answer: expand, retrieve, rerank, assemble, generate, evaluate.

Everything but text generation is one lazy plan over a batch of queries; the
generator is a pluggable ``(query_id, query, formatted_text) -> (query_id,
answer)`` transform (for instance a ``mapInPandas`` over an API client)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import generation as gen
from docloom.operators import query_understanding as qu
from docloom.operators import retrieval as rt
from docloom.plans.config import EngineConfig
from docloom.plans.registry import LexicalSearch, RerankerManager

Generator = Callable[[DataFrame], DataFrame]


@dataclass
class Answers:
    hits: DataFrame
    context: DataFrame
    answers: DataFrame
    citations: DataFrame
    metrics: DataFrame


def extractive_answer(prompts: DataFrame) -> DataFrame:
    """Offline generator: first sentence of the first context chunk, cited."""
    from docloom.functions import text as tx

    first = F.get(tx.sentences(F.regexp_replace("formatted_text", "^\u2500+\n[^\n]*\n\u2500+\n", "")), F.lit(0))
    return prompts.select("query_id", F.concat(first, F.lit(" [1]")).alias("answer"))


def retrieve(queries: DataFrame, search: LexicalSearch, cfg: EngineConfig) -> DataFrame:
    """Retrievers × query variants, best raw score per unit, top 2k."""
    k = cfg.retrieval.top_k
    variants = qu.expand(queries)
    key = F.col("query_id") * 8 + F.col("variant")
    flat = variants.select(key.cast("bigint").alias("query_id"), "query")
    runs = [search[n](flat, k).withColumn("query_id", F.floor(F.col("query_id") / 8).cast("bigint")) for n in cfg.retrieval.retrievers]
    return rt.union_max(runs, k)


def answer(queries: DataFrame, docs: DataFrame, search: LexicalSearch, cfg: EngineConfig, generate: Generator = extractive_answer) -> Answers:
    hits = retrieve(queries, search, cfg)
    best = RerankerManager(docs).rerank(cfg.retrieval.reranker, queries, hits, cfg.retrieval.top_k)
    rows = best.join(docs, "doc_idx").select("query_id", F.col("doc_idx").alias("chunk_id"), F.col("rerank_score").alias("score"), F.coalesce("page_start", F.lit(0)).alias("page_start"), "text")
    context = gen.assemble(rows, cfg.generation.max_context_tokens, cfg.generation.context_ordering)
    prompts = queries.join(gen.format_context(context), "query_id")
    ans = prompts.select("query_id", "query").join(generate(prompts), "query_id")
    return Answers(best, context, ans, gen.resolve_citations(ans, context), gen.answer_metrics(ans, context))


def full_document_context(chunks: DataFrame, budget: int) -> DataFrame:
    """All chunks of a document in page order under the token budget."""
    return gen.assemble(chunks, budget, "page")
