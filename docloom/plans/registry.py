"""Named strategies with the engine's collision rule, and managers over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, indexing, reranking, retrieval, semantic
from docloom.sources.corpus import Corpus
from docloom.sources.io import read_table, write_manifest, write_table

T = TypeVar("T", bound=Callable[..., Any])

# What each relation is clustered on when it is written.
CLUSTER = {"postings": ["term", "phrase", "gram", "field", "date_value", "entity_type", "type_a", "doc_idx"], "buckets": ["bucket"],
           "edges": ["source_doc_idx"], "groups": ["group_key"], "vocab": ["term", "phrase", "gram", "pair"]}


class Registry(Generic[T]):
    """Name -> strategy.  Registering a taken name raises unless ``force``."""

    def __init__(self, kind: str, initial: dict[str, T] | None = None) -> None:
        self.kind = kind
        self._items: dict[str, T] = dict(initial or {})
        self.errors: dict[str, str] = {}

    def register(self, name: str, fn: T, force: bool = False) -> None:
        if name in self._items and not force:
            raise ValueError(f"{self.kind} already registered: {name}")
        self._items[name] = fn

    def names(self) -> list[str]:
        return list(self._items)

    def __getitem__(self, name: str) -> T:
        if name not in self._items:
            raise KeyError(f"unknown {self.kind}: {name}")
        return self._items[name]

    def run_all(self, names: Sequence[str] | None, call: Callable[[str, T], Any], continue_on_error: bool = True) -> dict[str, Any]:
        """Run several strategies; failures are collected in ``errors``."""
        out: dict[str, Any] = {}
        self.errors = {}
        for n in names or self.names():
            try:
                out[n] = call(n, self[n])
            except Exception as e:  # noqa: BLE001
                if not continue_on_error:
                    raise
                self.errors[n] = f"{type(e).__name__}: {e}"
        return out


class ChunkManager(Registry):
    def __init__(self) -> None:
        super().__init__("chunker", chunking.DEFAULT_CHUNKERS)

    def execute(self, name: str, corpus: Corpus, with_pages: bool = True) -> DataFrame:
        out = chunking.finish(self[name](corpus), corpus, name)
        return chunking.page_ranges(out, corpus.pages) if with_pages else out

    def execute_all(self, corpus: Corpus, names: Sequence[str] | None = None, continue_on_error: bool = True) -> DataFrame | None:
        """All strategies as one relation (``strategy_name`` tells them apart)."""
        parts = list(self.run_all(names, lambda n, _: self.execute(n, corpus), continue_on_error).values())
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


class IndexManager(Registry):
    """Builds, stores and reopens index relations under one root folder."""

    def __init__(self, root: str) -> None:
        super().__init__("indexer", indexing.DEFAULT_INDEXERS)
        self.root = root

    def build(self, name: str, strategy: str, docs: DataFrame, **kw: Any) -> indexing.Relations:
        rels = self[name](docs, **kw)
        for rel, df in rels.items():
            keys = [c for c in CLUSTER.get(rel, []) if c in df.columns][:1]
            write_table(df, f"{self.root}/{strategy}/{name}/{rel}", cluster_by=keys or None)
        spark = docs.sparkSession
        opened = {rel: spark.read.parquet(f"{self.root}/{strategy}/{name}/{rel}") for rel in rels}
        counts = {f"{rel}_rows": df.count() for rel, df in opened.items()}
        write_manifest(spark, {"index_name": name, "chunk_strategy_name": strategy, **counts}, f"{self.root}/{strategy}/{name}/manifest")
        return opened

    def build_all(self, strategy: str, docs: DataFrame, names: Sequence[str] | None = None, options: dict[str, dict] | None = None,
                  continue_on_error: bool = True) -> dict[str, indexing.Relations]:
        return self.run_all(names, lambda n, _: self.build(n, strategy, docs, **(options or {}).get(n, {})), continue_on_error)

    def open(self, spark: SparkSession, name: str, strategy: str, relations: Sequence[str]) -> indexing.Relations:
        return {r: read_table(spark, f"{self.root}/{strategy}/{name}/{r}", required=True) for r in relations}


class LexicalSearch(Registry):
    """Registered retrievers over opened indexes of one chunk strategy.

    Each retriever is ``(queries, k, **options) -> ranked hits``."""

    def __init__(self, docs: DataFrame, index: dict[str, indexing.Relations], vectors: DataFrame | None = None,
                 provider: semantic.Provider | None = None) -> None:
        rt, ix = retrieval, index
        direct = {
            "bm25": ("bm25", rt.bm25), "keyword_exact": ("keyword_inverted", rt.keyword_exact), "tfidf": ("tfidf", rt.tfidf),
            "phrase_ngram": ("phrase_ngram", rt.phrase_ngram), "char_ngram": ("char_ngram", rt.char_ngram),
            "fielded_lexical": ("fielded_lexical", rt.fielded_lexical), "boolean_set": ("boolean_set", rt.boolean_set),
            "positional_proximity": ("positional", rt.positional_proximity), "entity": ("entity", rt.entity),
            "section_page": ("section_page", rt.section_page), "temporal": ("temporal", rt.temporal), "layout_spatial": ("layout_spatial", rt.layout_spatial),
        }

        def bound(index_name: str, fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            return lambda q, k=10, **kw: fn(q, ix[index_name], k, **kw)

        items: dict[str, Callable[..., DataFrame]] = {n: bound(i, f) for n, (i, f) in direct.items()}
        boost = lambda q, k=10, filters=None, **kw: rt.metadata_boost(items["bm25"](q, max(5 * k, 50), filters=filters), docs, k, **kw)
        items |= {
            "minhash_duplicates": lambda q, k=10, seeds=None, **kw: rt.duplicates(
                seeds if seeds is not None else items["bm25"](q, 1).select("query_id", "doc_idx"), ix["minhash_lsh"], k, **kw),
            "metadata_filter": lambda q, k=10, filters=None, **kw: rt.filtered_hits(q, docs, filters, k, **kw),
            "bm25_metadata_boost": boost,
            "multi_query_bm25": lambda q, k=10, **kw: rt.multi_query_bm25(q, ix["bm25"], k, **kw),
            "lexical_fusion": lambda q, k=10, **kw: rt.fuse([items[n](q, max(3 * k, 20), **kw) for n in ("bm25", "keyword_exact")], k),
            "advanced_lexical_fusion": lambda q, k=10, **kw: rt.fuse([items[n](q, max(3 * k, 20), **kw) for n in (
                "bm25", "tfidf", "keyword_exact", "fielded_lexical", "phrase_ngram", "char_ngram", "boolean_set", "positional_proximity")], k),
            "mmr_diversity": lambda q, k=10, fetch_k=50, **kw: rt.mmr_diversity(boost(q, max(fetch_k, k), **kw), docs, k),
            "context_expansion": lambda q, k=10, corpus_docs=None, **kw: rt.context_expansion(boost(q, k, **kw), docs, corpus_docs),
            "graph_expansion": lambda q, k=10, base_top_k=None, filters=None, **kw: rt.graph_expansion(
                boost(q, base_top_k or max(k, 10), filters), ix["chunk_graph"], k, filters=filters, **kw),
            "cross_chunk_fusion": lambda q, k=10, others=(), **kw: rt.fuse([boost(q, max(2 * k, 20), **kw), *others], k),
            "query_expansion_bm25": lambda q, k=10, **kw: rt.query_expansion_bm25(q, ix["bm25"], k, **kw),
            "entity_centric_fusion": lambda q, k=10, **kw: rt.entity_centric_fusion(q, ix["bm25"], ix["entity"], k, **kw),
            "numeric_range_retriever": lambda q, k=10, **kw: rt.numeric_range(q, ix["numeric_range"], ix["bm25"], k, **kw),
            "negation_aware_bm25": lambda q, k=10, **kw: rt.negation_aware(items["bm25"](q, 3 * k, **kw), q, docs, k),
            "clinical_section_scoped": lambda q, k=10, filters=None, **kw: rt.section_scoped(items["bm25"](q, 4 * k, filters=filters), docs, k, **kw),
        }
        if vectors is not None and provider is not None:
            items["hyde"] = lambda q, k=10, passages=None, filters=None: semantic.hyde(q, vectors, provider, passages, k)
            items["dense"] = lambda q, k=10, filters=None: semantic.dense(provider(q.select(F.col("query_id").alias("doc_idx"), F.col("query").alias("text"))).select(
                F.col("doc_idx").alias("query_id"), "vector"), vectors, k, docs=docs, filters=filters)
            items["hybrid"] = lambda q, k=10, alpha=0.5, filters=None: semantic.hybrid(
                items["bm25"](q, max(3 * k, 20), filters=filters), items["dense"](q, max(3 * k, 20), filters=filters), k, alpha)
        super().__init__("retriever", items)

    def retrieve(self, name: str, queries: DataFrame, k: int = 10, **kw: Any) -> DataFrame:
        return self[name](queries, k, **kw).withColumn("retriever_name", F.lit(name))

    def retrieve_all(self, queries: DataFrame, k: int = 10, names: Sequence[str] | None = None, continue_on_error: bool = True) -> dict[str, DataFrame]:
        return self.run_all(names, lambda n, _: self.retrieve(n, queries, k), continue_on_error)

    def retrieve_fused(self, names: Sequence[str], queries: DataFrame, k: int = 10, **kw: Any) -> DataFrame:
        return retrieval.fuse([self[n](queries, max(3 * k, 20), **kw) for n in names], k)


class RerankerManager(Registry):
    def __init__(self, docs: DataFrame) -> None:
        super().__init__("reranker", reranking.DEFAULT_RERANKERS)
        self.docs = docs

    def rerank(self, name: str, queries: DataFrame, ranked: DataFrame, k: int | None = None, **kw: Any) -> DataFrame:
        return self[name](reranking.candidates(ranked, queries, self.docs), k, **kw).withColumn("reranker_name", F.lit(name))

    def rerank_chain(self, names: Sequence[str], queries: DataFrame, ranked: DataFrame, k: int | None = None) -> DataFrame:
        return reranking.rerank_chain(names, ranked, queries, self.docs, k, self._items)
