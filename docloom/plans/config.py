"""Settings: dataclasses, JSON round trip, environment overrides, presets."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields


@dataclass
class EmbeddingConfig:
    provider: str = "local"
    model_name: str = "hashing-64"
    dimension: int = 64
    batch_size: int = 32


@dataclass
class VectorConfig:
    metric: str = "ip"
    query_block: int = 2048


@dataclass
class RetrievalConfig:
    retrievers: list[str] = field(default_factory=lambda: ["bm25", "advanced_lexical_fusion"])
    reranker: str = "hybrid_weighted"
    top_k: int = 10
    chunk_strategy: str = "block_group_800_overlap_1"


@dataclass
class GenerationConfig:
    provider: str = "none"
    model_name: str = ""
    max_context_tokens: int = 6000
    context_ordering: str = "score"
    timeout_seconds: int = 120


@dataclass
class EngineConfig:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    vector: VectorConfig = field(default_factory=VectorConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        raw = json.loads(text)
        parts = {f.name: f.default_factory for f in fields(cls)}
        return cls(**{n: make(**raw.get(n, {})) for n, make in parts.items()})

    def with_env(self, env: dict[str, str] | None = None, prefix: str = "DOCLOOM_") -> EngineConfig:
        """``DOCLOOM_RETRIEVAL_TOP_K=20`` style overrides; types follow the field."""
        env = dict(os.environ) if env is None else env
        for part in fields(self):
            section = getattr(self, part.name)
            for f in fields(section):
                v = env.get(f"{prefix}{part.name}_{f.name}".upper())
                if v is not None:
                    cur = getattr(section, f.name)
                    setattr(section, f.name, v.split(",") if isinstance(cur, list) else type(cur)(v))
        return self


PRESETS = {
    "fast": lambda: EngineConfig(retrieval=RetrievalConfig(["bm25"], "score_passthrough", 5)),
    "balanced": EngineConfig,
    "precise": lambda: EngineConfig(retrieval=RetrievalConfig(["advanced_lexical_fusion", "clinical_section_scoped"], "hybrid_weighted", 15), generation=GenerationConfig(timeout_seconds=180)),
    "semantic": lambda: EngineConfig(retrieval=RetrievalConfig(["hybrid"], "diversity_mmr", 10)),
    "full_document": lambda: EngineConfig(generation=GenerationConfig(max_context_tokens=100_000, context_ordering="page")),
}


def preset(name: str) -> EngineConfig:
    if name not in PRESETS:
        raise KeyError(f"unknown preset: {name}")
    return PRESETS[name]()
