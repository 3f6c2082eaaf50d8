"""Settings of the retrieval and indexing operators; every default can be replaced per call."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of search, selection, chunking and answering."""

    rrf_k: int = 60
    leg_limit: int = 50
    fused_limit: int = 50
    rerank_candidates: int = 50
    rerank_top_k: int = 8
    max_context_chunks: int = 6
    rerank_min_score: float = 0.15
    fallback: int = 3
    relative_floor: float = 0.0
    recency_weight: float = 0.0
    recency_days: int = 365
    diversity: float = 0.6
    neighbour_radius: int = 1
    chunk_size: int = 448
    chunk_overlap: int = 100
    min_section_words: int = 40
    rows_per_section: int = 50
    chunker_version: int = 9
    bm25_k1: float = 1.2
    bm25_b: float = 0.75

    @property
    def rerank_limit(self) -> int:
        """Fused rows that are reranked."""
        return min(self.rerank_candidates, self.fused_limit)


DEFAULT = Settings()

#: What decides a document's passages, besides the embedding model, by the names that are written down.
CHUNKING = {"chunker_version": "chunker_version", "chunk_size_tokens": "chunk_size", "chunk_overlap_tokens": "chunk_overlap", "min_section_words": "min_section_words", "csv_rows_per_section": "rows_per_section"}


def chunking(settings: Settings, model: str) -> dict[str, int | str]:
    """What decides a document's passages, by name."""
    return {name: getattr(settings, field) for name, field in CHUNKING.items()} | {"dense_embedding_model": model}


def fingerprint(decided_by: dict) -> str:
    """A short digest of settings: of their JSON text, names in order."""
    return hashlib.sha256(json.dumps(decided_by, sort_keys=True).encode()).hexdigest()[:12]


def measured_with(settings: Settings, arm: str, **more: object) -> dict[str, object]:
    """What a run was measured with, to say later what changed: all settings, the arm, and whatever models it used."""
    return {**asdict(settings), **more, "arm": arm}
