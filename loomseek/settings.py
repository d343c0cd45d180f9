"""Settings that change answers, as one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # The defaults of the retrieval engine.
    rrf_k: int = 60
    dense_width: int = 100
    sparse_width: int = 100
    structural_width: int = 50
    fusion_top_n: int = 25
    top_k: int = 10
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    eval_k1: float = 1.5
    eval_b: float = 0.75
    sufficiency_top1: float = 0.35
    sufficiency_floor: float = 0.20
    sufficiency_min: int = 3
    dedupe_cosine: float = 0.95
    stability_bonus: float = 0.10
    max_expansions: int = 12
    max_expansions_refined: int = 24
    max_sub_queries: int = 3
    weights: dict = field(
        default_factory=lambda: {
            "semantic": {"dense": 0.60, "sparse": 0.30, "structural": 0.10},
            "structural": {"dense": 0.20, "sparse": 0.20, "structural": 0.60},
            "usage": {"dense": 0.25, "sparse": 0.55, "structural": 0.20},
            "hybrid": {"dense": 0.34, "sparse": 0.33, "structural": 0.33},
        }
    )
    eval_weights: dict = field(default_factory=lambda: {"dense": 0.85, "sparse": 0.15})


DEFAULT = Settings()
