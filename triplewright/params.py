"""Engine parameters with the defaults of the pipeline, clamped where a bound is given."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    keyword: str = "requirement"
    limit: int = 50
    top_k: int = 5
    threshold: float = 0.55
    gate_paragraph: float = 0.45
    gate_keywords: float = 0.65
    keywords_per_paragraph: int = 8
    synonyms: int = 10
    batch_size: int = 5
    qualities_per_chunk: int = 12
    novelty_neighbors: int = 3
    chunk_size: int = 700
    chunk_overlap: int = 70

    def __post_init__(self) -> None:
        for name in ("limit", "top_k", "batch_size"):
            object.__setattr__(self, name, max(1, getattr(self, name)))
