"""Settings with their ranges; code defaults win over nothing, explicit values over defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ChunkConfig:
    """Token sizes of chunks, the overlap share, and windows of the semantic refinement."""

    target: int = 200
    least: int = 100
    most: int = 256
    overlap: float = 0.18
    window: int = 150
    step: int = 30
    z: float = 2.5

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("0 < least <= target <= most does not hold")
        if not 0 <= self.overlap < 1:
            raise ValueError("overlap must be in [0, 1)")
        if not 0 < self.step <= self.window:
            raise ValueError("0 < step <= window does not hold")


@dataclass(frozen=True)
class SearchConfig:
    """Share of the semantic score, the staged limits as multiples of k, and the diversity limits."""

    alpha: float = 0.7
    per_collection: int = 3
    candidates: int = 4
    reranked: int = 2
    max_cosine: float = 0.9
    page_distance: int = 2
    max_query_chars: int = 512

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be in [0, 1]")
        if not self.per_collection >= 1 or not self.candidates >= self.reranked >= 1:
            raise ValueError("candidates >= reranked >= 1 does not hold")
        if not 0 < self.max_cosine <= 1:
            raise ValueError("max_cosine must be in (0, 1]")


def from_mapping(kind, values: dict):
    """A config from a mapping (parsed JSON or YAML); unknown names are an error."""
    names = {f.name for f in fields(kind)}
    if unknown := set(values) - names:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)
