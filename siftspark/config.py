"""Settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    segment_max_bytes: int = 4 * 1024 * 1024
    segment_max_rows: int = 1000
    segment_max_idle_s: float = 30.0
    hnsw_m: int = 16
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 64
    patch_grid: int = 3
    budget_cny: float = 10.0
    upload_max_bytes: int = 10 * 1024 * 1024
    upload_max_pixels: int = 25_000_000
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    chunk_size: int = 480
    chunk_overlap: int = 80
    pool_least: int = 32
    pool_factor: int = 4
    top_k: int = 12
    top_k_most: int = 200
    rag_top_k: int = 6
    dim: int = 1024

    def __post_init__(self):
        if self.segment_max_bytes < 1024:
            raise ValueError("segment_max_bytes must be at least 1024")
        if self.hnsw_m < 4:
            raise ValueError("hnsw_m must be at least 4")
        if not 2 <= self.patch_grid <= 8:
            raise ValueError("patch_grid must be 2 to 8")

    @classmethod
    def from_env(cls, prefix: str = "SIFTSPARK_") -> EngineConfig:
        """Settings from the environment; a malformed number is an error."""
        given = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                given[f.name] = type(f.default)(raw)
        return cls(**given)
