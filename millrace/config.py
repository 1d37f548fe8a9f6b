"""Settings of a run and their checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class PipelineConfig:
    """Every stage reads its settings from here; request-level values are set by ``replace``."""

    quality_threshold: float = 0.7
    similarity_threshold: float = 0.75
    min_chunk_size: int = 200
    max_chunk_size: int = 3000
    max_questions_per_chunk: int = 15
    dedup_threshold: float = 0.92
    #: None: every pair over the threshold; a number is the original pipeline's mode, which loses links.
    dedup_neighbours: int | None = None
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    rrf_k: int = 60
    top_k: int = 5
    enable_multihop: bool = True
    multihop_similarity_min: float = 0.4
    multihop_similarity_max: float = 0.82
    max_multihop_pairs: int = 50
    multihop_questions_per_pair: int = 3
    enable_knowledge_graph: bool = True
    enable_advanced_metrics: bool = True
    metric_sample_share: float = 0.3
    noise_sample_rate: float = 0.1
    enable_personas: bool = True
    active_personas: tuple[str, ...] = ()
    active_styles: tuple[str, ...] = ()
    active_lengths: tuple[str, ...] = ()
    max_concurrent_calls: int = 5
    max_upload_size_mb: float = 50

    def __post_init__(self):
        for name in ("quality_threshold", "similarity_threshold", "dedup_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.max_concurrent_calls < 1:
            raise ValueError("max_concurrent_calls must be at least 1")
        if self.dense_weight < 0 or self.sparse_weight < 0:
            raise ValueError("weights must not be negative")

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, values: dict) -> PipelineConfig:
        """From a mapping; unknown names are an error, so that no toggle is silently ignored."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)
