"""Settings from the environment, checked at once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


def _setting(default, low=None, high=None, choices=None):
    from dataclasses import field

    return field(default=default, metadata={"low": low, "high": high, "choices": choices})


@dataclass(frozen=True)
class Config:
    """Field names in upper case, after PREFIX, are the environment's. Ranges hold for what is loaded."""

    provider: str = _setting("groq", choices=("groq", "ollama", "extractive"))
    retrieval_mode: str = _setting("dense", choices=("dense", "hybrid", "lexical"))
    chunk_size_chars: int = _setting(1800, 400, 8000)
    chunk_overlap_chars: int = _setting(220, 0, 2000)
    similarity_threshold: float = _setting(0.40, 0, 1)
    top_k: int = _setting(4, 1, 12)
    candidate_multiplier: int = _setting(3, 1, 10)
    hybrid_dense_weight: float = _setting(0.60, 0, 1)
    rerank_weight: float = _setting(0.20, 0, 1)
    rrf_k: int = _setting(60, 1, 500)
    lexical_candidate_limit: int = _setting(40, 5, 500)
    max_file_mb: int = _setting(5, 1, 25)
    max_files: int = _setting(5, 1, 20)
    max_pages: int = _setting(200, 1, 1000)
    max_session_chunks: int = _setting(1500, 10, 10_000)
    max_context_chars: int = _setting(16_000, 2000, 100_000)
    request_timeout_seconds: int = _setting(60, 5, 300)
    input_cost_per_million_usd: float = _setting(0.0, 0, 1000)
    output_cost_per_million_usd: float = _setting(0.0, 0, 1000)
    api_key: str = _setting("")
    model: str = _setting("")

    @property
    def provider_ready(self) -> bool:
        return self.provider != "groq" or bool(self.api_key)


PREFIX = "ASSAYER_"


def load_config(env: Mapping[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    values = {}
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper(), "").strip()
        if not raw:
            continue
        kind = type(f.default)
        try:
            value = raw.lower() if f.metadata["choices"] else kind(raw)
        except ValueError as e:
            raise ValueError(f"{f.name} must be a {kind.__name__}: {raw}") from e
        low, high, choices = (f.metadata[k] for k in ("low", "high", "choices"))
        if choices and value not in choices:
            raise ValueError(f"{f.name} must be one of {', '.join(choices)}")
        if low is not None and not low <= value <= high:
            raise ValueError(f"{f.name} must be from {low} to {high}")
        values[f.name] = value
    out = Config(**values)
    if out.chunk_overlap_chars >= out.chunk_size_chars:
        raise ValueError("chunk_overlap_chars must be under chunk_size_chars")
    return out
