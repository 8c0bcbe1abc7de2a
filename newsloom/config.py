"""Settings of an engine, and reading them from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Defaults follow the reference behaviour; validated on construction."""

    warehouse: str = "warehouse"
    vector_backend: str = "native"
    graph_backend: str = "native"
    embedding_provider: str = "hash"
    embedding_model: str = ""
    embedding_base_url: str = ""
    embedding_api_key: str = ""
    embedding_dimensions: int = 384
    answer_provider: str = "extractive"
    answer_model: str = ""
    answer_base_url: str = ""
    answer_api_key: str = ""
    answer_timeout_seconds: int = 120
    vector_url: str = ""
    vector_collection: str = "chunks"
    graph_url: str = ""
    graph_user: str = ""
    graph_password: str = ""
    chunk_size: int = 1024
    chunk_overlap: int = 256
    top_k: int = 5
    graph_hops: int = 2

    def __post_init__(self) -> None:
        for name, known in (("vector_backend", ("native", "qdrant")), ("graph_backend", ("native", "neo4j")), ("embedding_provider", ("hash", "openai")), ("answer_provider", ("extractive", "openai"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("0 <= chunk_overlap < chunk_size must hold")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "NEWSLOOM_") -> EngineConfig:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and raw != "":
                found[f.name] = int(raw) if f.type == "int" else raw
        return cls(**found)


def as_bool(raw: str | None, default: bool = False) -> bool:
    return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on")


def load_dotenv(path: str) -> dict[str, str]:
    """Set variables that the process doesn't have; blank lines, comments and lines without = are skipped."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in map(str.strip, lines):
                name, mark, value = line.partition("=")
                if mark and not line.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    for name, value in out.items():
        os.environ.setdefault(name, value)
    return out
