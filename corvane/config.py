"""Settings: closed option sets, defaults, validation and the environment reader."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace

from corvane.errors import ConfigurationError

# Option sets and defaults.
RUNTIMES = ("basic", "agents_sdk")
CHUNK_STRATEGIES = ("fixed", "paragraph", "markdown")
BACKENDS = ("local", "qdrant")
RETRIEVAL_STRATEGIES = ("blended", "dense", "lexical", "hybrid_rrf")
RERANKERS = ("none", "llm")
MATRIX_CAP = 128
QUESTION_LENGTHS = (1, 4000)


def check_chunk_sizes(size: int, overlap: int) -> None:
    """Sizes must be positive and the overlap smaller than the size."""
    if size <= 0:
        raise ConfigurationError("chunk size must be greater than zero")
    if overlap < 0:
        raise ConfigurationError("chunk overlap must not be negative")
    if overlap >= size:
        raise ConfigurationError("chunk overlap must be smaller than chunk size")


def chosen(value: str | None, options: tuple[str, ...], default: str, what: str) -> str:
    """``value`` without outer space and in lower case; blank gives the default."""
    name = (value or "").strip().lower()
    if not name:
        return default
    if name not in options:
        raise ConfigurationError(f"{what} must be one of {', '.join(options)}, not {name!r}")
    return name


def check_question(text: str) -> str:
    """The trimmed question; empty or overlong ones are refused."""
    trimmed = text.strip()
    low, high = QUESTION_LENGTHS
    if not low <= len(trimmed) <= high:
        raise ConfigurationError(f"a question has {low} to {high} characters")
    return trimmed


@dataclass(frozen=True)
class RetrievalSettings:
    """How to rank: strategy, candidate window and the constant of rank fusion."""

    strategy: str = "blended"
    candidate_k: int = 20
    rrf_k: int = 60

    def window(self, top_k: int) -> int:
        """Candidates that a fused strategy looks at."""
        return max(self.candidate_k, top_k)

    @property
    def needs_window(self) -> bool:
        """Whether a store must return more than ``top_k`` candidates."""
        return self.strategy in ("lexical", "hybrid_rrf")


@dataclass(frozen=True)
class Settings:
    """All settings of one engine."""

    docs_dir: str = "data/corpus"
    exclude: tuple[str, ...] = ()
    index_path: str = "data/index"
    manifest_path: str = "data/index-manifest.json"
    eval_path: str = "data/evals/eval.jsonl"
    runtime: str = "basic"
    backend: str = "local"
    chunk_strategy: str = "markdown"
    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 4
    retrieval_strategy: str = "blended"
    candidate_k: int = 20
    rrf_k: int = 60
    reranker: str = "none"
    rerank_candidate_k: int = 20
    embedding_model: str = ""
    embedding_key: str = ""
    embedding_batch: int = 10
    embedding_retries: int = 2
    embedding_backoff_ms: int = 800
    chat_model: str = ""
    chat_key: str = ""
    chat_provider: str = ""
    embedding_provider: str = ""
    rerank_provider: str = ""
    agent_max_turns: int = 6

    def __post_init__(self) -> None:
        for name, options in (("runtime", RUNTIMES), ("backend", BACKENDS), ("chunk_strategy", CHUNK_STRATEGIES), ("retrieval_strategy", RETRIEVAL_STRATEGIES), ("reranker", RERANKERS)):
            if getattr(self, name) not in options:
                raise ConfigurationError(f"{name} must be one of {', '.join(options)}")
        check_chunk_sizes(self.chunk_size, self.chunk_overlap)
        for name in ("top_k", "candidate_k", "rrf_k", "rerank_candidate_k", "embedding_batch", "agent_max_turns"):
            if getattr(self, name) < 1:
                raise ConfigurationError(f"{name} must be at least 1")
        for name in ("embedding_retries", "embedding_backoff_ms"):
            if getattr(self, name) < 0:
                raise ConfigurationError(f"{name} must not be negative")

    @property
    def retrieval(self) -> RetrievalSettings:
        return RetrievalSettings(self.retrieval_strategy, self.candidate_k, self.rrf_k)

    def with_(self, **changes) -> Settings:
        """A copy with some settings changed, validated again."""
        return replace(self, **changes)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CORVANE_") -> Settings:
        """Settings from variables such as ``CORVANE_TOP_K``; blank ones keep their default."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            if not raw:
                continue
            default = f.default
            if isinstance(default, int):
                found[f.name] = read_int(raw, f.name)
            elif isinstance(default, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                found[f.name] = raw.lower() if f.name in ("runtime", "backend", "chunk_strategy", "retrieval_strategy", "reranker") else raw
        return cls(**found)


def read_int(raw: str, name: str) -> int:
    try:
        return int(raw)
    except ValueError:
        raise ConfigurationError(f"{name} must be an integer, not {raw!r}") from None


def digest(payload: dict) -> str:
    """SHA-256 of a payload as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def index_fingerprint(settings: Settings, mode: str) -> str:
    """Identity of what is in an index; ranking settings do not count."""
    return digest(
        {
            "docs_dir": settings.docs_dir,
            "exclude": sorted(set(settings.exclude)),
            "backend": settings.backend,
            "embedding_model": settings.embedding_model,
            "embedding_mode": mode,
            "chunk_strategy": settings.chunk_strategy,
            "chunk_size": settings.chunk_size,
            "chunk_overlap": settings.chunk_overlap,
        }
    )


def storage_identity(settings: Settings) -> str:
    """Identity of the place an index is kept in."""
    return digest({"backend": settings.backend, "path": os.path.abspath(settings.index_path)})


def as_payload(settings: Settings) -> dict:
    """Settings without secrets, for reports."""
    return {k: v for k, v in asdict(settings).items() if not k.endswith("_key")}
