"""Configuration: typed values with defaults, validation and clamping, presets, merged synonyms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from typing import Any

from .functions.text import LEXICAL_PATTERNS

# Embedding profiles as model, dimension, query and passage prefix.
PROFILES = {
    "compact": ("BAAI/bge-small-en-v1.5", 384, "", ""),
    "quality": ("BAAI/bge-large-en-v1.5", 1024, "", ""),
    "multilingual": ("intfloat/multilingual-e5-large", 1024, "query: ", "passage: "),
}

# Categories by pattern of the path.
CATEGORIES = {
    "security/redteam": "redteam",
    "security/blueteam": "blueteam",
    "security/ctf": "ctf",
    "security": "security",
    "aar": "aar",
    "logscale": "logscale",
    "development": "development",
    "general": "general",
}

#: Where the values lie in a YAML file.
PLACES = {
    "chunk_size": ("documents", "chunking", "chunk_size"),
    "chunk_overlap": ("documents", "chunking", "chunk_overlap"),
    "batch_size": ("documents", "batch_size"),
    "buckets": ("documents", "buckets"),
    "exclude": ("documents", "exclude_patterns"),
    "max_results": ("search", "max_results"),
    "default_results": ("search", "default_results"),
    "lexical_enabled": ("search", "lexical_fast_path", "enabled"),
    "min_hits": ("search", "lexical_fast_path", "min_hits"),
    "patterns": ("search", "lexical_fast_path", "patterns"),
    "profile": ("models", "embedding", "profile"),
    "embedding_model": ("models", "embedding", "model"),
    "embedding_dim": ("models", "embedding", "dimensions"),
    "query_prefix": ("models", "embedding", "query_prefix"),
    "passage_prefix": ("models", "embedding", "passage_prefix"),
    "rerank_multiplier": ("models", "reranker", "top_k_multiplier"),
}


def merged_synonyms(expansions: dict[str, Iterable[str]], groups: Iterable[Iterable[str]] = ()) -> dict[str, list[str]]:
    """U4: every member of a group expands to the others; lists are joined in first-seen order, in lower case."""
    out: dict[str, list[str]] = {}

    def add(term: str, others: Iterable[str]) -> None:
        mine = out.setdefault(term.lower().strip(), [])
        mine += [o for o in dict.fromkeys(x.strip() for x in others) if o and o not in mine]

    for term, others in expansions.items():
        add(term, others)
    for group in groups:
        members = [m.lower().strip() for m in group if m.strip()]
        for m in members:
            add(m, [o for o in members if o != m])
    return out


def flattened(values: dict[str, Any]) -> dict[str, Any]:
    """The values of a nested file under the names of Config's fields; top-level keys stay as they are."""
    out = {k: v for k, v in values.items() if k not in ("documents", "search", "models")}
    for name, place in PLACES.items():
        at: Any = values
        for key in place:
            at = at.get(key) if isinstance(at, dict) else None
        if at is not None:
            out[name] = at
    if "embedding_model" in out and "profile" not in out:
        out["profile"] = "custom"
    return out


@dataclass
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    batch_size: int = 500
    #: Buckets that tables lie in; an update writes those of its sources.
    buckets: int = 64
    max_results: int = 100
    default_results: int = 5
    hybrid_alpha: float = 0.3
    mmr_lambda: float = 0.7
    rerank_multiplier: int = 3
    lexical_enabled: bool = False
    min_hits: int = 3
    patterns: list[str] = field(default_factory=lambda: list(LEXICAL_PATTERNS))
    profile: str = "compact"
    embedding_model: str = ""
    embedding_dim: int = 0
    query_prefix: str = ""
    passage_prefix: str = ""
    exclude: list[str] = field(default_factory=list)
    category_mappings: dict[str, str] = field(default_factory=lambda: dict(CATEGORIES))
    keyword_routes: dict[str, list[str]] = field(default_factory=dict)
    query_expansions: dict[str, list[str]] = field(default_factory=dict)
    query_expansion_groups: list[list[str]] = field(default_factory=list)

    def __post_init__(self):
        import re

        if self.profile != "custom":
            if self.profile not in PROFILES:
                raise ValueError(f"unknown embedding profile: {self.profile}")
            model, dim, query, passage = PROFILES[self.profile]
            self.embedding_model, self.embedding_dim = self.embedding_model or model, self.embedding_dim or dim
            self.query_prefix, self.passage_prefix = self.query_prefix or query, self.passage_prefix or passage
        elif not self.embedding_model or self.embedding_dim < 1:
            raise ValueError("a custom profile needs a model and a dimension")
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk")
        self.batch_size = min(5000, max(1, self.batch_size))
        self.buckets = min(1 << 16, max(1, self.buckets))
        self.max_results = max(1, self.max_results)
        self.hybrid_alpha, self.mmr_lambda = (min(1.0, max(0.0, x)) for x in (self.hybrid_alpha, self.mmr_lambda))
        for p in self.patterns:
            re.compile(p)

    @classmethod
    def of(cls, values: dict[str, Any] | None) -> Config:
        """Known keys of the right type; a value of a wrong type leaves the default."""
        default, given = cls(), {}
        for f in fields(cls):
            if values and f.name in values:
                value, kind = values[f.name], type(getattr(default, f.name))
                if kind is float and isinstance(value, int) and not isinstance(value, bool):
                    value = float(value)
                if isinstance(value, kind) and (kind is bool) == isinstance(value, bool):
                    given[f.name] = value
        return cls(**given)

    @classmethod
    def read(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            values = yaml.safe_load(f)
        return cls.of(flattened(values) if isinstance(values, dict) else None)

    @property
    def synonyms(self) -> dict[str, list[str]]:
        return merged_synonyms(self.query_expansions, self.query_expansion_groups)

    def results(self, k: int | None) -> int:
        """F5"""
        return min(self.max_results, max(1, self.default_results if k is None else k))


# Categories of two presets by pattern of the path.
DEVELOPER = {
    "architecture": "architecture",
    "api": "api",
    "runbooks": "runbooks",
    "backend": "backend",
    "frontend": "frontend",
    "infrastructure": "infra",
    "database": "database",
    "testing": "testing",
    "notes": "notes",
}
RESEARCH = {
    "papers": "papers",
    "books": "books",
    "notes/lectures": "lectures",
    "notes/reading": "reading",
    "notes": "notes",
    "thesis": "thesis",
    "experiments": "experiments",
    "datasets": "datasets",
    "writing": "writing",
}

# Presets. Only what differs from the defaults; routes and synonyms come with the user's file.
PRESETS: dict[str, dict[str, Any]] = {
    "general": {"max_results": 20, "category_mappings": {}},
    "cybersecurity": {"max_results": 20},
    "developer": {"max_results": 20, "chunk_size": 1200, "chunk_overlap": 250, "category_mappings": DEVELOPER},
    "research": {"max_results": 20, "chunk_size": 1500, "chunk_overlap": 300, "category_mappings": RESEARCH},
    "multilingual": {"max_results": 20, "profile": "multilingual", "category_mappings": {}},
}
