"""Canonical forms that digests are taken of: metadata, vectors, configurations, times."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import PurePosixPath
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of a configuration file that retrieval depends on.
RETRIEVAL_KEYS = [
    "documents.supported_formats", "documents.exclude_patterns", "documents.chunking.chunk_size", "documents.chunking.chunk_overlap",
    "models.embedding.model", "models.embedding.dimensions", "models.embedding.profile", "models.embedding.artifact_path",
    "models.embedding.runtime_version", "models.embedding.pooling", "models.embedding.gpu", "models.embedding.threads",
    "models.reranker.enabled", "models.reranker.model", "models.reranker.top_k_multiplier", "models.reranker.local_artifact",
    "search.default_results", "search.max_results", "search.collection_name", "search.hybrid_alpha", "search.similarity_threshold",
    "search.lexical_fast_path.enabled", "search.lexical_fast_path.min_hits", "search.lexical_fast_path.rerank_enabled", "search.lexical_fast_path.patterns",
    "search.min_score", "search.top_k", "search.fts5_min_hits", "search.fts5_rerank_enabled", "search.fts5_patterns",
    "keyword_routes", "category_mappings", "query_expansions", "query_expansion_groups",
]

# Keys that hold paths, of which the last part counts alone.
PATH_KEYS = ["models.embedding.artifact_path", "models.reranker.local_artifact"]


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{value} has no canonical form")
    if value is None or isinstance(value, (str, int, float)):
        return value
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical(value: Any) -> str:
    """The JSON of a mapping with sorted keys, without blanks; values keep their types and lists their order. What is no mapping is an empty one;
    other types and numbers that are none are errors."""
    return json.dumps(_plain(value) if isinstance(value, dict) else {}, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_json(text: Column | str) -> Column:
    """P18 over a column of JSON texts; null, like anything but an object, is an empty mapping."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([canonical(None if t is None else json.loads(t)) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def packed(vector: Column | str) -> Column:
    """A vector's components as big-endian doubles, side by side; null is empty. Components that are null or no numbers are errors."""

    def run(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = np.array([] if v is None else v, dtype=np.float64)
            if not np.isfinite(x).all():
                raise ValueError("a component that is no number has no canonical form")
            out.append(x.astype(">f8").tobytes())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(vector)


def projected(values: dict[str, Any] | None) -> dict[str, Any]:
    """P20: what retrieval depends on in a configuration file, by dotted key; a key that is not there is null, so removing one is a change. Keys
    beyond the list (secrets, paths, logging) do not enter. The order of lists counts."""
    if not isinstance(values, dict):
        return {}
    out: dict[str, Any] = {}
    for key in RETRIEVAL_KEYS:
        at: Any = values
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        out[key] = PurePosixPath(at.replace("\\", "/")).name if key in PATH_KEYS and isinstance(at, str) else at
    return out


def retrieval_digest(values: dict[str, Any] | None) -> str:
    """P20"""
    return hashlib.sha256(canonical(projected(values)).encode()).hexdigest()


def iso(ts: Column | str) -> Column:
    """A time as YYYY-MM-DDTHH:MM:SS, with six digits of a second where there is a fraction."""
    c = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
