"""Settings of a workspace, read from TOML. No file gives the defaults, and so does one that can't be read or has a value of the wrong kind, with a warning."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

MOST_HOPS, MOST_DEPTH = 6, 3
#: Where each setting stands in the file.
PLACES = {
    "score_threshold": ("query", "score_threshold"),
    "score_gap": ("query", "score_gap"),
    "jaccard_threshold": ("query", "jaccard_threshold"),
    "exact_cache_ttl_secs": ("query", "exact_cache_ttl_secs"),
    "causal_max_hops": ("query", "causal_max_hops"),
    "answers": ("query", "tier3_enabled"),
    "answer_top": ("query", "tier3_top_n"),
    "answer_threshold": ("query", "tier3_score_threshold"),
    "classify": ("compile", "classify"),
    "max_tokens_per_compile": ("compile", "max_tokens_per_compile"),
    "tracking": ("access_tracking", "enabled"),
    "importance_delta": ("access_tracking", "importance_delta"),
    "access_log": ("access_tracking", "access_log"),
    "ontology": ("ontology", "file"),
    "expansion_depth": ("ontology", "expansion_depth"),
    "max_log_bytes": ("audit", "max_log_bytes"),
    "siem_endpoint": ("audit", "siem_endpoint"),
    "siem_token_env": ("audit", "siem_token_env"),
    "siem_required": ("audit", "siem_required"),
}


@dataclass(frozen=True)
class Config:
    score_threshold: float = 0.85
    score_gap: float = 0.10
    jaccard_threshold: float = 0.60
    exact_cache_ttl_secs: int = 60
    causal_max_hops: int = 3
    answers: bool = False
    answer_top: int = 5
    answer_threshold: float = 0.75
    classify: bool = False
    max_tokens_per_compile: int = 10_000
    tracking: bool = True
    importance_delta: float = 0.001
    access_log: str | None = None
    ontology: str | None = None
    expansion_depth: int = 1
    max_log_bytes: int = 50 << 20
    siem_endpoint: str | None = None
    siem_token_env: str | None = None
    siem_required: bool = False

    def __post_init__(self):
        object.__setattr__(self, "causal_max_hops", min(self.causal_max_hops, MOST_HOPS))
        object.__setattr__(self, "expansion_depth", min(self.expansion_depth, MOST_DEPTH))


def load(path: str | Path | None) -> Config:
    if path is None or not Path(path).exists():
        return Config()
    try:
        found = tomllib.loads(Path(path).read_text())
        values = {}
        for field in fields(Config):
            section, key = PLACES[field.name]
            value = found.get(section, {}).get(key)
            if value is None:
                continue
            kind = str(field.type).split(" ")[0]
            fits = {"float": (int, float), "int": int, "bool": bool, "str": str}[kind]
            if not isinstance(value, fits) or isinstance(value, bool) != (kind == "bool") or kind == "int" and value < 0:
                raise ValueError(f"{section}.{key}: {value!r}")
            values[field.name] = float(value) if kind == "float" else value
        return Config(**values)
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError, ValueError, AttributeError) as error:
        warnings.warn(f"{path}: {error}; the defaults are used", stacklevel=2)
        return Config()
