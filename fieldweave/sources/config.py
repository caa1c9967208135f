"""Run settings: a frozen dataclass read from YAML, changed only by making another."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from typing import Any

import yaml


@dataclass(frozen=True)
class Similarity:
    char_weight: float = 0.4
    semantic_weight: float = 0.5
    struct_weight: float = 0.1
    pinyin_boost: float = 1.5

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.char_weight, self.semantic_weight, self.struct_weight


@dataclass(frozen=True)
class Thresholds:
    similarity_threshold: float = 0.5
    confidence_threshold: float = 0.7
    high_confidence: float = 0.8
    medium_confidence: float = 0.6
    low_confidence: float = 0.4


@dataclass(frozen=True)
class Chinese:
    enable_pinyin: bool = True
    enable_abbreviation: bool = True


@dataclass(frozen=True)
class Strategy:
    enable_aggressive_mode: bool = True
    include_potential_matches: bool = True


@dataclass(frozen=True)
class System:
    batch_size: int = 5
    cache_enabled: bool = True


@dataclass(frozen=True)
class Endpoint:
    api_key: str = field(default="", repr=False)
    api_base_url: str = ""
    model: str = ""
    temperature: float = 0.1
    max_tokens: int = 1000
    timeout_s: float = 60.0


@dataclass(frozen=True)
class Config:
    similarity: Similarity = Similarity()
    thresholds: Thresholds = Thresholds()
    chinese: Chinese = Chinese()
    matching_strategy: Strategy = Strategy()
    system: System = System()
    openai: Endpoint = Endpoint()

    def with_thresholds(self, **values: float) -> Config:
        return replace(self, thresholds=replace(self.thresholds, **values))


def from_dict(raw: dict[str, Any] | None) -> Config:
    """Sections and keys that are missing keep their defaults; unknown ones are refused."""
    sections = {f.name: f.default for f in fields(Config)}
    out = {}
    for name, values in (raw or {}).items():
        if name not in sections:
            raise ValueError(f"no section {name!r}")
        known = {f.name for f in fields(sections[name])}
        if extra := set(values or {}) - known:
            raise ValueError(f"no setting {name}.{sorted(extra)[0]}")
        out[name] = replace(sections[name], **(values or {}))
    return Config(**out)


def load(path: str | None = None, places: tuple[str, ...] = ("config/config.yaml", "config.yaml")) -> Config:
    """The file at ``path``, or the first of ``places`` that exists, or the defaults."""
    if path and not os.path.exists(path):
        raise FileNotFoundError(path)
    found = path or next((p for p in places if os.path.exists(p)), None)
    if not found:
        return Config()
    with open(found, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f))


def require_files(*paths: str) -> None:
    """Pre-flight check of a run's inputs."""
    if missing := [p for p in paths if not os.path.exists(p)]:
        raise FileNotFoundError(", ".join(missing))
