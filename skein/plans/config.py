"""Configuration: layers of mappings, merged, into checked dataclasses. Unknown names are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Split:
    size: int = 1200
    overlap: int = 120
    least: int = 200

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.size or self.least > self.size:
            raise ValueError("split: 0 < overlap < size and least <= size are needed")


@dataclass(frozen=True)
class Ingest:
    encoding: str = "auto"
    chapter_regex: str = r"^第[0-9一二三四五六七八九十百千]+章.*$"
    fallback_chars: int = 20_000
    compact: bool = True
    nfkc: bool = False
    split: Split = field(default_factory=Split)


@dataclass(frozen=True)
class Narration:
    tiering: bool = True
    tier: str = "medium"
    tiers: dict[str, dict[str, Any]] = field(default_factory=dict)
    long_every_n: int = 0
    long_min_chars: int = 0
    long_keywords: tuple[str, ...] = ()
    ratio_low: float = 0.2
    ratio_high: float = 0.3
    memory_top_k: int = 8
    step_size: int = 1
    step_memory: str = "per_chapter"
    recent_window: int = 5
    evidence_least: float = 0.18
    evidence_snippets: int = 4
    in_order: bool = False
    checkpoint_every: int = 1

    def __post_init__(self) -> None:
        if not 0 < self.ratio_low < self.ratio_high < 1:
            raise ValueError("narration: 0 < ratio_low < ratio_high < 1 is needed")
        if self.step_memory not in ("per_chapter", "per_step_shared", "off") or self.step_size < 1:
            raise ValueError("narration: unknown step_memory or step_size below 1")


@dataclass(frozen=True)
class Summary:
    """Characters that a prompt of a level may hold; an optional last level tells the story."""

    most_chars: int = 12_000
    story: bool = True


@dataclass(frozen=True)
class Providers:
    """Who answers prompts and makes vectors (functions.providers.provider), and seconds that stored answers hold (0: for ever)."""

    generator: str = ""
    embedder: str = ""
    answer_ttl: float = 0


@dataclass(frozen=True)
class Config:
    data: str = "data"
    output: str = "output"
    ingest: Ingest = field(default_factory=Ingest)
    narration: Narration = field(default_factory=Narration)
    providers: Providers = field(default_factory=Providers)
    summary: Summary = field(default_factory=Summary)


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers win; mappings merge, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            old = out.get(key)
            out[key] = merged(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return out


def build(kind: type, values: Mapping[str, Any]) -> Any:
    hints = get_type_hints(kind)
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**{k: build(hints[k], v) if is_dataclass(hints[k]) else v for k, v in values.items()})


def dotenv(text: str) -> dict[str, str]:
    """Assignments of a .env file; comments and quotes go."""
    out = {}
    for line in text.splitlines():
        key, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def load(path: str | None = None, profile: Mapping[str, Any] | str | None = None, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None, env_file: str = ".env") -> Config:
    """Defaults, profile (a mapping or a file), file, overrides, then SKEIN_DATA and SKEIN_OUTPUT of the environment, or of a .env file."""

    def read(where: str) -> Mapping[str, Any]:
        import yaml

        return yaml.safe_load(Path(where).read_text(encoding="utf-8")) or {}

    held = read(path) if path else {}
    profile = read(profile) if isinstance(profile, str) else profile
    if env is None:
        env = (dotenv(Path(env_file).read_text(encoding="utf-8")) if Path(env_file).is_file() else {}) | dict(os.environ)
    last = {k: env[n] for k, n in (("data", "SKEIN_DATA"), ("output", "SKEIN_OUTPUT")) if n in env}
    return build(Config, merged(profile or {}, held, overrides or {}, last))
