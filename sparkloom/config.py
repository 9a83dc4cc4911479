"""Settings of a project: defaults, and a TOML file that overrides them."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass

FILE = "sparkloom.toml"


@dataclass
class IndexConfig:
    path: str = ".sparkloom/index"
    excludes: list[str] = field(default_factory=list)
    max_chars: int = 4_000_000


@dataclass
class SearchConfig:
    limit: int = 20
    name_weight: float = 3.0
    signature_weight: float = 2.0
    doc_weight: float = 1.0


@dataclass
class MetricsConfig:
    complexity_warning: int = 15
    complexity_error: int = 30
    entry_points: list[str] = field(default_factory=lambda: ["main"])


@dataclass
class Config:
    index: IndexConfig = field(default_factory=IndexConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    metrics: MetricsConfig = field(default_factory=MetricsConfig)
    rules: list[dict] = field(default_factory=list)
    layers: dict[str, str] = field(default_factory=dict)
    allowed: list[list[str]] = field(default_factory=list)


def home() -> str:
    """The user's folder of settings."""
    return os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "sparkloom")


def _fill(into, given: dict, where: str):
    known = {f.name for f in fields(into)}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown setting {where}{key}")
        now = getattr(into, key)
        if is_dataclass(now):
            _fill(now, value, f"{where}{key}.")
        elif not isinstance(value, type(now)) and not (isinstance(now, float) and isinstance(value, int)):
            raise ValueError(f"setting {where}{key} is a {type(now).__name__}")
        else:
            setattr(into, key, value)
    return into


def load(root: str) -> Config:
    """Defaults, then the user's file, then the project's. Unknown settings and rules without their parts raise ValueError."""
    config = Config()
    for path in (os.path.join(home(), FILE), os.path.join(root, FILE)):
        if os.path.exists(path):
            with open(path, "rb") as f:
                _fill(config, tomllib.load(f), "")
    for r in config.rules:
        if missing := {"name", "rule_type", "source_pattern", "target_pattern"} - set(r):
            raise ValueError(f"a rule lacks {', '.join(sorted(missing))}")
        if r["rule_type"].lower() not in ("forbidden", "required", "layer"):
            raise ValueError(f"rule {r['name']} has the unknown type {r['rule_type']}")
    return config
