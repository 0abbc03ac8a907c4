"""Settings: defaults, then a TOML file, then the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields


@dataclass
class Config:
    home: str = ".skeingraph"
    git_log_count: int = 5
    search_limit: int = 20
    max_depth: int = 5


def load(root: str, name: str = "skeingraph.toml", prefix: str = "SKEINGRAPH_") -> Config:
    """Unknown keys are ignored; values that don't convert raise ValueError."""
    found: dict = {}
    path = os.path.join(root, name)
    if os.path.isfile(path):
        with open(path, "rb") as f:
            found = tomllib.load(f)
    kinds = {f.name: type(f.default) for f in fields(Config)}
    given = {k: v for k, v in found.items() if k in kinds}
    given |= {k: os.environ[prefix + k.upper()] for k in kinds if prefix + k.upper() in os.environ}
    return Config(**{k: kinds[k](v) for k, v in given.items()})
