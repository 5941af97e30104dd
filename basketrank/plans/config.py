"""Nested configuration with dotted paths; setting gives a new one."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path

DEFAULTS = {"data": {"target_days": 7, "holdout_days": 0}, "features": [], "target": "Weighted", "model": {"type": "ranker"}, "feature_selection": {"threshold": 0.9}}


def _merge(under: dict, over: dict) -> dict:
    out = copy.deepcopy(under)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    def __init__(self, values: dict | None = None):
        self._values = _merge(DEFAULTS, values or {})

    def get(self, path: str, default=None):
        at = self._values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return copy.deepcopy(at)

    def set(self, path: str, value) -> Config:
        for part in reversed(path.split(".")):
            value = {part: value}
        return Config(_merge(self._values, value))

    def as_dict(self) -> dict:
        return copy.deepcopy(self._values)

    def hash(self) -> str:
        return hashlib.md5(json.dumps(self._values, sort_keys=True).encode()).hexdigest()[:6]

    @staticmethod
    def load(path: str) -> Config:
        text = Path(path).read_text()
        if path.endswith(".json"):
            return Config(json.loads(text))
        import yaml

        return Config(yaml.safe_load(text) or {})

    def save(self, path: str) -> None:
        if path.endswith(".json"):
            Path(path).write_text(json.dumps(self._values, indent=1))
        else:
            import yaml

            Path(path).write_text(yaml.safe_dump(self._values))
