"""Settings from a JSON file (or YAML, where a reader for it is installed)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from tessera.errors import SearchError
from tessera.sources.store import check_name

#: The roles a process can have.
ROLES = ("local", "shard", "coordinator")


@dataclass(frozen=True)
class Settings:
    """``host``, ``port``, ``workers`` and ``role`` are checked and kept for a server around the engine."""

    data: str = "data"
    model_path: str | None = None
    synonyms_path: str | None = None
    host: str = "127.0.0.1"
    port: int = 8080
    workers: int = 4
    role: str = "local"
    topology: str | None = None
    index_name: str = "demo"
    shard_id: int | None = None
    snapshot_path: str | None = None
    epoch_path: str | None = None

    def __post_init__(self):
        whole = {"port": (1, 65535), "workers": (1, 64)}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in whole:
                low, high = whole[f.name]
                good = type(value) is int and low <= value <= high
            elif f.name == "shard_id":
                good = value is None or type(value) is int
            else:
                good = isinstance(value, str) or value is None and f.default is None
            if not good:
                raise SearchError("INVALID_SETTINGS", "a setting is out of range", 422, setting=f.name)
        if self.role not in ROLES:
            raise SearchError("INVALID_SETTINGS", "unknown role", 422, setting="role")


def load_settings(path: str | None = None) -> Settings:
    """Defaults, overridden by the file; unknown names are errors."""
    if path is None:
        return Settings()
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise SearchError("INVALID_SETTINGS", "no YAML reader is installed; use JSON", 422) from None
        found = yaml.safe_load(text)
    else:
        try:
            found = json.loads(text) if text.strip() else None
        except ValueError as e:
            raise SearchError("INVALID_SETTINGS", f"not JSON: {e}", 422) from None
    found = {} if found is None else found
    if not isinstance(found, dict):
        raise SearchError("INVALID_SETTINGS", "settings are one object", 422)
    unknown = sorted(set(found) - {f.name for f in fields(Settings)})
    if unknown:
        raise SearchError("INVALID_SETTINGS", "unknown settings", 422, settings=unknown)
    return Settings(**found)


def index_path(settings: Settings, name: str | None = None) -> str:
    return str(Path(settings.data) / check_name(name or settings.index_name))
