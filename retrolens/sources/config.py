"""Configuration: a JSON object with defaults, checked, environment as fallback."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from retrolens.operators.relations import Relations, key_groups


@dataclass(frozen=True)
class Config:
    log_name: str
    log_path: str
    key_columns: tuple[str, ...]
    database: str
    backup: str = ""
    aliases: dict[str, str] = field(default_factory=dict)
    comparison: str = "eqonly"
    threads: int = 0
    host: str = "localhost"
    user: str = ""
    password: str = ""

    def groups(self) -> list[list[str]]:
        return key_groups(",".join(self.key_columns))

    def relations(self, foreign_keys: list[tuple[str, str]] = ()) -> Relations:  # type: ignore[assignment]
        return Relations(self.aliases, foreign_keys)


def loads(text: str, env: dict[str, str] | None = None) -> Config | None:
    """The configuration in a JSON text; None if it is no JSON object or lacks
    stateLog.name, a key column or database.name."""
    env = dict(os.environ) if env is None else env
    try:
        held = json.loads(text)
    except ValueError:
        return None
    if not isinstance(held, dict):
        return None
    part = lambda name: held.get(name) if isinstance(held.get(name), dict) else {}
    log, base, change = part("stateLog"), part("database"), part("stateChange")
    keys = held.get("keyColumns")
    if not log.get("name") or not base.get("name") or not isinstance(keys, list) or not keys or not all(isinstance(k, str) and k for k in keys):
        return None
    aliases = {}
    for a in change.get("columnAliases", held.get("columnAliases", [])) or []:
        if isinstance(a, dict) and a.get("alias") and a.get("real"):
            aliases[a["alias"]] = a["real"]
        elif isinstance(a, str) and "=" in a:
            left, _, right = a.partition("=")
            aliases[left] = right
    comparison = str(change.get("rangeComparisonMethod", "eqonly")).lower()
    if comparison not in ("eqonly", "intersect"):
        return None
    return Config(
        log["name"], log.get("path", "."), tuple(keys), base["name"], change.get("backupFile", ""), aliases, comparison, int(change.get("threadNum", 0) or 0),
        base.get("host") or env.get("DB_HOST", "localhost"), base.get("username") or env.get("DB_USER", ""), base.get("password") or env.get("DB_PASS", ""),
    )


def load(path: str) -> Config | None:
    file = Path(path)
    return loads(file.read_text()) if file.is_file() else None
