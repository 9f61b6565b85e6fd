"""Settings on the driver: a JSON file, a prompt file, a list of users."""

from __future__ import annotations

import csv
import json
import os
import threading
from collections.abc import Mapping
from pathlib import Path


def _without_cycles(value: object, above: tuple[int, ...] = ()) -> object:
    """A copy in which a container inside itself is null; equal plain values stay."""
    if not isinstance(value, (dict, list, tuple)):
        return value
    if id(value) in above:
        return None
    inner = (*above, id(value))
    if isinstance(value, dict):
        return {k: _without_cycles(v, inner) for k, v in value.items()}
    return [_without_cycles(v, inner) for v in value]


class Config:
    """A JSON file of settings. The environment comes before the file; reading writes nothing."""

    def __init__(self, path: str | Path, environ: Mapping[str, str] | None = None) -> None:
        self.path, self.environ = Path(path), os.environ if environ is None else environ
        self._lock = threading.RLock()
        self._data: dict = json.loads(self.path.read_text("utf-8")) if self.path.exists() else {}

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(_without_cycles(self._data), indent=4, ensure_ascii=False), "utf-8")
        part.replace(self.path)

    def get(self, key: str, default: object = None) -> object:
        with self._lock:
            return self.environ.get(key, self._data.get(key, default))

    def set(self, key: str, value: object) -> None:
        with self._lock:
            self._data[key] = value
            self._save()

    def delete(self, key: str) -> None:
        with self._lock:
            if self._data.pop(key, None) is not None:
                self._save()

    def clear(self) -> None:
        with self._lock:
            self._data = {}
            self._save()

    def all(self) -> dict:
        with self._lock:
            return _without_cycles(self._data)

    def remove(self) -> None:
        with self._lock:
            self._data = {}
            self.path.unlink(missing_ok=True)

    def translator(self, name: str) -> dict[str, str]:
        """Stored settings of a service."""
        with self._lock:
            return dict(next((t.get("envs") or {} for t in self._data.get("translators", []) if t.get("name") == name), {}))

    def set_translator(self, name: str, envs: Mapping[str, str]) -> None:
        with self._lock:
            rest = [t for t in self._data.get("translators", []) if t.get("name") != name]
            self._data["translators"] = [*rest, {"name": name, "envs": dict(envs)}]
            self._save()


def read_prompt(path: str | Path) -> str:
    """A prompt template; a file that cannot be read is an error with the file's name."""
    try:
        return Path(path).read_text("utf-8")
    except (OSError, UnicodeDecodeError) as failure:
        raise ValueError(f"prompt error: {path}: {failure}") from failure


def read_users(path: str | Path, page: str | Path | None = None) -> tuple[list[tuple[str, str]], str]:
    """(user, password) of each line, and the text of a page to show, if given."""
    with Path(path).open(newline="", encoding="utf-8") as f:
        users = [(r[0].strip(), r[1].strip()) for r in csv.reader(f) if len(r) >= 2]
    return users, Path(page).read_text("utf-8") if page else ""
