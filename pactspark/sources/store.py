"""Where an engine keeps documents, publications, manifests and budgets: JSON files in one folder, or memory."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any
from urllib.parse import quote, unquote

#: Documents written under another version are set aside until they are registered again.
ENGINE = 2


class Store:
    """Named JSON values by kind. ``root`` None keeps them in memory."""

    def __init__(self, root: str | None = None):
        self.root, self.held = Path(root) if root else None, {}

    def _path(self, kind: str, name: str) -> Path:
        return self.root / kind / f"{quote(name, safe='')}.json"

    def put(self, kind: str, name: str, value: Any) -> None:
        """Replaces the value whole: a reader sees the old one or the new one."""
        if self.root is None:
            self.held[kind, name] = json.loads(json.dumps(value, default=str))
            return
        path = self._path(kind, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        beside = path.with_suffix(f".{os.getpid()}.tmp")
        beside.write_text(json.dumps(value, default=str, sort_keys=True))
        os.replace(beside, path)

    def get(self, kind: str, name: str, default: Any = None) -> Any:
        if self.root is None:
            return self.held.get((kind, name), default)
        path = self._path(kind, name)
        return json.loads(path.read_text()) if path.exists() else default

    def names(self, kind: str) -> list[str]:
        if self.root is None:
            return sorted(n for k, n in self.held if k == kind)
        return sorted(unquote(p.stem) for p in (self.root / kind).glob("*.json"))

    @contextlib.contextmanager
    def locked(self, name: str) -> Iterator[None]:
        """One holder at a time among the processes that share the folder."""
        if self.root is None:
            yield
            return
        self.root.mkdir(parents=True, exist_ok=True)
        with open(self.root / f"{name}.lock", "w") as handle:
            fcntl.flock(handle, fcntl.LOCK_EX)
            yield

    def documents(self) -> tuple[list[Mapping], list[str]]:
        """All contract documents that this engine can read, and the names of stale ones."""
        good, stale = [], []
        for name in self.names("contracts"):
            held = self.get("contracts", name)
            (good if held["engine"] == ENGINE else stale).append(held["document"] if held["engine"] == ENGINE else name)
        return good, stale
