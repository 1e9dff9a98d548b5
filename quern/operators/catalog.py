"""The names of indexes and where they lie."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from .folder import Folder
from .store import Index, Locked

_NAME = re.compile(r"[A-Za-z0-9_-]+")


class IndexNotFound(KeyError):
    """Carries the names there are."""

    def __init__(self, name: str, known: list[str]):
        super().__init__(f"no index {name!r}; there are: {', '.join(known) or 'none'}")
        self.known = known


class Catalog:
    """Indexes under one folder, and registered ones elsewhere; a local name wins over a registered one."""

    def __init__(self, spark: SparkSession, folder):
        self.spark, self.folder = spark, Folder(spark, folder)
        self._registry = self.folder / "external.json"

    def external(self) -> dict[str, str]:
        return self._registry.json() if self._registry.exists() else {}

    def _register(self, entries: dict[str, str]) -> None:
        self._registry.write(json.dumps(entries, indent=2))

    def _local(self) -> dict[str, Folder]:
        places = {n: self.folder / n for n in self.folder.names() if _NAME.fullmatch(n)}
        return {n: p for n, p in places.items() if any(x.startswith("manifest-") for x in p.names())}

    def names(self) -> list[str]:
        return sorted({**self.external(), **self._local()})

    def get(self, name: str) -> Index:
        place = self._local().get(name) or self.external().get(name)
        if not name or place is None:
            raise IndexNotFound(name, self.names())
        return Index(self.spark, place)

    def new(self, name: str) -> Index:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a name: {name!r}")
        return Index(self.spark, self.folder / name)

    def rename(self, old: str, new: str) -> None:
        index = self.get(old)
        if index.locked():
            raise Locked(old)
        if not _NAME.fullmatch(new) or new in self.names():
            raise ValueError(f"not a free name: {new!r}")
        index.folder.move(index.folder.parent() / new)

    def delete(self, name: str) -> None:
        """Remove an unlocked local index, or only the registration of an external one."""
        index = self.get(name)
        if name not in self._local():
            return self.unregister(name)
        if index.locked():
            raise Locked(name)
        index.folder.delete()

    def add_external(self, path) -> None:
        place = Folder(self.spark, path)
        if place.name in self.names():
            raise ValueError(f"{place.name} is taken")
        self._register(self.external() | {place.name: place.path})

    def unregister(self, name: str) -> None:
        self._register({k: v for k, v in self.external().items() if k != name})

    def move(self, name: str, to) -> None:
        """Move a local index into another folder and register it there."""
        index = self.get(name)
        target = Folder(self.spark, to) / name
        if target.exists():
            raise ValueError(f"{target.path} exists")
        index.folder.move(target)
        self._register(self.external() | {name: target.path})

    def stats(self) -> list[dict]:
        out = []
        for n in self.names():
            index = self.get(n)
            meta = index.meta()
            out.append({"name": n} | {k: meta.get(k) for k in ("storage_backend", "embedding_model", "n_chunks", "n_files")} | {"locked": index.locked()})
        return out
