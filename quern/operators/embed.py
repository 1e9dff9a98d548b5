"""Embedding texts: the protocol, an offline embedder, and its application by Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_columns, spread


class Embedder(Protocol):
    name: str
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Hashed bag of words, signed and of unit length.  It stands in where no model is installed and is no match for one."""

    def __init__(self, dim: int = 64):
        self.dim, self.name, self._at = dim, f"hashing-{dim}", {}

    def _place(self, word: str) -> tuple[int, float]:
        if len(self._at) > 200_000:
            self._at.clear()
        if word not in self._at:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self._at[word] = h % self.dim, 1.0 if h >> 63 else -1.0
        return self._at[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                j, sign = self._place(w)
                out[i, j] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).astype(np.float32)


class HttpEmbedder:
    """A model behind an HTTP address that takes {"model", "input"} and returns {"data": [{"index", "embedding"}]}."""

    def __init__(self, url: str, model: str, dim: int, batch: int = 32, timeout: float = 120):
        self.url, self.name, self.dim, self.batch, self.timeout = url, model, dim, batch, timeout

    def __call__(self, texts: list[str]) -> np.ndarray:
        import json
        import urllib.request

        rows: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.name, "input": texts[at : at + self.batch]}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                data = json.load(answer)["data"]
            rows += [r["embedding"] for r in sorted(data, key=lambda r: r["index"])]
        out = np.asarray(rows, np.float64)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).astype(np.float32)


def best_device(wanted: str | None = None) -> str:
    """The device asked for, else the fastest that torch reports, else the processor."""
    if wanted:
        return wanted
    try:
        import torch  # optional
    except ImportError:
        return "cpu"
    for name in ("xpu", "cuda"):
        part = getattr(torch, name, None)
        if part is not None and part.is_available() and part.device_count():
            return name
    return "cpu"


class Resident:
    """An embedder that each worker process loads when it first needs it and keeps until another is asked for.

    ``load(name, device)`` makes the model; what travels to the workers is only this description."""

    _held: tuple | None = None

    def __init__(self, load: Callable[[str, str], Embedder], name: str, dim: int, device: str | None = None):
        self.load, self.name, self.dim, self.device = load, name, dim, device

    def __call__(self, texts: list[str]) -> np.ndarray:
        key = (self.name, best_device(self.device))
        if Resident._held is None or Resident._held[0] != key:
            Resident._held = None  # the one before goes first
            Resident._held = (key, self.load(*key))
        return Resident._held[1](texts)


class NoModel(RuntimeError):
    """No embedder for what an index was made with."""


def embedder_of(meta: dict, makers: dict[str, Callable[[dict], Embedder]], *, probe: Callable[[str, str], bool] | None = None, fetch: Callable[[str, str], None] | None = None) -> Embedder:
    """The embedder that an index's metadata name: ``makers`` by backend make it from the metadata.

    ``probe(backend, model)`` tells whether the model is there; if not, ``fetch`` is to bring it, once.  A model of another
    length than the vectors stored is refused.
    """
    backend, model = meta.get("embedding_backend", "local"), meta.get("embedding_model", "all-MiniLM-L6-v2")
    if backend not in makers:
        raise NoModel(f"no maker for backend {backend!r}; there are: {', '.join(sorted(makers)) or 'none'}")
    if probe is not None and not probe(backend, model):
        if fetch is not None:
            fetch(backend, model)
        if fetch is None or not probe(backend, model):
            raise NoModel(f"{backend} has no model {model!r}")
    made = makers[backend](meta)
    if meta.get("dim") not in (None, made.dim):
        raise NoModel(f"{made.name} makes vectors of {made.dim}, the index holds vectors of {meta['dim']}")
    return made


def embed(rows: DataFrame, embedder: Embedder, *, key: str = "id", text: str = "text", batch: int = 64) -> DataFrame:
    """(key, embedding); a null text is embedded as an empty one."""

    def run(cols):
        return zip(cols["_k"], embedder([x or "" for x in cols["_t"]]).tolist())

    kind = rows.schema[key].dataType.simpleString()
    return map_columns(spread(rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"))), run, f"`{key}` {kind}, embedding array<float>", batch)
