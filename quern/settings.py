"""Behavioural defaults; every operator takes them as keyword arguments."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    embedding_backend: str = "local"
    gpu_indexing: bool = False
    embedding_model: str = "all-MiniLM-L6-v2"
    api_model: str = "nomic-embed-text"
    disable_ocr: bool = False
    ocr_lang: str = "eng"
    force_ocr: bool = False
    ocr_negative: bool = False
    split_spreads: bool = False
    render_dpi: int = 300
    min_image_size: int = 200
    data_dir: str = "indexes"
    storage_backend: str = "faiss"
    chunk_size: int = 1500
    overlap: int = 200
    top_k: int = 5
    min_chunk_length: int = 50
    code_chunk_size: int = 3000
    code_overlap: int = 200

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Stored values over the defaults; unknown keys are dropped, a missing file means defaults."""
        p = Path(path)
        stored = json.loads(p.read_text()) if p.exists() else {}
        return cls(**{f.name: stored[f.name] for f in fields(cls) if f.name in stored})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def ocr_enabled(self, run_override: bool | None = None) -> bool:
        """A run's own wish beats the setting."""
        return not self.disable_ocr if run_override is None else run_override


    def pick(self, name: str, given=None):
        """A run's own value, or the setting where none is given or a number given is not positive."""
        own = getattr(self, name)
        return own if given is None or (isinstance(own, int) and not isinstance(own, bool) and given <= 0 and name != "overlap") else given


def check_sizes(chunk_size: int, overlap: int) -> None:
    if not 0 <= overlap < chunk_size:
        raise ValueError(f"overlap must be at least 0 and below the chunk size, not {overlap} of {chunk_size}")
