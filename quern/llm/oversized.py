"""Splitting oversized texts at natural boundaries by lexical cohesion (problem 2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, spread

LEVELS = ("paragraph", "line", "word", "none")
_BLANK = re.compile(r"\n\s*\n")
_SPACE = re.compile(r"\s+")
# scripts written without spaces count one character as one word
_WORD = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W฀-๿぀-ヿ㐀-鿿]+")


def boundary_of(text: str, size: int) -> str:
    """The coarsest boundary whose stretches, stripped, all fit ``size``."""
    if all(len(s.strip()) <= size for s in _BLANK.split(text)):
        return "paragraph"
    if all(len(s.strip()) <= size for s in text.split("\n")):
        return "line"
    return "word" if max(map(len, text.split()), default=0) <= size else "none"


def cohesion(text: str, gaps: np.ndarray, width: int) -> np.ndarray:
    """Cosine similarity of the ``width`` words on either side of each gap (character offsets).

    The dot product of two count vectors is the number of equal pairs of their words; pairs are counted by their distance,
    as differences of running sums, so no vocabulary is built and a text of any length takes 2 * ``width`` passes.
    """
    ids: dict[str, int] = {}
    starts, words = [], []
    for m in _WORD.finditer(text.lower()):
        starts.append(m.start())
        words.append(ids.setdefault(m.group(), len(ids)))
    if not words:
        return np.zeros(len(gaps))
    w, n = np.asarray(words), len(words)
    at = np.searchsorted(np.asarray(starts), gaps)
    first, last = np.maximum(at - width, 0), np.minimum(at + width, n)
    dot, left, right = np.zeros(len(gaps)), (at - first).astype(float), (last - at).astype(float)
    for lag in range(1, min(2 * width, n)):
        equal = np.concatenate([[0], np.cumsum(w[:-lag] == w[lag:])])
        count = lambda a, b: np.where(b > a, equal[np.clip(b, 0, n - lag)] - equal[np.clip(a, 0, n - lag)], 0)  # noqa: B023, E731
        dot += count(np.maximum(first, at - lag), np.minimum(at, last - lag))
        if lag < width:
            left += 2 * count(first, at - lag)
            right += 2 * count(at, last - lag)
    return dot / np.sqrt(np.maximum(left * right, 1))


def depths(sim: np.ndarray) -> np.ndarray:
    """How far each gap lies below the nearest peaks to its left and right."""

    def climb(values: list[float]) -> list[float]:
        peaks: list[float] = []
        for i, v in enumerate(values):
            peaks.append(max(v, peaks[-1]) if i and values[i - 1] >= v else v)
        return peaks

    values = sim.tolist()
    return np.asarray(climb(values)) + np.asarray(climb(values[::-1])[::-1]) - 2 * sim


def pieces(text: str, size: int, overlap: int, width: int = 20) -> Iterator[tuple[int, int, str]]:
    """(start, end, boundary) of pieces none longer than ``size``, each starting ``overlap`` before the end of the one before.

    Each window is cut at a blank line or else a line feed in its later half, else at one anywhere in it, else between words
    in its later half or anywhere, and of these at the deepest valley of cohesion; without any boundary it is cut at the
    limit ('none').  The last piece ends with the text ('end').
    """
    n = len(text)
    levels = [np.unique([m.end() for m in rx.finditer(text)]).astype(int) for rx in (_BLANK, re.compile("\n"), _SPACE)]
    scores: list[np.ndarray | None] = [None, None, None]
    start = 0
    while n - start > size:
        low, high = start + overlap + 1, start + size
        half = max(low, start + (size + overlap) // 2)
        cut, kind = high, "none"
        for k, floor in ((0, half), (1, half), (0, low), (1, low), (2, half), (2, low)):
            i, j = np.searchsorted(levels[k], [floor, high + 1])
            if i < j:
                if scores[k] is None:
                    scores[k] = depths(cohesion(text, levels[k], width))
                d = scores[k][i:j]
                cut, kind = int(levels[k][i + len(d) - 1 - int(np.argmax(d[::-1]))]), LEVELS[k]
                break
        yield start, cut, kind
        start = cut - overlap
    yield start, n, "end"


def split_oversized(
    documents: DataFrame,
    limits: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "full_text",
    group: str = "index_name",
    size: str = "chunk_size",
    overlap: str = "overlap",
    width: int = 20,
) -> DataFrame:
    """Pieces (key, text, chunk_idx, chunk_of, start_char, boundary, cut) of every text longer than its group's limit.

    Lengths are code points.  Each piece fits the limit and repeats exactly the last ``overlap`` characters of the piece
    before, so dropping these restores the text.  ``cut`` is the kind of boundary at which the piece ends (paragraph, line,
    word, none or end), see ``pieces``; ``boundary`` is that of ``boundary_of`` for the whole text, whose stretches would fit
    without an overlap.  A null
    text, a group without a limit, a null or non-positive limit give no rows; a null overlap is 0 and one not below the
    limit is cut to limit - 1.  Further columns of either input are ignored.  ``limits`` needs one row per group.
    """
    lim = limits.select(F.col(group).alias("_g"), F.col(size).alias("_size"), F.col(overlap).alias("_overlap")).where("_size > 0")
    rows = (
        documents.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(group).alias("_g"))
        .join(lim, "_g")
        .where(F.length("_t") > F.col("_size"))
        .select("_k", "_t", "_size", "_overlap")
    )
    key_type = documents.schema[key].dataType.simpleString()

    def run(cols: dict[str, list]):
        for k, t, limit, lap in zip(cols["_k"], cols["_t"], cols["_size"], cols["_overlap"]):
            lap = min(max(lap or 0, 0), limit - 1)
            level = boundary_of(t, limit)
            spans = list(pieces(t, limit, lap, width))
            for i, (a, b, how) in enumerate(spans):
                yield k, t[a:b], i, len(spans), a, level, how

    return map_rows(spread(rows), run, f"`{key}` {key_type}, text string, chunk_idx int, chunk_of int, start_char int, boundary string, cut string")
