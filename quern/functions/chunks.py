"""Splitting one text into pieces; plain functions that the chunking operators map over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..fixed import IMPORT_STARTS, UNIT_STARTS
from ..settings import check_sizes

_GAP = re.compile(r"\n\s*\n")
_UNITS = {k: re.compile(v, re.M) for k, v in UNIT_STARTS.items()}
_IMPORTS = {k: re.compile(v) for k, v in IMPORT_STARTS.items()}


def _packed(text: str, size: int, overlap: int, compat: bool) -> Iterator[str]:
    """Paragraphs gathered greedily; a piece that is full hands its last ``overlap`` characters to the next."""
    held = ""
    for para in filter(None, map(str.strip, _GAP.split(text))):
        if not held:
            held = para
        elif len(held) + 2 + len(para) <= size:
            held += "\n\n" + para
        else:
            yield held
            carry = held[-overlap:] if overlap or compat else ""
            held = f"{carry}\n\n{para}" if carry and len(held) > overlap else para
    if held:
        yield held


def chunk_text(text: str, size: int = 1500, overlap: int = 200, floor: int = 50, compat: bool = False) -> list[str]:
    """Pieces of a text: packed paragraphs, those beyond twice the size cut into windows, short ones dropped.

    With an overlap of 0 nothing is carried; ``compat`` carries the whole piece, as the original engine does.
    """
    check_sizes(size, overlap)
    out: list[str] = []
    for piece in _packed(text, size, overlap, compat):
        piece = piece.strip()
        windows = [piece] if len(piece) <= 2 * size else [piece[a : a + size].strip() for a in range(0, len(piece), size - overlap)]
        out += [w for w in windows if len(w) > floor]
    return out


def import_block(text: str, language: str | None) -> str:
    """The run of blank and import-like lines at the head of a file, without blank lines at its end."""
    starts = _IMPORTS.get(language or "")
    if starts is None:
        return ""
    lines = text.split("\n")
    n = next((i for i, line in enumerate(lines) if line.strip() and not starts.match(line.strip())), len(lines))
    head = ["" if not line.strip() else line for line in lines[:n]]
    return re.sub(r"\n*\Z", "", "\n".join(head))


def chunk_code(
    text: str, path: str, language: str | None, size: int = 3000, overlap: int = 200, floor: int = 50, keep_preamble: bool = False
) -> list[str]:
    """Pieces of a source file, each headed by its path and import block.

    A file that fits is one piece.  Otherwise it is cut where top-level units begin; units beyond twice the size are cut
    as text, small neighbours are put together.  What stands before the first unit survives only as the import block
    unless ``keep_preamble``.  Files without known units are cut as text.
    """
    check_sizes(size, overlap)
    head = f"# file: {path}\n\n"
    if len(text) <= size:
        return [head + text]
    imports = import_block(text, language)
    prefix = head + imports + "\n\n" if imports else head
    units = _UNITS.get(language or "")
    starts = [m.start() for m in units.finditer(text)] if units else []
    if len(starts) < 2:
        return [prefix + c for c in chunk_text(text, size, overlap, floor)]
    if keep_preamble and starts[0]:
        starts.insert(0, 0)
    bodies: list[str] = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        unit = text[a:b].rstrip()
        bodies += chunk_text(unit, size, overlap, floor) if len(unit) > 2 * size else [unit]
    merged: list[str] = []
    for body in bodies:
        if merged and len(merged[-1]) + len(body) + 2 <= size:
            merged[-1] += "\n\n" + body
        else:
            merged.append(body)
    return [p for p in (prefix + m for m in merged) if len(p) > floor]
