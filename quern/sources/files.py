"""Finding files and reading them into rows.

Spark's file sources skip every path part that begins with a dot or underscore, also when it is named in full, and so lose
files such as __init__.py.  Paths are therefore listed here and read by the workers.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import CODE_EXTENSIONS, CODE_NAMES, READERS, SKIPPED_DIRECTORIES
from ..functions.text import detect_language, nonblank
from ..operators.rows import map_columns


def _walk(root: Path, skip: frozenset[str] = frozenset()) -> Iterator[str]:
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in skip)
        for f in sorted(files):
            yield os.path.relpath(os.path.join(folder, f), root)


def document_paths(root: str | Path) -> list[str]:
    """Documents below a folder that a reader is known for, in order; folders with a leading dot are not entered."""
    return sorted(p for p in _walk(Path(root)) if os.path.splitext(p)[1].lower() in READERS)


def code_paths(root: str | Path, timeout: float = 30) -> list[str]:
    """Source files of a project: what git tracks, or, if that cannot be told, a walk around the usual build folders."""
    root = Path(root)
    names: list[str] | None = None
    if (root / ".git").exists():
        try:
            done = subprocess.run(["git", "-C", str(root), "ls-files", "-z"], capture_output=True, timeout=timeout, check=True)
            names = [n for n in done.stdout.decode("utf-8", "surrogateescape").split("\0") if n and (root / n).exists()]
        except (OSError, subprocess.SubprocessError):
            names = None
    if names is None:
        names = list(_walk(root, frozenset(SKIPPED_DIRECTORIES)))
    extensions, exact = frozenset(CODE_EXTENSIONS), frozenset(CODE_NAMES)
    return sorted(n for n in names if os.path.splitext(n)[1] in extensions or os.path.basename(n) in exact)


def read_files(spark: SparkSession, root: str | Path, paths: list[str], per_task: int = 64) -> DataFrame:
    """(source, content, size, mtime) of files below ``root``, which the workers must see; a file that is gone has null content."""
    base = str(root)
    rows = spark.createDataFrame([(p,) for p in paths], "source string").repartition(max(1, -(-len(paths) // per_task)))

    def run(cols):
        for p in cols["source"]:
            full = os.path.join(base, p)
            try:
                with open(full, "rb") as f:
                    data = f.read()
                yield p, data, len(data), os.path.getmtime(full)
            except OSError:
                yield p, None, None, None

    return map_columns(rows, run, "source string, content binary, size bigint, mtime double", 16)


def code_documents(spark: SparkSession, root: str | Path) -> DataFrame:
    """(source, full_text, doc_type, language, ocr, hash) of a project's files that are not blank."""
    from ..functions.text import sanitize

    raw = read_files(spark, root, code_paths(root)).where("content is not null")
    text = sanitize(F.make_valid_utf8(F.col("content").cast("string")))
    language = detect_language(F.col("source"))
    docs = raw.select("source", text.alias("full_text"), F.lit("code").alias("doc_type"), F.when(language != "", language).alias("language"), F.lit(False).alias("ocr"), F.sha2("content", 256).alias("hash"))
    return docs.where(nonblank(F.col("full_text")))
