"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunk_code, chunk_text, import_block
from ..functions.text import strip
from ..settings import check_sizes
from .rows import map_columns, spread


def split_paragraphs(text):
    """Array of the stripped, non-empty paragraphs of a text."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: F.length(p) > 0)


def _key(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def chunk_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "full_text", size: int = 1500, overlap: int = 200, floor: int = 50) -> DataFrame:
    """(key, chunk_idx, chunk_of, text) by packed paragraphs; a null text has no chunks."""

    def run(cols):
        for k, t in zip(cols["_k"], cols["_t"]):
            parts = chunk_text(t, size, overlap, floor)
            yield from ((k, i, len(parts), p) for i, p in enumerate(parts))

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null")
    return map_columns(spread(rows), run, f"{_key(docs, key)}, chunk_idx int, chunk_of int, text string")


def window_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "full_text", size: int = 1500, overlap: int = 200, floor: int = 50) -> DataFrame:
    """(key, chunk_idx, chunk_of, text) by windows alone, without Python: texts beyond twice the size are cut, others whole."""
    check_sizes(size, overlap)
    length = F.length("_t")
    starts = F.when(length > 2 * size, F.sequence(F.lit(0), length - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("_t")).where(length > 0)
    parts = F.transform(starts, lambda s: F.when(length > 2 * size, strip(F.substring(F.col("_t"), s + 1, F.lit(size)))).otherwise(F.col("_t")))
    kept = rows.withColumn("_parts", F.filter(parts, lambda p: F.length(p) > floor))
    return kept.select(key, F.posexplode("_parts").alias("chunk_idx", "text"), F.size("_parts").alias("chunk_of"))


def chunk_code_files(
    docs: DataFrame, *, key: str = "doc_id", text: str = "full_text", path: str = "source", language: str = "language", size: int = 3000, overlap: int = 200, floor: int = 50, keep_preamble: bool = False
) -> DataFrame:
    """(key, chunk_idx, chunk_of, text) of source files, cut where units begin."""

    def run(cols):
        for k, t, p, lang in zip(cols["_k"], cols["_t"], cols["_p"], cols["_l"]):
            parts = chunk_code(t, p or "", lang, size, overlap, floor, keep_preamble)
            yield from ((k, i, len(parts), c) for i, c in enumerate(parts))

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(path).alias("_p"), F.col(language).alias("_l")).where("_t is not null")
    return map_columns(spread(rows), run, f"{_key(docs, key)}, chunk_idx int, chunk_of int, text string")


def import_blocks(docs: DataFrame, *, key: str = "doc_id", text: str = "full_text", language: str = "language") -> DataFrame:
    def run(cols):
        return ((k, import_block(t, lang)) for k, t, lang in zip(cols["_k"], cols["_t"], cols["_l"]))

    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(language).alias("_l")).where("_t is not null")
    return map_columns(spread(rows), run, f"{_key(docs, key)}, imports string")


def project_summary(docs: DataFrame, *, group: str = "index_name", path: str = "source", text: str = "full_text", lines: int = 200, depth: int = 3, readme_chars: int = 2000) -> DataFrame:
    """(group, summary, n_files): each project's file tree, folders below ``depth`` collapsed, and the head of its readme."""
    parts = F.split(path, "/")
    entry = F.when(F.size(parts) <= depth, F.col(path)).otherwise(F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/...")))
    files = docs.select(group, path, entry.alias("_entry")).distinct()
    entries = files.groupBy(group, "_entry").agg(F.min(path).alias("_first"), F.count("*").alias("_n"))
    sums = entries.groupBy(group).agg(F.sum("_n").alias("n_files"))
    # the limit of a window's rank is applied before the shuffle too, so no task sees all entries of a large project
    shown = entries.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy("_first", "_entry"))).where(F.col("_i") <= lines)
    tree = shown.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_entry"))).alias("_tree")).join(sums, group)
    names = ("README.md", "README.rst", "README.txt", "README")
    rank = F.array_position(F.array(*map(F.lit, names)), F.col(path))
    readme = docs.where(F.col(path).isin(*names)).groupBy(group).agg(F.min_by(F.substring(text, 1, readme_chars), rank).alias("_readme"))
    body = F.array_join(F.transform("_tree", lambda x: x["_entry"]), "\n")
    head = F.concat(F.lit("# Project: "), F.col(group), F.lit("\n\n## File tree ("), F.col("n_files").cast("string"), F.lit(" files)\n"), body)
    return tree.join(readme, group, "left").select(group, F.concat(head, F.coalesce(F.concat(F.lit("\n\n## README\n"), "_readme"), F.lit(""))).alias("summary"), "n_files")
