"""Kind and programming language of stored pieces, which carry neither."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "sh": "bash", "h": "c"}


def with_origin(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunks`` with doc_type and language: those of the document; where that is not known, of a document of the same index
    and path; else the commonest kind of the index; else what a ``# file:`` line or its absence tells.  A document's own null
    language stays null; code without any document is named by its extension.  Rows are neither lost nor doubled."""
    by_id = documents.where("doc_id is not null").groupBy("doc_id").agg(F.first(F.struct("doc_type", "language")).alias("_d"))
    by_path = documents.where("source is not null").groupBy("index_name", "source").agg(F.max(F.struct("doc_type", "language")).alias("_s"))
    by_index = documents.where("doc_type is not null").groupBy("index_name", "doc_type").count().groupBy("index_name").agg(F.max_by("doc_type", F.struct("count", "doc_type")).alias("_i"))
    named = F.regexp_extract("text", r"\A# file: *(\S+)", 1)
    extension = F.lower(F.regexp_extract(F.coalesce("source", named), r"\.(\w+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in _EXTENSIONS.items() for x in pair))
    guessed = F.coalesce(F.try_element_at(known, extension), F.when(extension != "", extension), F.lit("unknown"))
    kind = F.coalesce("_d.doc_type", "_s.doc_type", "_i", F.when(F.col("text").startswith("# file:"), "code").otherwise("book"))
    joined = chunks.join(by_id, "doc_id", "left").join(by_path, ["index_name", "source"], "left").join(by_index, "index_name", "left")
    return joined.withColumn("doc_type", kind).withColumn(
        "language", F.when(F.col("_d").isNotNull(), F.col("_d.language")).when(F.col("_s").isNotNull(), F.col("_s.language")).when(kind == "code", guessed)
    ).select(*chunks.columns, "doc_type", "language")
