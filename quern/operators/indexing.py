"""From files to what an index stores: what is new, documents, chunks, hashes, summary and record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import SUMMARY_SOURCE
from ..settings import Settings
from .chunking import chunk_code_files, chunk_documents, project_summary
from .dedup import content_hash, dedup_reasons


def judged(files: DataFrame, stored: DataFrame, *, group: str = "index_name") -> DataFrame:
    """``files`` (group, source, full_text, ...) with hash and reason; see ``dedup_reasons``.  Null texts are left out."""
    rows = files.where("full_text is not null and source is not null").withColumn("hash", content_hash(F.col("full_text")))
    return dedup_reasons(rows, stored, group=group, path="source", hash="hash", order=["source", "doc_id"])


def index_files(files: DataFrame, stored: DataFrame, *, group: str = "index_name", settings: Settings | None = None) -> dict[str, DataFrame]:
    """Tables of the indexes that ``files`` (group, doc_id, source, full_text, doc_type, language, ocr) are to be added to.

    ``reasons`` (group, doc_id, reason) says of every file why it is left out, or 'new'.  Of the new ones: ``documents``;
    ``chunks`` (group, doc_id, source, chunk_idx, chunk_of, text), books by paragraphs and code by units, and the pieces of a
    summary of each project of code under its reserved source; ``hashes``; and ``meta``, one row an index.
    """
    s = settings or Settings()
    rows = judged(files, stored, group=group)
    new = rows.where("reason = 'new'")
    code = new.where((F.col("doc_type") == "code") & (F.col("source") != SUMMARY_SOURCE))
    sizes = {"floor": s.min_chunk_length}
    books = chunk_documents(new.where("doc_type = 'book'"), size=s.chunk_size, overlap=s.overlap, **sizes)
    units = chunk_code_files(code, size=s.code_chunk_size, overlap=s.code_overlap, **sizes)
    places = new.select("doc_id", group, "source")
    summary = project_summary(code, group=group)
    parts = chunk_documents(summary, key=group, text="summary", size=s.code_chunk_size, overlap=s.code_overlap, floor=0)
    cols = [group, "doc_id", "source", "chunk_idx", "chunk_of", "text"]
    own = books.unionByName(units).join(places, "doc_id").select(*cols)
    chunks = own.unionByName(parts.withColumn("doc_id", F.lit(None).cast(new.schema["doc_id"].dataType)).withColumn("source", F.lit(SUMMARY_SOURCE)).select(*cols))
    n_chunks = chunks.groupBy(group).agg(F.count("*").alias("n_chunks"))
    count = lambda r: F.count(F.when(F.col("reason") == r, 1))
    outcome = rows.groupBy(group).agg(
        count("new").alias("n_files"), (count("stored hash") + count("stored name")).alias("n_known"), count("batch duplicate").alias("n_repeated"),
        F.coalesce(F.sum(F.when(F.col("reason") == "new", F.length("full_text"))), F.lit(0)).alias("n_chars"),
    )
    return {
        "reasons": rows.select(group, "doc_id", "reason"),
        "documents": new.select(group, "doc_id", "source", "full_text", "doc_type", "language", "ocr"),
        "chunks": chunks,
        "hashes": new.select(group, "hash", F.col("source").alias("filename")),
        "meta": outcome.join(n_chunks, group, "left").fillna(0, ["n_chunks"]),
    }
