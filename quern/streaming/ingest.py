"""Continuous ingestion: a stream of documents appended to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..operators.dedup import content_hash, first_of
from ..operators.embed import Embedder, embed
from ..operators.store import Index


def chunked(docs: DataFrame, embedder: Embedder | None, **sizes) -> DataFrame:
    """Chunks of documents (source, full_text, ocr) as an index stores them, without ids."""
    pieces = chunk_documents(docs, key="source", text="full_text", **sizes)
    marks = docs.select("source", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    rows = pieces.join(marks, "source").withColumn("id", F.lit(None).cast("long"))
    if embedder is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    keyed = rows.withColumn("_key", F.concat_ws("\u0000", "source", F.col("chunk_idx").cast("string")))
    return keyed.join(embed(keyed, embedder, key="_key", text="text"), "_key").drop("_key")


def append_batch(index: Index, docs: DataFrame, embedder: Embedder | None = None, **sizes) -> None:
    """Append the documents (source, full_text, ocr) that the index does not hold by content or by source yet."""
    fresh = docs.where("full_text is not null").withColumn("hash", content_hash(F.col("full_text")))
    fresh = first_of(first_of(fresh, ["hash"], ["source"]), ["source"], ["hash"])
    if index.exists():
        known = index.read("hashes")
        fresh = fresh.join(known.select("hash"), "hash", "left_anti").join(known.select(F.col("filename").alias("source")), "source", "left_anti")
    hashes = fresh.select("hash", F.col("source").alias("filename"))
    documents = fresh.select("source", "full_text", F.coalesce("ocr", F.lit(False)).alias("ocr"))
    if fresh.isEmpty():
        return
    index.append(chunked(fresh, embedder, **sizes), hashes, documents)


def ingest(stream: DataFrame, index: Index, checkpoint: str, embedder: Embedder | None = None, **sizes) -> StreamingQuery:
    """Append each micro-batch of a stream of documents; a batch repeated after a failure is known by its hashes."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_batch(index, batch, embedder, **sizes)).option("checkpointLocation", checkpoint).start()
