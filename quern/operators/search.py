"""From questions to rendered results: search, filter, context, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import navigation, vector
from .embed import Embedder, embed

OCR_MARK, OCR_NOTE = " [OCR]", "[recognised from a scan: letters may be wrong or missing]"
HIT_CHARS, CONTEXT_CHARS, OVERFETCH = 3000, 1500, 10


def search(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, *, context: int = 0, mode: str = "ip", overfetch: int = OVERFETCH
) -> DataFrame:
    """(qid, rank, id, source, chunk_idx, chunk_of, ocr, score, text, adjacent): the ``k`` best chunks of each question.

    ``questions`` has qid and embedding, and may have source_filter: where it is not null, ``overfetch`` times as many hits
    are looked at and those whose source contains it are kept, which may be fewer than ``k``.  ``vectors`` has id and
    embedding.  ``adjacent`` lists (chunk_idx, id, text) of the chunks of the same document within ``context`` places, in
    order, without those of the hit's own place.  Hits without a stored chunk are left out before they are ranked.
    """
    filtered = "source_filter" in questions.columns
    hits = vector.top_k(questions.select("qid", "embedding"), vectors.select("id", "embedding"), k * overfetch if filtered else k, mode=mode)
    own = chunks.select("id", "doc_id", F.coalesce("source", F.lit("")).alias("source"), "chunk_idx", "chunk_of", F.coalesce("ocr", F.lit(False)).alias("ocr"), "text")
    found = hits.join(own, "id")
    if filtered:
        found = found.join(questions.select("qid", "source_filter"), "qid")
        found = found.where(F.when(F.col("source_filter").isNull(), F.col("rank") <= k).otherwise(F.contains("source", "source_filter")))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("raw"), "id"))
    found = found.withColumn("rank", best).where(F.col("rank") <= k)
    cols = ["qid", "rank", "id", "source", "chunk_idx", "chunk_of", "ocr", F.col("raw").alias("score"), "text"]
    if context < 1:
        none = F.array().cast("array<struct<chunk_idx:int,id:bigint,text:string>>")
        return found.select(*cols, none.alias("adjacent"))
    near = navigation.neighbours(found.select("id", "doc_id", "chunk_idx").distinct(), chunks, context).where("not is_hit")
    texts = near.join(chunks.select("id", "text"), "id").select(F.col("hit_id").alias("id"), F.struct("chunk_idx", F.col("id"), "text").alias("_a"))
    around = texts.groupBy("id").agg(F.array_sort(F.collect_list("_a")).alias("adjacent"))
    whole = found.join(around, "id", "left")
    others = F.filter("adjacent", lambda a: a["chunk_idx"] != F.col("chunk_idx"))
    return whole.select(*cols, F.coalesce(others, F.array()).alias("adjacent"))


def ask(questions: DataFrame, chunks: DataFrame, embedder: Embedder, k: int = 5, *, sources: DataFrame | None = None, **more) -> DataFrame:
    """``search`` for questions in words (qid, text[, source_filter]) among chunks with their embeddings.

    With ``sources`` a question without a filter gets the source that it names, if it names one.
    """
    asked = questions.join(embed(questions, embedder, key="qid", text="text"), "qid")
    if sources is not None:
        named = navigation.detect_source(questions, sources).select("qid", F.col("source").alias("_named"))
        given = F.col("source_filter") if "source_filter" in asked.columns else F.lit(None).cast("string")
        asked = asked.join(named, "qid", "left").withColumn("source_filter", F.coalesce(given, "_named")).drop("_named")
    return search(asked, chunks, chunks.where("embedding is not null").select("id", "embedding"), k, **more)


def render(hits: DataFrame) -> DataFrame:
    """(qid, body): the results of each question as text, the context of a hit around it."""
    part = lambda side: F.transform(
        F.filter("adjacent", side), lambda a: F.concat(F.lit("[context: chunk "), (a["chunk_idx"] + 1).cast("string"), F.lit("]\n"), F.substring(a["text"], 1, CONTEXT_CHARS))
    )
    before, after = part(lambda a: a["chunk_idx"] < F.col("chunk_idx")), part(lambda a: a["chunk_idx"] > F.col("chunk_idx"))
    text = F.array_join(F.concat(before, F.array(F.substring("text", 1, HIT_CHARS)), after), "\n\n")
    place = F.concat(F.lit(" | chunk "), (F.col("chunk_idx") + 1).cast("string"), F.lit("/"), F.col("chunk_of").cast("string"))
    score = F.format_string(" | score %.3f", "score")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), place, score, F.when(F.col("ocr"), f"{OCR_MARK}\n{OCR_NOTE}\n").otherwise(""), F.lit("\n"))
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(head, text).alias("b")))).alias("_r"))
    return rows.select("qid", F.array_join(F.transform("_r", lambda x: x["b"]), "\n\n---\n\n").alias("body"))


def as_json(hits: DataFrame) -> DataFrame:
    """(qid, json): the results of each question as one JSON array of objects, in rank order."""
    fields = [c for c in hits.columns if c != "qid"]
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in fields if c != "rank")))).alias("_r"))
    return rows.select("qid", F.to_json("_r").alias("json"))
