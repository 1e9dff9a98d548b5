"""Reading stored documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the source and scan mark of their document where their own are missing."""
    docs = documents.select("doc_id", F.col("source").alias("_ds"), F.col("ocr").alias("_do"))
    joined = chunks.join(docs, "doc_id", "left")
    return joined.withColumn("source", F.coalesce("source", "_ds", F.lit(""))).withColumn("ocr", F.coalesce("ocr", "_do", F.lit(False))).drop("_ds", "_do")


def neighbours(hits: DataFrame, chunks: DataFrame, context: int) -> DataFrame:
    """Chunks of the same document within ``context`` places of each hit (hit_id, id, chunk_idx, is_hit).

    Places are bucketed by the width of the window, so a document of very many chunks is an equi-join on (document,
    bucket) and never meets itself whole.
    """
    width = max(1, context)
    h = hits.select(F.col("id").alias("hit_id"), "doc_id", F.col("chunk_idx").alias("_at")).where("doc_id is not null")
    h = h.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_at") - context) / width), F.floor((F.col("_at") + context) / width))))
    c = chunks.select("id", "doc_id", "chunk_idx", F.floor(F.col("chunk_idx") / width).alias("_b")).where("doc_id is not null")
    met = h.join(c, ["doc_id", "_b"]).where(F.abs(F.col("chunk_idx") - F.col("_at")) <= context)
    return met.select("hit_id", "id", "chunk_idx", (F.col("id") == F.col("hit_id")).alias("is_hit"))


def positions(chunks: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Chunks with ``pos``, their place from 0 among their group."""
    return chunks.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def documents_by_source(asked: DataFrame, documents: DataFrame, *, source: str = "source", text: str = "full_text", most: int = 10) -> DataFrame:
    """(asked, found, source, text): the documents whose source is exactly the one asked for; where there is none, up to
    ``most`` sources that contain it, by name, without text; where there are none either, one row with nulls.

    ``asked`` has the column ``asked``.  Sources list the stretches they have of the lengths asked for, so suggestions are
    an equi-join; only the lengths, one number each, are broadcast.
    """
    want = asked.select("asked").where("asked is not null").distinct()
    docs = documents.select(F.col(source).alias("_s"), F.col(text).alias("_t")).where("_s is not null")
    exact = want.join(docs, F.col("asked") == F.col("_s")).select("asked", F.lit(True).alias("found"), F.col("_s").alias("source"), F.col("_t").alias("text"))
    other = want.join(docs.select(F.col("_s").alias("asked")).distinct(), "asked", "left_anti")
    lengths = other.agg(F.collect_set(F.length("asked")).alias("_ns"))
    names = docs.select("_s").distinct().join(F.broadcast(lengths))
    names = names.select("_s", F.explode("_ns").alias("_n")).where((F.col("_n") > 0) & (F.col("_n") <= F.length("_s")))
    starts = names.select("_s", "_n", F.explode(F.sequence(F.lit(1), F.length("_s") - F.col("_n") + 1)).alias("_i"))
    like = starts.select("_s", F.expr("substring(_s, _i, _n)").alias("asked")).distinct().join(other, "asked")
    first = like.withColumn("_r", F.row_number().over(Window.partitionBy("asked").orderBy("_s"))).where(F.col("_r") <= most)
    some = other.join(first, "asked", "left").select("asked", F.lit(False).alias("found"), F.col("_s").alias("source"), F.lit(None).cast("string").alias("text"))
    return exact.unionByName(some)


def nth_chunk(asked: DataFrame, chunks: DataFrame, *, by: str = "doc_id", order: tuple[str, ...] = ("chunk_idx", "id"), key: str = "id", context: int = 0) -> DataFrame:
    """(by, n, key, pos, total, is_hit, text): chunk ``n`` (from 0) of each group asked for and ``context`` chunks on either
    side of it, as they lie in order; a number out of range gives one row with the total alone.

    ``asked`` has the columns ``by`` and ``n``.  Places are counted on keys; texts are fetched for the chunks shown.
    """
    want = asked.select(by, "n").where(F.col(by).isNotNull() & F.col("n").isNotNull()).distinct()
    placed = positions(chunks.select(by, *order).join(want.select(by).distinct(), by, "left_semi"), by=[by], order=[*order])
    totals = placed.groupBy(by).agg(F.count("*").alias("total"))
    inside = want.join(totals, by).withColumn("_ok", (F.col("n") >= 0) & (F.col("n") < F.col("total")))
    spots = inside.where("_ok").withColumn("pos", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - context), F.least(F.col("n") + context, F.col("total") - 1).cast("int"))))
    shown = spots.join(placed.select(by, "pos", key), [by, "pos"]).join(chunks.select(key, "text"), key)
    cols = [by, "n", key, "pos", "total", (F.col("pos") == F.col("n")).alias("is_hit"), "text"]
    kinds = {c: chunks.schema[c].dataType for c in (key, "text")}
    out = inside.where("not _ok").select(by, "n", F.lit(None).cast(kinds[key]).alias(key), F.lit(None).cast("int").alias("pos"), "total", F.lit(False).alias("is_hit"), F.lit(None).cast("string").alias("text"))
    return shown.select(*cols).unionByName(out)


def listing(documents: DataFrame, chunks: DataFrame, *, index: str = "index_name", containing: str | None = None, most: int | None = 50) -> DataFrame:
    """(index, total, shown): how many sources each index has and up to ``most`` of them by name with their chunks.

    ``containing`` keeps the sources that contain it, whatever the case, and then all of them are shown.
    """
    docs = documents.where(F.col("source").isNotNull())
    if containing is not None:
        docs, most = docs.where(F.contains(F.lower("source"), F.lit(containing.lower()))), None
    counts = chunks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_c"))
    names = docs.join(counts, "doc_id", "left").groupBy(index, "source").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_chunks"))
    totals = names.groupBy(index).agg(F.count("*").alias("total"))
    placed = names.withColumn("_r", F.row_number().over(Window.partitionBy(index).orderBy("source")))
    placed = placed if most is None else placed.where(F.col("_r") <= most)
    return placed.join(totals, index).select(index, "total", F.col("_r").alias("n"), "source", "n_chunks")


def read_range(chunks: DataFrame, *, by: list[str], order: list[str], key: str = "id", start: int = 0, count: int = 10, most: int = 30) -> DataFrame:
    """(by, text, n, remaining): ``count`` chunks (``most`` at once) of each group from ``start``, joined by blank lines.

    Places are counted on keys alone; texts are fetched for the chunks shown.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    a, b = max(0, start), max(0, start) + min(count, most)
    placed = positions(chunks.select(*dict.fromkeys([*by, *order, key])), by=by, order=order)
    totals = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    inside = placed.where((F.col("pos") >= a) & (F.col("pos") < b)).select(*by, "pos", key).join(chunks.select(key, "text"), key)
    got = inside.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t")).join(totals, by)
    joined = F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n")
    return got.select(*by, joined.alias("text"), F.size("_t").alias("n"), F.greatest(F.col("_n") - b, F.lit(0)).alias("remaining"))


def detect_source(questions: DataFrame, sources: DataFrame, *, question: str = "text", source: str = "source", least: int = 8) -> DataFrame:
    """(qid, source): the source whose stem, or run of words of a stem of three or more, is the longest one in the question.

    Ties go to the first source.  Sources list their runs of words, questions every stretch of characters of one of the
    lengths that occur, and the two meet in an equi-join; the lengths are the only thing broadcast, one number each.
    """
    low = F.lower(F.regexp_replace(source, r"\.[^.]*$", ""))
    words = F.split(F.trim(F.regexp_replace(low, r"\s+", " ")), " ")
    n = F.size("_w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("_w", i, k), " "))))
    named = sources.select(source).distinct().withColumn("_l", low).withColumn("_w", words)
    keys = named.select(source, F.explode(F.array_distinct(F.concat(F.array("_l"), F.when(n >= 3, runs).otherwise(F.array().cast("array<string>"))))).alias("_run"))
    keys = keys.where(F.length("_run") >= least).groupBy("_run").agg(F.min(source).alias(source))
    # every run of characters of a source's length that begins at a word of the question
    lengths = keys.select(F.length("_run").alias("_n")).distinct().agg(F.collect_list("_n").alias("_ns"))
    asked = questions.select("qid", F.lower(question).alias("_q")).crossJoin(F.broadcast(lengths))
    cuts = asked.select("qid", F.explode(F.transform(F.sequence(F.lit(1), F.length("_q")), lambda i: F.struct(i.alias("i"), F.col("_q").alias("q"), F.col("_ns").alias("ns")))).alias("_c"))
    windows = cuts.select("qid", F.explode(F.transform(F.col("_c.ns"), lambda m: F.substring(F.col("_c.q"), F.col("_c.i"), m))).alias("_run"))
    hits = windows.distinct().join(keys, "_run")
    return hits.groupBy("qid").agg(F.min(F.struct(-F.length("_run"), source))[source].alias(source))
