"""Queries over the operators of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    from .handwritten import not_handwritten

    return not_handwritten(read(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_kinds(spark, d).select("doc_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .oversized import split_oversized

    return split_oversized(read(spark, d, "documents"), read(spark, d, "index_meta"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("chunk_idx = 0").select("doc_id", "boundary")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    from .codelang import code_languages, fit_models

    return code_languages(read(spark, d, "documents"), fit_models(_books(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_languages(spark, d).select("doc_id", "lang")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    from .origin import with_origin

    return with_origin(read(spark, d, "chunks"), read(spark, d, "documents"))


def p3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Languages in every stored piece of code."""
    from .codelang import code_languages, fit_models

    return code_languages(_chunks(spark, d), fit_models(_books(spark, d)), key="id", text="text")


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Repaired text of the stored pieces of books; words are judged by the counts of all pieces."""
    from .common import cut
    from .scans import repair_scans

    return repair_scans(cut(_chunks(spark, d).where("doc_type = 'book'").select("id", "doc_type", "ocr", "text")), key="id", text="text")


def p7_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of the stored pieces of books."""
    from .markup import markup_kinds

    return markup_kinds(_chunks(spark, d), key="id", text="text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .scans import scan_noise

    return scan_noise(read(spark, d, "documents"))[0]


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .scans import repair_scans

    return repair_scans(read(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .knn import similar_pairs

    return similar_pairs(read(spark, d, "vec_index")).select("rowid_a", "rowid_b")


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 20, against all rows."""
    from .knn import nearest_of

    vectors = read(spark, d, "vec_index")
    return nearest_of(vectors, vectors.where("rowid % 20 = 0")).withColumn("similarity", F.round("similarity", 6))


def _near(spark: SparkSession, d: str, threshold: float):
    from .neardup import near_duplicates

    return near_duplicates(read(spark, d, "documents"), threshold=threshold)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import all_pairs

    links, members = _near(spark, d, 0.5)
    return all_pairs(links, members).select("doc_id_a", "doc_id_b")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class of exact copies and the number of other texts within 0.8 of it."""
    links, members = _near(spark, d, 0.8)
    ends = links.select(F.col("doc_id_a").alias("rep")).unionByName(links.select(F.col("doc_id_b").alias("rep")))
    counts = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(counts, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    from .markup import markup_kinds

    return markup_kinds(read(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_clean(spark, d).select("doc_id", "markup")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the fewest that could do, tokens and share of room used of each pack."""
    sizes = read(spark, d, "pack_sizes").select("pack", "capacity")
    used = p8_pack(spark, d).where("container is not null").groupBy("pack").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    used = used.join(sizes, "pack").withColumn("fewest", F.ceil(F.col("n_tokens") / F.col("capacity")))
    return used.withColumn("fill", F.col("n_tokens") / (F.col("containers") * F.col("capacity")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))[1]


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached when each mix is to have as many tokens as its sources hold: nearer to the target than to the natural
    shares as far as the repeats allow."""
    from .mixing import mix

    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"), total="available")[1]


def _books(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("doc_type = 'book'")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from .sentences import split_sentences

    documents = read(spark, d, "documents")
    return split_sentences(documents.join(read(spark, d, "sentence_set"), "doc_id", "left_semi"), _books(spark, d))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and their mean length of every document."""
    from .sentences import split_sentences

    documents = read(spark, d, "documents")
    ends = split_sentences(documents, _books(spark, d))
    counts = ends.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max("sent_end").alias("n_chars"))
    return counts.withColumn("mean_chars", F.col("n_chars") / F.col("n_sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_pieces, p3_found, p3_languages, p3_chunks, p4_found, p4_repaired, p4_chunks, p5_found, p5_nearest, p6_found, p6_classes, p7_found, p7_clean, p7_chunks, p8_pack, p8_report, p9_mix, p9_shares, p9_tempered, p10_found, p10_sentences)
}
