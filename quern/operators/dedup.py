"""Removing what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group by an order that has no ties; one aggregate with map-side combination, no window."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("_r")).select("_r.*")


def merge_hashes(rows: DataFrame, *, hash: str = "hash", name: str = "filename", order: list[str], last: bool) -> DataFrame:
    """One name a hash: the last or the first written."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(hash).agg(pick(name, F.struct(*order)).alias(name))


def dedup_reasons(files: DataFrame, stored: DataFrame, *, group: str, path: str, hash: str, order: list[str]) -> DataFrame:
    """Each file with why it is left out, or 'new': its hash is stored, its path is stored, or an earlier new file has it.

    Files left out by the first two rules do not count as earlier files.
    """
    hashes = stored.select(group, F.col("hash").alias(hash)).distinct().withColumn("_h", F.lit(True))
    paths = stored.select(group, F.col("filename").alias(path)).distinct().withColumn("_p", F.lit(True))
    known = files.join(hashes, [group, hash], "left").join(paths, [group, path], "left")
    rule = F.when(F.col("_h"), "stored hash").when(F.col("_p"), "stored name")
    marked = known.withColumn("reason", rule).drop("_h", "_p")
    # the least of each hash by one aggregate; the join back is by hash, which AQE splits where one is hot
    first = marked.where("reason is null").groupBy(group, hash).agg(F.min(F.struct(*order)).alias("_first"))
    joined = marked.join(first, [group, hash], "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(F.struct(*order) == F.col("_first"), "new").otherwise("batch duplicate"))).drop("_first")
