"""Integrity records: what an index's files were when it was written, and whether they still are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IntegrityError(RuntimeError):
    """An index whose files differ from its record is not served."""


def states(records: DataFrame, indexes: DataFrame) -> DataFrame:
    """(index_name, fname, state) of recorded files: suppressed, MISSING index, untracked (no hash), ok."""
    rows = records.select("index_name", "fname", "sha256", "size", "suppressed").distinct()
    here = indexes.select("index_name").distinct().withColumn("_here", F.lit(True))
    state = F.when(F.col("suppressed"), "suppressed").when(F.col("_here").isNull(), "MISSING").when(F.col("sha256").isNull(), "untracked").otherwise("ok")
    return rows.join(here, "index_name", "left").select("index_name", "fname", state.alias("state"))


def compare(recorded: DataFrame, found: DataFrame, on: list[str], value: str = "sha256") -> DataFrame:
    """(on, state) of recorded and found files: ok, mismatch, MISSING (recorded only), UNTRACKED_FILE (found only) or
    untracked (recorded without a value).  Both sides have one row a file."""
    a = recorded.select(*on, F.col(value).alias("_was"), F.lit(True).alias("_r"))
    b = found.select(*on, F.col(value).alias("_is"), F.lit(True).alias("_f"))
    state = (
        F.when(F.col("_r").isNull(), "UNTRACKED_FILE").when(F.col("_f").isNull(), "MISSING").when(F.col("_was").isNull(), "untracked")
        .when(F.col("_was") == F.col("_is"), "ok").otherwise("mismatch")
    )
    return a.join(b, on, "full").select(*on, state.alias("state"))


def files_of(spark: SparkSession, folders: list[str], *, hashed: bool) -> DataFrame:
    """(fname, size, mtime, sha256) of the data files in ``folders``; contents are read, by the cluster, only to be hashed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    name = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)  # below the index, which may be moved
    value = F.sha2("content", 256) if hashed else F.lit(None).cast("string")
    return rows.select(name.alias("fname"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), value.alias("sha256"))


def record(spark: SparkSession, folders: list[str], into: str) -> None:
    """Write the record of the files in ``folders`` as a dataset of its own."""
    files_of(spark, folders, hashed=True).write.mode("overwrite").parquet(into)


def states_of(recorded: DataFrame, found: DataFrame, *, fast: bool) -> DataFrame:
    """(fname, state) as in ``compare``; the fast way tells by size and time (to 0.01 s), the other by contents."""
    if not fast:
        return compare(recorded, found, ["fname"])
    stamp = lambda df: df.select("fname", F.concat_ws("/", F.col("size").cast("string"), F.round("mtime", 2).cast("string")).alias("sha256"))
    return compare(stamp(recorded), stamp(found), ["fname"])


def refuse(name: str, bad: list[tuple[str, str]]) -> None:
    if bad:
        raise IntegrityError(f"{name}: {dict(bad)}")
