"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input came in fewer splits than there are cores.

    At scale a scan has far more splits than cores and this is a no-op; a table of one small row group would otherwise
    run its whole Python stage in one task.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder so that later passes neither recompute nor depend on executors.

    The folder is that of ``spark.checkpoint.dir``, which all executors must share.  Where it is unset a folder of this
    machine is taken if Spark runs on this machine alone; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], ddl: str, rows_per_batch: int = 512) -> DataFrame:
    """Apply ``fn`` to column lists of bounded Arrow slices; it yields output tuples in the order of ``ddl``."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                piece = batch.slice(at, rows_per_batch)
                out = list(fn({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)}))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE encoder of a public vocabulary file, built once per worker process."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # fixed value: the pre-tokenisation pattern published with this vocabulary
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(df: DataFrame, text: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """Add the token count of ``text`` and drop the text; a null text has a null count."""
    keep = [c for c in df.columns if c != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + f", `{out}` bigint"

    def count(cols: dict[str, list]) -> Iterable[tuple]:
        enc = encoder(tokenizer)
        sizes = [None if t is None else len(enc.encode_ordinary(t)) for t in cols[text]]
        return zip(*(cols[c] for c in keep), sizes)

    return map_rows(spread(df), count, ddl)


def heavy_classes(classes: DataFrame, n: str, total: int) -> DataFrame:
    """The classes that hold a thousandth of ``total`` rows or more (and 10,000 at least): no more than 1,000 of them."""
    return cut(classes.where(F.col(n) * 1000 >= max(total, 10_000_000)))


def join_classes(rows: DataFrame, classes: DataFrame, on: str, heavy: DataFrame) -> DataFrame:
    """``rows`` joined to ``classes`` on ``on``; the rows of the ``heavy`` ones, at most 1,000 keys, do not move."""
    marked = rows.join(F.broadcast(heavy.select(on, F.lit(True).alias("_heavy"))), on, "left")
    usual = marked.where("_heavy is null").drop("_heavy").join(classes, on)
    few = classes.join(F.broadcast(heavy.select(on)), on, "left_semi")
    return usual.unionByName(marked.where("_heavy").drop("_heavy").join(F.broadcast(few), on))
