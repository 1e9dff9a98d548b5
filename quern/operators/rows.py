"""Running a function of columns over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def spread(df: DataFrame) -> DataFrame:
    """Use every core for a table that came in fewer splits than there are cores; larger scans stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[tuple]], ddl: str, batch: int = 512) -> DataFrame:
    """``fn`` gets column lists of bounded slices and yields output tuples in the order of ``ddl``."""
    schema = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                piece = whole.slice(at, batch)
                out = list(fn({n: piece.column(i).to_pylist() for i, n in enumerate(piece.schema.names)}))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
