"""Exact nearest-vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows of queries and of vectors that are multiplied at a time, few enough for the products to stay in a core's cache.
ROWS, COLS = 128, 2048


def _pack(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (_k, _v) as rows of (_d, _ks, _vs): the length, the sorted keys and the vectors, end to end, of ``block`` rows at most.

    Blocks of long vectors have fewer rows, so that none has more than a million numbers.
    """
    kind = rows.schema["_k"].dataType.simpleString()
    single = isinstance(rows.schema["_v"].dataType.elementType, T.FloatType)
    number = np.float32 if single else np.float64
    ddl = f"_d int, _ks array<{kind}>, _vs binary"
    arrow = to_arrow_schema(T._parse_datatype_string(ddl))

    def one(d: int, keys: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        order = pc.sort_indices(keys)
        ks = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(order))
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), ks.cast(arrow.field("_ks").type), pa.array([x[order.to_numpy()].tobytes()], pa.binary())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(number, copy=False).reshape(-1, d)
                most = max(1, min(block, (1 << 20) // d))
                parts = [*held.pop(d, []), (own.column(0), x)]
                keys, x = pa.concat_arrays([k for k, _ in parts]), np.concatenate([v for _, v in parts])
                whole = len(x) // most * most
                for i in range(0, whole, most):
                    yield one(d, keys[i : i + most], x[i : i + most])
                if whole < len(x):
                    held[d] = [(keys[whole:], x[whole:].copy())]
        for d, [(keys, x)] in held.items():
            yield one(d, keys, x)

    return rows.mapInArrow(run, ddl)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest entries of each row, in order; equal ones by the smaller column."""
    n = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n, None]
    above, equal = scores > least, scores == least
    row, col = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= n - above.sum(axis=1, keepdims=True))))
    order = np.lexsort((col, -scores[row, col], row))
    return row[order], col[order]


def _values(keys: pa.Array) -> np.ndarray:
    return keys.to_numpy(zero_copy_only=False) if pa.types.is_integer(keys.type) else np.array([*keys.to_pylist(), None], object)[:-1]


class _Found:
    """The ``k`` best vectors so far of each query of a block.

    Products in single precision tell which vectors can be among them, by a bound of their error; the scores of these are
    then computed in double precision.  Numbers too large for single precision are multiplied in double throughout.
    """

    def __init__(self, keys: pa.Array, x: np.ndarray, k: int, cosine: bool):
        self.x, self.good = _usable(x, cosine)
        self.keys, self.k, self.cosine = keys.filter(pa.array(self.good)), k, cosine
        self.single, self.norm, self.large = self.x.astype(np.float32), np.linalg.norm(self.x, axis=1), _large(self.x)
        n = len(self.x)
        self.count, self.floor, self.score, self.key = np.zeros(n, int), np.full(n, -np.inf), np.zeros((n, k)), None

    def meet(self, keys: np.ndarray, x: np.ndarray) -> None:
        """Take in vectors, whose keys must be sorted."""
        x, good = _usable(x, self.cosine)
        keys = keys[good]
        for lo in range(0, len(x) if len(self.x) else 0, COLS):
            self._meet(keys[lo : lo + COLS], x[lo : lo + COLS])

    def _meet(self, keys: np.ndarray, y: np.ndarray) -> None:
        double = self.large or _large(y)
        kind = np.float64 if double else np.float32
        a, b, k = self.x if double else self.single, y.astype(kind), self.k
        with np.errstate(all="ignore"):
            error = (y.shape[1] + 4) * float(np.finfo(kind).eps) * self.norm * np.linalg.norm(y, axis=1).max()
            error[~np.isfinite(error)] = 0
            least = self.floor - 1e-9
            least = (2 * least - 1 if self.cosine else least) - error
            lower = np.nextafter(least.astype(kind), kind(-np.inf))
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        room = np.empty((min(ROWS, len(a)), len(b)), kind)
        for lo in range(0, len(a), ROWS):
            part = a[lo : lo + ROWS]
            s = np.matmul(part, b.T, out=room[: len(part)])
            rows = np.flatnonzero((np.fmax.reduce(s, axis=1) if double else s.max(axis=1)) >= lower[lo : lo + ROWS])
            if not len(rows):
                continue
            s, bound = s[rows], lower[lo + rows]
            may = s >= bound[:, None]
            many = np.flatnonzero(np.count_nonzero(may, axis=1) > max(32, 4 * k))
            if len(many):  # the k best here bound what can be among the k best of all
                own = np.partition(s[many], len(b) - k, axis=1)[:, len(b) - k] - 2 * error[lo + rows[many]]
                may[many] &= s[many] >= np.nextafter(own.astype(kind), kind(-np.inf))[:, None]
                many = many[np.count_nonzero(may[many], axis=1) > max(32, 4 * k)]
                may[many] = False
            row, col = np.divmod(np.flatnonzero(may), len(b))
            met.append((lo + rows[row], col, self._scored(np.einsum("ij,ij->i", self.x[lo + rows[row]], y[col]))))
            if len(many):  # ties: what has the smaller key is enough
                whole = self._scored(self.x[lo + rows[many]] @ y.T)
                row, col = best(whole, k)
                met.append((lo + rows[many[row]], col, whole[row, col]))
        if met:
            row, col, score = (np.concatenate(c) for c in zip(*met))
            self._keep(row, keys[col], score)

    def _scored(self, dot: np.ndarray) -> np.ndarray:
        return np.round((1 + dot) / 2 if self.cosine else dot, 9)

    def _keep(self, row: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if self.key is None:
            self.key = np.zeros(self.score.shape, key.dtype)
        changed = np.unique(row)
        at, place = np.nonzero(np.arange(self.k) < self.count[changed, None])
        at = changed[at]
        row, key, score = np.concatenate([at, row]), np.concatenate([self.key[at, place], key]), np.concatenate([self.score[at, place], score])
        order = np.lexsort((np.unique(key, return_inverse=True)[1] if key.dtype == object else key, -score, row))
        row, key, score = row[order], key[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        row, place = row[kept], place[kept]
        self.key[row, place], self.score[row, place] = key[kept], score[kept]
        self.count[changed] = np.bincount(row, minlength=len(self.count))[changed]
        full = changed[self.count[changed] == self.k]
        self.floor[full] = self.score[full, -1]

    def rows(self) -> tuple[pa.Array, list, np.ndarray]:
        at, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return self.keys.take(pa.array(at)), [] if self.key is None else self.key[at, place], self.score[at, place]


def _usable(x: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, for cosines at unit length, and which of them there are."""
    x = x.astype(np.float64)
    good = ~np.isnan(x).any(axis=1)
    if not cosine:
        return x[good], good
    norm = np.linalg.norm(x, axis=1)
    good &= norm > 0
    return x[good] / norm[good, None], good


def _large(x: np.ndarray) -> bool:
    return bool(len(x)) and not np.abs(x).max() < 1e15


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int, *, query_key: str = "qid", key: str = "id", vec: str = "embedding", mode: str = "ip", block: int = 16384
) -> DataFrame:
    """(query_key, key, raw, rank): the ``k`` best vectors of each query, ties by key.

    ``mode`` 'ip' scores by the inner product, 'cosine' by (1 + cosine) / 2; all-zero vectors have no cosine and are left
    out there.  Scores are rounded to 9 digits before ranking, so that equal vectors tie.  Vectors of another length than
    the query's never meet it, nulls never take part.

    Both sides are packed into blocks and dealt out to a grid of parts; each task reads one part of the queries and one of
    the vectors, so both are written once however often they meet, and nothing is broadcast: the join's hint says so, as the
    size that Spark sees is not that of what meets.  A task keeps ``k`` a query, so what is shuffled after it is k rows a
    query and part of the vectors.
    """
    usable = lambda df, c: df.select(F.col(c).alias("_k"), F.col(vec).alias("_v")).where("_k is not null and _v is not null and size(_v) > 0")
    data, asks = usable(vectors, key), usable(queries, query_key)
    n, m = data.count(), asks.count()
    few = max(1, block // 2)
    q = max(1, -(-m // few))
    p = max(1, -(-n // (64 * block)), min(-(-n // block), -(-4 * queries.sparkSession.sparkContext.defaultParallelism // q)))
    types = [d.schema[c].dataType.simpleString() for d, c in ((queries, query_key), (vectors, key))]
    kinds = [np.float32 if isinstance(x.schema["_v"].dataType.elementType, T.FloatType) else np.float64 for x in (asks, data)]
    asks = _pack(asks.repartition(q), few)  # even parts; each is packed again by the tasks that read it
    asks = asks.select(F.monotonically_increasing_id().alias("_b"), F.col("_d").alias("_qd"), F.col("_ks").alias("_qs"), F.col("_vs").alias("_qv"))
    met = _pack(data, block).repartition(p).join(asks.hint("shuffle_replicate_nl"), F.col("_d") == F.col("_qd"))
    ddl = f"`{query_key}` {types[0]}, `{key}` {types[1]}, raw double"
    arrow = to_arrow_schema(T._parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Found] = {}
        matrix = lambda column, i, d, kind: np.frombuffer(column[i].as_buffer(), kind).reshape(-1, d)
        for batch in batches:
            number, dims, qs, qv, ks, vs = batch.columns
            for i in range(batch.num_rows):
                b, d = number[i].as_py(), dims[i].as_py()
                if b not in found:
                    found[b] = _Found(qs[i].values, matrix(qv, i, d, kinds[0]), k, mode == "cosine")
                found[b].meet(_values(ks[i].values), matrix(vs, i, d, kinds[1]))
        for x in found.values():
            asked, keys, scores = x.rows()
            if len(asked):
                yield pa.RecordBatch.from_arrays([asked, pa.array(keys, arrow.field(1).type), pa.array(scores)], schema=arrow)

    found = met.select("_b", "_d", "_qs", "_qv", "_ks", "_vs").mapInArrow(run, ddl)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("raw"), key)))
    return ranked.where(F.col("rank") <= k)


def overfetch(hits: DataFrame, keep: Column, k: int, *, query_key: str = "qid", key: str = "id") -> DataFrame:
    """Filter hits after the search and keep ``k`` a query: what is left may be fewer than ``k``."""
    left = hits.where(keep).drop("rank")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("raw"), key))).where(F.col("rank") <= k)
