"""Most similar vectors by multi-index hashing over learned rotated binary codes (problem 5)."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, heavy_classes, join_classes, map_rows, schema_of, spread


WORDS = 3


def learn_rotations(sample: np.ndarray, count: int, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """``count`` orthogonal rotations of the sample, each iterated so that its signs lose least of the sample (d x count*d).

    Every rotation starts from another random basis of the principal axes, so their codes err independently.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    axes = np.linalg.eigh(np.cov(sample.astype(np.float64), rowvar=False).reshape(d, d))[1] if len(sample) > 1 else np.eye(d)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        if len(sample) > 1:
            v = sample @ axes
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
        out.append(axes @ r)
    return np.concatenate(out, axis=1).astype(np.float32)


def code_shape(n: int, similarity: float, miss: float, per_bucket: int = 8) -> tuple[int, int]:
    """(bits of a substring, substrings) for ``n`` vectors.

    A bucket holds about ``per_bucket`` of unrelated vectors at any n above half a million (fewer below, where 16 bits are
    used).  Two vectors of ``similarity`` agree in a sign with p = 1 - angle/pi, in a substring with p^bits, and share none
    of the substrings with probability ``miss``; so the substrings grow with about the fifth root of n at 0.9.
    """
    bits = min(32, max(16, math.ceil(math.log2(max(2, n) / per_bucket))))
    agree = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, round(math.log(miss) / math.log(1 - agree))) if agree < 1 else 1


def radius_for(bits: int, similarity: float, miss: float) -> int:
    """The Hamming radius in ``bits`` signs beyond which two vectors of ``similarity`` lie with a probability below ``miss``."""
    q = math.acos(similarity) / math.pi
    r, left = 0, 1.0
    while r < bits:
        left -= math.comb(bits, r) * q**r * (1 - q) ** (bits - r)
        if left <= miss:
            break
        r += 1
    return r


def _unit(rows: list[list[float] | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and which rows are usable: of the common length, finite, not all zero."""
    x = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        if v is not None and len(v) == dim and None not in v:
            x[i] = v
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    x[ok] /= norm[ok, None]
    return x, ok


class Codes:
    """The usable vectors of a table, their learned codes and how these are cut into substrings.

    ``rows`` holds (_k, _code array<bigint>, _same binary): words of whole substrings, ``each`` a word, the first in the
    lowest bits; ``_same`` is equal for equal unit vectors.  The rotations are fitted to about ``sample`` vectors at most,
    chosen by a hash of their keys; every vector is coded.
    """

    def __init__(self, vectors: DataFrame, key: str, embedding: str, *, similarity: float, miss: float, sample: int):
        usable = vectors.select(F.col(key).alias("_k"), F.col(embedding).cast("array<float>").alias("_v")).where("_k is not null and _v is not null and size(_v) > 0")
        lengths = usable.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.dim, self.n = (lengths["n"], lengths["count"]) if lengths else (1, 0)
        self.kind = vectors.schema[key].dataType.simpleString()
        self.floats = usable.where(F.size("_v") == self.dim)
        self.bits, self.tables = code_shape(self.n, similarity, miss)
        self.each = 64 // self.bits
        share = -(-self.n // sample) or 1
        chosen = self.floats.where(F.pmod(F.xxhash64("_k"), F.lit(share)) == 0).select("_v").collect()
        first, ok = _unit([r["_v"] for r in chosen], self.dim)
        dim, bits, tables, each = self.dim, self.bits, self.tables, self.each
        basis = learn_rotations(first[ok], -(-tables * bits // dim))[:, : tables * bits]
        weights = (1 << np.arange(bits, dtype=np.int64))[::-1]
        words = -(-tables // each)

        def run(cols: dict[str, list]):
            x, good = _unit(cols["_v"], dim)
            subs = ((x.astype(np.float32) @ basis) > 0).reshape(len(x), tables, bits) @ weights
            subs = np.pad(subs, ((0, 0), (0, words * each - tables))).reshape(len(x), words, each).astype(np.uint64)
            code = np.zeros((len(x), words), np.uint64)
            for j in range(each):
                code |= subs[:, :, j] << np.uint64(j * bits)
            code = code.view(np.int64)
            rounded = np.round(x, 6).astype(np.float32) + np.float32(0)
            for i in np.flatnonzero(good):
                yield cols["_k"][i], code[i].tolist(), hashlib.blake2b(rounded[i].tobytes(), digest_size=16).digest()

        self.rows = cut(map_rows(spread(self.floats), run, f"_k {self.kind}, _code array<bigint>, _same binary", 4096))

    def substrings(self) -> list:
        """The number of each substring among all, as an expression over ``_code``."""
        mask = F.lit((1 << self.bits) - 1)
        sub = lambda i: F.shiftrightunsigned(F.col("_code")[i // self.each], self.bits * (i % self.each)).bitwiseAND(mask)
        return [sub(i) + F.lit(i << self.bits) for i in range(self.tables)]

    def entries(self, codes: DataFrame) -> DataFrame:
        """One row a vector and substring: (_k, _word, _key)."""
        return codes.select("_k", F.col("_code")[0].alias("_word"), F.explode(F.array(*self.substrings())).alias("_key"))

    def probes(self, codes: DataFrame, radius: int) -> DataFrame:
        """(_k, _word, _key) of the substrings that differ from the vector's own in exactly ``radius`` bits, 0 or 1."""
        if not radius:
            return self.entries(codes)
        flips = F.array(*(F.lit(1 << b) for b in range(self.bits)))
        return self.entries(codes).select("_k", "_word", F.explode(F.transform(flips, lambda f: F.col("_key").bitwiseXOR(f))).alias("_key"))


def _differ(x, y):
    """Bits in which two codes differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def _cosine(p, q):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))


def _ranked_pairs(codes: Codes, met: DataFrame, index: DataFrame, asked: DataFrame, similarity: float, miss: float) -> DataFrame:
    """(_a, _b, _sim) of the pairs met in a bucket that lie within the Hamming radius by ``WORDS`` words of their codes, which
    tell as well as more would, and then within ``similarity`` by their floats."""
    radius = radius_for(codes.bits * min(WORDS * codes.each, codes.tables), similarity, miss / 1000)
    some = F.slice("_code", 1, WORDS)
    left, right = asked.select(F.col("_k").alias("_a"), some.alias("_ca")), index.select(F.col("_k").alias("_b"), some.alias("_cb"))
    near = cut(met.distinct().join(left, "_a").join(right, "_b").where(_differ(F.col("_ca"), F.col("_cb")) <= radius).select("_a", "_b"))
    va, vb = codes.floats.select(F.col("_k").alias("_a"), F.col("_v").alias("_va")), codes.floats.select(F.col("_k").alias("_b"), F.col("_v").alias("_vb"))
    return near.join(va, "_a").join(vb, "_b").select("_a", "_b", _cosine(F.col("_va"), F.col("_vb")).alias("_sim")).where(F.col("_sim") >= similarity)


def _bucket_filter(codes: Codes, x, y, similarity: float, miss: float):
    """Whether two entries of a bucket lie near enough by the one word of their codes that entries carry."""
    return F.bit_count(x.bitwiseXOR(y)) <= radius_for(codes.bits * min(codes.each, codes.tables), similarity, miss / 1000)


def similar_pairs(
    vectors: DataFrame, *, key: str = "rowid", embedding: str = "embedding", k: int = 5, min_similarity: float = 0.9, miss: float = 0.06, sample: int = 20000
) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: cosine at least ``min_similarity``, one among the other's ``k`` nearest.

    Each vector has a code of signs under learned rotations, cut into substrings, and is indexed once under each
    (``code_shape``).  Two vectors that differ in fewer bits than there are substrings share one for certain; two at exactly
    ``min_similarity`` share none with probability ``miss``, the one parameter of recall: at 0.95 in place of 0.9 the default
    is 0.002.  What meets in a bucket must lie within the Hamming radius that a pair at ``min_similarity`` leaves with a
    thousandth of ``miss``, first by one word of the codes, then by three, then by the floats.

    Null, all-zero, non-finite vectors and those not of the commonest length take no part.  Equal vectors (after scaling
    to unit length) are one entry of the index, whatever their number; of copies the smallest keys count as nearest.
    Further columns are ignored; repeated keys should not occur.
    """
    codes = Codes(vectors, key, embedding, similarity=min_similarity, miss=miss, sample=sample)
    classes = cut(codes.rows.groupBy("_same").agg(F.min(F.struct("_k", "_code")).alias("_m"), F.count("*").alias("_n")).select("_same", "_m._k", "_m._code", "_n"))
    entries = codes.entries(classes)
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, F.col("x._key") == F.col("y._key")).where("x._k < y._k").where(_bucket_filter(codes, F.col("x._word"), F.col("y._word"), min_similarity, miss))
    met = met.select(F.col("x._k").alias("_a"), F.col("y._k").alias("_b"))
    scored = cut(_ranked_pairs(codes, met, classes, classes, min_similarity, miss))

    groups = classes.where("_n > 1").select("_same", F.col("_k").alias("_c"), "_n")
    heavy = heavy_classes(groups, "_n", codes.n)
    inside = cut(join_classes(codes.rows.select("_k", "_same"), groups, "_same", heavy.select("_same")).select("_k", "_c", "_n"))
    # the first k + 1 members stand for a group of equal vectors among the neighbours of others
    first = cut(inside.withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_k"))).where(F.col("_r") <= k + 1).select("_c", F.col("_k").alias("_m")))
    both = scored.select("_a", "_b", "_sim").unionByName(scored.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "_sim"))
    options = both.join(first.withColumnRenamed("_c", "_b"), "_b", "left").select("_a", F.coalesce("_m", "_b").alias("_b"), "_sim")
    equal = join_classes(inside.select(F.col("_k").alias("_a"), "_c"), first, "_c", heavy.select("_c")).where("_a <> _m").select("_a", F.col("_m").alias("_b"), F.lit(1.0).alias("_sim"))
    # the k nearest of a vector with k copies are copies, so others are only offered to smaller groups
    mine = inside.where(F.col("_n") <= k).select(F.col("_k").alias("_x"), F.col("_c").alias("_a"))
    large = inside.where((F.col("_n") > k) & (F.col("_k") == F.col("_c"))).select(F.col("_c").alias("_a"))
    offered = options.join(large, "_a", "left_anti").join(mine, "_a", "left").select(F.coalesce("_x", "_a").alias("_a"), "_b", "_sim")
    ranked = offered.unionByName(equal).withColumn("_r", F.row_number().over(Window.partitionBy("_a").orderBy(F.desc(F.round("_sim", 9)), "_b"))).where(F.col("_r") <= k)
    return ranked.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b"), "_sim").groupBy(f"{key}_a", f"{key}_b").agg(F.max("_sim").alias("similarity"))


def nearest_of(
    vectors: DataFrame, queries: DataFrame, *, key: str = "rowid", embedding: str = "embedding", k: int = 10, settled: float = 0.9, radii: tuple[int, ...] = (0, 1),
    miss: float = 0.06, sample: int = 20000, block: int = 16384,
) -> DataFrame:
    """(query, neighbour, similarity, rank): the ``k`` rows of ``vectors`` most similar to each query, itself left out.

    The index of ``similar_pairs`` is probed with each query's substrings, then with those at rising Hamming distances
    (``radii``).  A query is settled at the first radius at which its k-th neighbour has the similarity that the index
    finds with a probability of 1 - ``miss`` or more: ``settled`` at radius 0, what one more bit reaches at radius 1.  For
    the others the radius has run out: they are compared with all vectors exactly, ``block`` queries at a time, each block
    going to every task (a bound of ``block`` vectors), whose k best of each query are merged.

    Equal similarities (to nine decimals) rank by the smaller key.  Vectors that take no part in ``similar_pairs`` take none
    here, nor do queries that are not among ``vectors``.
    """
    codes = Codes(vectors, key, embedding, similarity=settled, miss=miss, sample=sample)
    wanted = queries.select(F.col(key).alias("_k")).distinct()
    open_ = cut(codes.rows.join(wanted, "_k", "left_semi").select("_k", "_code"))
    entries = codes.entries(codes.rows)
    ddl = f"_a {codes.kind}, _b {codes.kind}, _sim double"
    done = vectors.sparkSession.createDataFrame([], ddl)
    best = Window.partitionBy("_a").orderBy(F.desc(F.round("_sim", 9)), "_b")
    for radius in radii:
        reach = _reach(codes, radius, miss) if radius else settled
        x, y = functools.reduce(DataFrame.unionByName, (codes.probes(open_, r) for r in radii if r <= radius)).alias("x"), entries.alias("y")
        met = x.join(y, F.col("x._key") == F.col("y._key")).where("x._k <> y._k").where(_bucket_filter(codes, F.col("x._word"), F.col("y._word"), reach, miss))
        found = _ranked_pairs(codes, met.select(F.col("x._k").alias("_a"), F.col("y._k").alias("_b")), codes.rows, open_, reach, miss)
        top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        full = cut(top.withColumn("_n", F.count("*").over(Window.partitionBy("_a"))).where(F.col("_n") == k).select("_a", "_b", "_sim"))
        done = done.unionByName(full)
        open_ = cut(open_.join(full.select(F.col("_a").alias("_k")).distinct(), "_k", "left_anti"))
    parts = max(1, -(-open_.count() // block))
    numbered = cut(open_.select("_k").withColumn("_p", F.pmod(F.xxhash64("_k"), F.lit(parts)).cast("int")).join(codes.floats, "_k"))
    for p in range(parts):
        asked = numbered.where(F.col("_p") == p).select("_k", "_v").toArrow()
        if asked.num_rows:
            done = done.unionByName(_scan(codes, asked["_k"].to_pylist(), asked["_v"].to_pylist(), k, ddl))
    ranked = done.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("_a").alias("query"), F.col("_b").alias("neighbour"), F.col("_sim").alias("similarity"), "rank")


def _reach(codes: Codes, radius: int, miss: float) -> float:
    """The similarity that probing within ``radius`` (1) finds with a probability of 1 - ``miss``, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        q = math.acos(middle) / math.pi
        meets = sum(math.comb(codes.bits, r) * q**r * (1 - q) ** (codes.bits - r) for r in range(radius + 1))
        low, high = (low, middle) if (1 - meets) ** codes.tables <= miss else (middle, high)
    return high


def _scan(codes: Codes, q_keys: list, q_vectors: list, k: int, ddl: str) -> DataFrame:
    """The k best of all vectors for each query of one block, once from every task."""
    dim = codes.dim
    asked, _ = _unit(q_vectors, dim)
    held = codes.floats.sparkSession.sparkContext.broadcast((asked, q_keys))
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q_keys = held.value
        own = {q: i for i, q in enumerate(q_keys)}
        best_sim = np.full((len(q_keys), k), -np.inf)
        best_key = np.empty((len(q_keys), k), object)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                keys = np.empty(piece.num_rows, object)
                keys[:] = piece.column(0).to_pylist()
                x, ok = _unit(piece.column(1).to_pylist(), dim)
                order = np.flatnonzero(ok)
                order = order[np.argsort(keys[order], kind="stable")]
                keys, x = keys[order], x[order]
                selves = [(own[key], j) for j, key in enumerate(keys) if key in own]
                for lo in range(0, len(q_keys), 1024):
                    sims = np.round(asked[lo : lo + 1024] @ x.T, 9)
                    for i, j in selves:
                        if lo <= i < lo + 1024:
                            sims[i - lo, j] = -np.inf
                    hopeful = np.flatnonzero(sims.max(1, initial=-np.inf) >= best_sim[lo : lo + 1024, -1])
                    for i in hopeful:
                        row, floor = sims[i], best_sim[lo + i, -1]
                        some = np.flatnonzero(row >= floor) if floor > -np.inf else np.argsort(-row, kind="stable")[:k]
                        some = some[np.argsort(-row[some], kind="stable")[:k]]  # equal ones by the smaller key
                        s, n = np.concatenate([best_sim[lo + i], row[some]]), np.concatenate([best_key[lo + i], keys[some]])
                        first = sorted((j for j in range(len(s)) if s[j] > -np.inf), key=lambda j: (-s[j], n[j]))[:k]
                        best_sim[lo + i, : len(first)], best_key[lo + i, : len(first)] = s[first], n[first]
        i, j = np.nonzero(best_sim > -np.inf)
        if len(i):
            cols = [q_keys[x] for x in i], best_key[i, j].tolist(), best_sim[i, j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return codes.floats.select("_k", "_v").mapInArrow(run, ddl)
