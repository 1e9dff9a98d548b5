"""Filling containers of fixed capacity by exact complements, then best fit (problem 8)."""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER_PATH, cut, map_rows, with_tokens


def _complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to ``gap``; the longest first part is preferred."""
    if have[gap] > 0:
        return (gap,)
    sizes = np.flatnonzero(have[: gap + 1])[::-1]
    pair = _pair(have, sizes, gap)
    if pair:
        return pair
    for a in sizes:
        a = int(a)
        if 3 * a < gap:
            break
        have[a] -= 1
        rest = _pair(have, sizes[sizes <= a], gap - a) if gap - a > 1 else None
        have[a] += 1
        if rest:
            return (a, *rest)
    return None


def _pair(have: np.ndarray, sizes: np.ndarray, gap: int) -> tuple[int, int] | None:
    a = sizes[(sizes < gap) & (2 * sizes >= gap)]
    b = gap - a
    ok = (have[a] > 0) & (have[b] > 0) & ((a != b) | (have[a] > 1))
    if not ok.any():
        return None
    i = int(np.argmax(ok))
    return int(a[i]), int(b[i])


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of containers, lengths in each) using every item of ``counts`` (length -> items) once.

    Works on the histogram alone, which has at most ``capacity`` entries whatever the number of items.  Exact stage: the
    longest length left is completed by a single, a pair or a triple that fills its gap exactly, for as many containers
    at once as the items allow.  What has no exact complement goes, longest first, into the open container whose gap it
    fits best.
    """
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    done: list[tuple[int, tuple[int, ...]]] = []
    rest: Counter[int] = Counter()
    if have[capacity]:
        done.append((int(have[capacity]), (capacity,)))
        have[capacity] = 0
    for size in range(capacity - 1, 0, -1):
        while have[size] > 0:
            have[size] -= 1
            found = _complement(have, capacity - size)
            have[size] += 1
            if not found:
                rest[size] = int(have[size])
                have[size] = 0
                break
            used = Counter((size, *found))
            times = min(int(have[k]) // v for k, v in used.items())
            for k, v in used.items():
                have[k] -= times * v
            done.append((times, (size, *found)))
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []

    def keep(gap: int, times: int, content: tuple[int, ...]) -> None:
        if gap not in open_bins:
            open_bins[gap] = []
            bisect.insort(gaps, gap)
        open_bins[gap].append((times, content))

    for size in sorted(rest, reverse=True):
        left = rest[size]
        while left:
            i = bisect.bisect_left(gaps, size)
            if i == len(gaps):
                each = max(1, capacity // size)
                if left // each:
                    keep(capacity - each * size, left // each, (size,) * each)
                if left % each:
                    keep(capacity - (left % each) * size, 1, (size,) * (left % each))
                break
            gap = gaps[i]
            times, content = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[i]
            each = min(gap // size, left)
            n = min(times, left // each)
            keep(gap - each * size, n, content + (size,) * each)
            if times > n:
                keep(gap, times - n, content)
            left -= n * each
    return done + [b for group in open_bins.values() for b in group]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where runs of items start (by rank), the first container of each run, items per container."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    first = 0
    for times, content in patterns:
        for size, each in Counter(content).items():
            out.setdefault(size, []).append((taken[size], first, each))
            taken[size] += times * each
        first += times
    return {k: tuple(np.asarray(x) for x in zip(*v)) for k, v in out.items()}


def pack(
    documents: DataFrame,
    packs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    kind: str = "doc_type",
    name: str = "pack",
    capacity: str = "capacity",
    tokenizer: str = TOKENIZER_PATH,
    per_salt: int = 20000,
) -> DataFrame:
    """(pack, container, key, part, start_token, n_tokens): the container of every document, or part of one, in each pack.

    A text of more tokens than the capacity is divided into parts of the capacity and a remainder; no other is divided.
    Containers are numbered from 0 in each pack.  A text without tokens takes no room and has container null; a null
    text, or a kind without a pack, gives no rows; packs of null or non-positive capacity are ignored.  Repeated keys are
    packed as often as they occur.  Columns beyond those named are ignored.

    The driver sees only how many items there are of each length, at most ``capacity`` numbers a pack; which item takes
    which place follows from its rank among the items of its length, counted in independent parts by a hash of key and
    part, as many as keep about ``per_salt`` items in each though all had one length.
    """
    key_type = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("_k"), F.col(kind).alias("_kind"), F.col(text).alias("_t")).where("_t is not null")
    sizes = packs.select(F.col(name).alias("_pack"), F.col(capacity).alias("_cap"), F.col(kind).alias("_kind")).where("_cap > 0")
    counted = cut(with_tokens(docs.join(sizes.select("_kind").distinct(), "_kind", "left_semi"), "_t", tokenizer, "_n"))
    held = counted.agg(F.count("*").alias("c"), F.sum("_n").alias("n")).first()
    least_cap = sizes.agg(F.min("_cap")).first()[0] or 1
    salts = max(16, ((held["n"] or 0) // least_cap + held["c"]) // per_salt + 1)
    items = (
        counted.join(sizes, "_kind")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / F.col("_cap")) - 1).cast("int"))))
        .withColumn("_start", F.col("_part").cast("long") * F.col("_cap"))
        .withColumn("_size", F.least(F.col("_cap").cast("long"), F.col("_n") - F.col("_start")))
        .withColumn("_salt", F.pmod(F.xxhash64("_k", "_part"), F.lit(salts)).cast("int"))
    )
    items = items.where("_size > 0")
    groups = items.groupBy("_pack", "_cap", "_size", "_salt").agg(F.count("*").alias("_c"))
    totals = groups.groupBy("_pack", "_cap", "_size").agg(F.sum("_c").alias("_c")).collect()
    by_pack: dict[tuple[str, int], dict[int, int]] = {}
    for r in totals:
        by_pack.setdefault((r["_pack"], r["_cap"]), {})[r["_size"]] = r["_c"]
    where = {p: slots(plan(counts, cap)) for (p, cap), counts in by_pack.items()}
    offsets = groups.withColumn(
        "_off", F.sum("_c").over(Window.partitionBy("_pack", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_pack", "_size", "_salt", F.coalesce("_off", F.lit(0)).alias("_off"))
    ranked = (
        items.withColumn("_rn", F.row_number().over(Window.partitionBy("_pack", "_size", "_salt").orderBy("_k", "_part")) - 1)
        .join(offsets, ["_pack", "_size", "_salt"])
        .select("_pack", "_k", "_part", "_start", "_size", (F.col("_off") + F.col("_rn")).alias("_rank"))
    )

    def place(cols: dict[str, list]):
        for p, k, part, start, size, rank in zip(*(cols[c] for c in ("_pack", "_k", "_part", "_start", "_size", "_rank"))):
            begin, first, each = where[p][size]
            i = int(np.searchsorted(begin, rank, side="right")) - 1
            yield p, int(first[i] + (rank - begin[i]) // each[i]), k, part, start, size

    placed = map_rows(ranked, place, f"`{name}` string, container bigint, `{key}` {key_type}, part int, start_token bigint, n_tokens bigint", 4096)
    empty = counted.where("_n = 0").join(sizes, "_kind").select(
        F.col("_pack").alias(name), F.lit(None).cast("long").alias("container"), F.col("_k").alias(key),
        F.lit(0).alias("part"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"),
    )
    return placed.unionByName(empty)
