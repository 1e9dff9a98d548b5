"""Near-duplicate texts by a prefix-tree join over globally ordered shingle sets (problem 6)."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, heavy_classes, join_classes, schema_of, spread

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 64-bit golden-ratio multiplier
_TOKEN_BITS = 48
_HELD = 1 << 19  # tokens of trees that a worker holds at once, and meetings of sets that it looks at
_ZSTD = pa.Codec("zstd", compression_level=1)


def shingles(texts: list[str | None], width: int, min_words: int) -> list[np.ndarray | None]:
    """Distinct 64-bit hashes of runs of ``width`` lower-cased words of each text; None below ``min_words`` words."""
    words = [t.lower().split() if t else [] for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [None] * len(texts)
    codes, vocabulary = pd.factorize(np.array(flat, dtype=object))
    hashed = pd.util.hash_array(np.asarray(vocabulary, dtype=object), categorize=False)[codes]
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            h, at = hashed[at : at + len(ws)], at + len(ws)
            if len(ws) < max(min_words, width):
                out.append(None)
                continue
            n = len(h) - width + 1
            x = np.zeros(n, np.uint64)
            for k in range(width):
                x = (x ^ h[k : k + n]) * _MIX
                x ^= x >> np.uint64(29)
            out.append(np.unique(x.view(np.int64)))
    return out


def least(size: int, threshold: float) -> int:
    """Common shingles that a set of this size needs with any partner."""
    return math.ceil(threshold * size - 1e-9)


# ---- the tree -----------------------------------------------------------------------------------------------------------


class Sets:
    """Ordered sets as one array of ranks: those of set i are ``ranks[starts[i] : starts[i + 1]]``; ``rests`` counts the
    tokens that a set has elsewhere, outside the trees it is looked at in."""

    def __init__(self, groups: list[int], sequences: list[np.ndarray], sizes: list[int], rests: list[int]):
        self.groups, self.sizes, self.rests = (np.asarray(x, np.int64) for x in (groups, sizes, rests))
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in sequences])]).astype(np.int64)
        self.ranks = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)


class Forest:
    """Prefix trees over sets, one a group; the sets come ordered by group, then lexicographically.

    A level holds the nodes at one depth: their token, the numbers of the sets below (``lo`` to ``hi``), the first ``ends`` of
    which end there, where their children begin on the next level, and bounds over the sets below: the ``small``est and
    ``large``st full size, the most tokens still to come (``left``) and the most elsewhere (``rest``).
    """

    def __init__(self, sets: Sets, token_ids: np.ndarray):
        self.levels: list[dict[str, np.ndarray]] = []
        lengths = np.diff(sets.starts)
        active, above = np.flatnonzero(lengths > 0), sets.groups
        depth = 0
        while len(active):
            token = token_ids[sets.starts[active] + depth]
            new = np.ones(len(active), bool)
            new[1:] = (above[active[1:]] != above[active[:-1]]) | (token[1:] != token[:-1])
            at = np.flatnonzero(new)
            lo = active[at]
            hi = active[np.append(at[1:], len(active)) - 1] + 1
            over = lambda f, x: f.reduceat(x[active], at)
            last = lengths[active] == depth + 1
            self.levels.append({
                "parent": above[lo], "token": token[at], "lo": lo, "hi": hi, "ends": np.add.reduceat(last.astype(np.int64), at), "left": over(np.maximum, lengths) - depth - 1,
                "small": over(np.minimum, sets.sizes), "large": over(np.maximum, sets.sizes), "rest": over(np.maximum, sets.rests),
            })
            below = np.empty(len(lengths), np.int64)
            below[active] = np.cumsum(new) - 1
            active, above = active[~last], below
            depth += 1


def join_trees(sets: Sets, probes: Sets, numbers: np.ndarray, threshold: float, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that ``meetings`` finds, at once."""
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip((none, none, none), *meetings(sets, probes, numbers, threshold, most)))


def meetings(sets: Sets, probes: Sets, numbers: np.ndarray, threshold: float, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (probe, set, overlap) of the sets later than the probe's own number in the tree of the probe's group that may
    lie within ``threshold`` of it; with nothing elsewhere they do.

    All probes go down the trees together.  The overlap with a path is counted once for all sets below it.  A subtree is left
    as soon as what it and the probe have still to come, there and elsewhere, cannot make up the overlap that its smallest
    set needs, or its sizes lie too far off.  Probes go in bundles that may meet about ``most`` sets.  What a tree finds
    may grow as the square of its sets: a batch is what a bundle finds at one depth, and no more is held.
    """
    known, ids = np.unique(np.concatenate([sets.ranks, probes.ranks]), return_inverse=True)
    ids = ids.astype(np.int64)
    forest = Forest(sets, ids[: len(sets.ranks)])
    n = len(probes.sizes)
    if not forest.levels or not n:
        return
    width = np.int64(len(known))
    held = np.repeat(np.arange(n), np.diff(probes.starts)) * width + ids[len(sets.ranks) :]
    ends = probes.starts[1:]
    # sets of each tree, for the bundles: a probe is at no more nodes of one level
    names, weights = np.unique(sets.groups[np.diff(sets.starts) > 0], return_counts=True)
    where = np.minimum(np.searchsorted(names, probes.groups), len(names) - 1)
    cost = np.where(names[where] == probes.groups, weights[where], 0)
    bundle = np.cumsum(cost) // most
    for one in np.unique(bundle):
        members = np.flatnonzero((bundle == one) & (cost > 0))
        roots = forest.levels[0]["parent"]
        first, last = np.searchsorted(roots, probes.groups[members]), np.searchsorted(roots, probes.groups[members], side="right")
        probe, node = _ranges(members, first, last - first)
        have = np.zeros(len(probe), np.int64)
        for depth, level in enumerate(forest.levels):
            if not len(probe):
                break
            want = probe * width + level["token"][node]
            at = np.searchsorted(held, want)
            hit = held[np.minimum(at, len(held) - 1)] == want
            have = have + hit
            here = have + np.minimum(ends[probe] - at - hit, level["left"][node])
            size, small = probes.sizes[probe], level["small"][node]
            keep = (here > 0) & (level["hi"][node] > numbers[probe] + 1)
            keep &= (level["large"][node] >= threshold * size - 1e-9) & (size >= threshold * small - 1e-9)
            keep &= (1 + threshold) * (here + np.minimum(probes.rests[probe], level["rest"][node])) >= threshold * (size + small) - 1e-6
            probe, node, have = probe[keep], node[keep], have[keep]
            done = (level["ends"][node] > 0) & (have > 0)
            p, j = _ranges(np.flatnonzero(done), level["lo"][node[done]], level["ends"][node[done]])
            p, h = probe[p], have[p]
            good = (j > numbers[p]) & ((1 + threshold) * (h + np.minimum(probes.rests[p], sets.rests[j])) >= threshold * (probes.sizes[p] + sets.sizes[j]) - 1e-6)
            if good.any():
                yield p[good], j[good], h[good]
            if depth + 1 < len(forest.levels):
                parent = forest.levels[depth + 1]["parent"]
                first, last = np.searchsorted(parent, node), np.searchsorted(parent, node, side="right")
                back, node = _ranges(np.arange(len(node)), first, last - first)
                probe, have = probe[back], have[back]


def _slices(batches: Iterable[tuple[np.ndarray, ...]], rows: int = 1 << 15) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in batches that can be made lists of."""
    for batch in batches:
        for at in range(0, len(batch[0]), rows):
            yield tuple(x[at : at + rows] for x in batch)


def _ranges(names: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name with each number of its range, ``counts`` from ``first`` on."""
    at = np.repeat(first - np.cumsum(counts) + counts, counts)
    return np.repeat(names, counts), at + np.arange(len(at))


# ---- packed pieces ------------------------------------------------------------------------------------------------------


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays by planes of their bytes, compressed."""
    raw = pickle.dumps([(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()) for a in arrays])
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _expand(data: bytes) -> list[np.ndarray]:
    raw = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, n).T).reshape(-1).view(t) for t, n, b in pickle.loads(raw)]


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> np.uint64(_TOKEN_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _class_of(df: np.ndarray) -> np.ndarray:
    """The place of a frequency in the global order, in a byte: exact to 200, by eighths of an octave above."""
    high = 200 + np.minimum(55, 8 * np.log2(np.maximum(df, 200) / 200)).astype(np.int64)
    return np.where(df < 200, df, high).astype(np.uint64)


def _home_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for the first two documents that hold a token; where two pairs get the same number they share a tree."""
    with np.errstate(over="ignore"):
        x = (first.astype(np.uint64) * _MIX ^ second.astype(np.uint64)) * _MIX
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _ranks_bytes(ranks: np.ndarray) -> bytes:
    """Ranks of 56 bits, highest byte first, so that comparing bytes compares sequences of ranks."""
    return np.ascontiguousarray(ranks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def _ranks_of(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 7, 8), np.uint8)
    raw[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return raw.reshape(-1).view(">u8").astype(np.uint64)


def _mapped(df: DataFrame, rows, ddl: str) -> DataFrame:
    """mapInArrow by a generator from an iterator of row tuples to row tuples; rows leave in batches bounded by their bytes."""
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                cols = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in cols)

        out, weight = [], 0
        for row in rows(each()):
            out.append(row)
            weight += 64 + sum(len(x) for x in row if isinstance(x, (bytes, list)))
            if weight > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, weight = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, ddl)


# ---- the join -----------------------------------------------------------------------------------------------------------


def near_duplicates(
    documents: DataFrame, *, key: str = "doc_id", text: str = "full_text", width: int = 5, threshold: float = 0.8, min_words: int = 40,
    block_tokens: int = 1 << 20, range_tokens: int = 1 << 21, dense: int = 16, tree_sets: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the copies of each text.

    Returns ``links`` (key_a, key_b, similarity) with key_a < key_b, over one representative (the smallest key) per
    distinct text, complete for every pair whose sets of ``width``-word shingles have at least ``threshold`` of their
    union in common; and ``members`` (key, rep) with one row per document that has ``min_words`` words.  Null texts and
    shorter texts appear in neither.  A repeated key counts once, with the least of its texts.

    Shingles are 48-bit tokens, ordered by their frequency, rarest first; one that occurs once cannot be shared and only
    counts in the size.  Texts are shingled once, in blocks of about ``block_tokens`` tokens.  A block sends its tokens to
    ranges of about ``range_tokens``; a range sends each shared token back to its blocks, with its place in the global order
    and its home, the first two documents that hold it.  So each set becomes a sequence in the global order, and the prefix of
    it that must hold a token shared with any partner is known.

    The tree over these prefixes is spread by the homes of its edges: a home has a tree of the tokens at home there, so each
    token of a prefix goes to one place.  Each set traverses the trees it is in: overlaps with a path are counted once for
    all sets below it, and subtrees are left by what remains in them and elsewhere.  The overlaps of a pair in all
    homes are added up; pairs whose prefixes share as much as they must meet with their whole sequences in the tree of the
    first of them.  A home of more than ``tree_sets`` sets is split into parts that meet in pairs.

    A token held by ``dense`` documents of a block leaves it once, with their count.  The parameters after ``min_words``
    change cost alone, not results.  ``documents`` must give the same rows when read again.
    """
    key_type = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_k").isNotNull() & (F.length("_t") >= 2 * min_words - 1))
    if documents.groupBy(key).count().where("count > 1").limit(1).count():
        docs = docs.groupBy("_k").agg(F.min("_t").alias("_t"))
    letters = docs.agg(F.sum(F.length("_t"))).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(letters / 6 / range_tokens))

    def to_blocks(rows: Iterable[tuple]) -> Iterator[tuple]:
        """Of each block: its tokens by range, and one row of its keys (range -1)."""
        task, number = TaskContext.get().partitionId(), 0
        keys, digests, sets, n = [], [], [], 0

        def flush() -> Iterator[tuple]:
            block = (task << 16) + number
            first: dict[bytes, int] = {}
            for i, h in enumerate(digests):
                if h not in first or keys[i] < keys[first[h]]:
                    first[h] = i
            mine = sorted(first.values())
            if len(mine) > 1 << 16 or number >= 1 << 16:
                raise OverflowError("more blocks or documents in a block than their numbers have room for")
            ids = np.repeat(np.arange(len(mine), dtype=np.uint16), [len(sets[i]) for i in mine])
            tokens = np.concatenate([sets[i] for i in mine])
            order = np.argsort(tokens, kind="stable")
            tokens, ids = tokens[order], ids[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(starts, len(tokens)))
            many = counts >= dense
            held = np.repeat(many, counts)
            lists = (tokens[starts[many]], counts[many], ids[held])
            keep = ~held
            keep[starts[many]] = True
            times = np.ones(len(tokens), np.uint32)
            times[starts[many]] = counts[many]
            tokens, ids, times = tokens[keep], ids[keep], times[keep]
            which = _range_of(tokens, ranges)
            edges = np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))
            for r in range(ranges):
                a, b = edges[r], edges[r + 1]
                if a < b:
                    at = np.flatnonzero(times[a:b] > 1).astype(np.uint32)
                    yield r, block, r, _squeeze(np.diff(tokens[a:b], prepend=np.uint64(0)), ids[a:b], at, times[a:b][at]), None
            sizes = np.array([len(sets[i]) for i in mine], np.int64)
            yield block % ranges, block, -1, pickle.dumps((b"".join(digests), np.array(mine), sizes, *lists)), list(keys)

        texts: list[tuple] = []

        def more() -> None:
            nonlocal n
            for (k, t), s in zip(texts, shingles([t for _, t in texts], width, min_words)):
                if s is not None:
                    keys.append(k)
                    digests.append(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    sets.append(np.unique(s.view(np.uint64) >> np.uint64(64 - _TOKEN_BITS)))
                    n += len(s)
            texts.clear()

        waiting = 0
        for row in rows:
            texts.append(row)
            waiting += len(row[1])
            if waiting > 1 << 20:
                more()
                waiting = 0
                if n >= block_tokens or len(keys) >= 1 << 15:
                    yield from flush()
                    keys, digests, sets, n, number = [], [], [], 0, number + 1
        more()
        if keys:
            yield from flush()

    def to_shared(rows: Iterable[tuple]) -> Iterator[tuple]:
        """Back to each block: its shared tokens of a range, their places in the order and their homes."""
        by_range: dict[int, list[tuple[int, bytes]]] = {}
        for _, block, r, data, keys in rows:
            if r < 0:
                yield block, data, keys
            else:
                by_range.setdefault(r, []).append((block, data))
        for pieces in by_range.values():
            pieces.sort()  # by block: so a stable sort by token leaves the documents of a token in their order
            blocks = np.array([b for b, _ in pieces], np.int64)
            parts = [_expand(d) for _, d in pieces]
            lengths = [len(p[0]) for p in parts]
            tokens = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            ids = np.concatenate([p[1] for p in parts])
            times = np.ones(len(tokens), np.uint32)
            for at, p in zip(np.cumsum([0, *lengths]), parts):
                times[at + p[2].astype(np.int64)] = p[3]
            of = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
            del parts
            order = np.argsort(tokens, kind="stable")
            t = tokens[order]
            del tokens
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            n = np.diff(np.append(starts, len(t)))
            df = np.add.reduceat(times[order], starts, dtype=np.int64)
            place = lambda at: (blocks[of[at]] << 16) | ids[at]
            home = _home_of(place(order[starts]), place(order[np.minimum(starts + 1, starts + n - 1)]))
            del starts
            many = df > 1
            shared = np.repeat(many, n)
            chosen, t, n = order[shared], t[shared], n[many]
            del order, shared
            rank = (np.repeat(_class_of(df[many]), n) << np.uint64(_TOKEN_BITS)) | t
            at_home = np.repeat(home[many], n)
            del t, df, home
            back = np.lexsort((rank, at_home, (of[chosen].astype(np.int64) << 16) | ids[chosen]))
            chosen, rank, at_home = chosen[back], rank[back], at_home[back]
            del back
            edges = np.searchsorted(of[chosen], np.arange(len(pieces) + 1))
            for i in range(len(pieces)):
                a, b = edges[i], edges[i + 1]
                if a < b:
                    whole = times[chosen[a:b]] > 1
                    one = ~whole
                    yield int(blocks[i]), _squeeze(ids[chosen[a:b]][one], rank[a:b][one], at_home[a:b][one], rank[a:b][whole], at_home[a:b][whole]), None

    def to_sets(rows: Iterable[tuple]) -> Iterator[tuple]:
        """One row of each document (home null), with its sequence if it may have a partner; of those also the parts of
        the prefix, each with its home."""
        current, pieces, head = None, [], None

        def flush() -> Iterator[tuple]:
            digests, mine, sizes, d_tokens, d_counts, d_ids = pickle.loads(head[0])
            keys = head[1]
            digest = lambda i: digests[16 * i : 16 * i + 16]
            chosen: dict[int, int] = {}
            parts = [_expand(p) for p in pieces]
            if parts:
                ids, rank, home = (np.concatenate([p[i] for p in parts]) for i in range(3))
                d_rank, d_home = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
                if len(d_rank):
                    at = np.searchsorted(d_tokens, d_rank & np.uint64((1 << _TOKEN_BITS) - 1))
                    ends = np.cumsum(d_counts)
                    ids = np.concatenate([ids, *(d_ids[ends[i] - d_counts[i] : ends[i]] for i in at)])
                    rank = np.concatenate([rank, np.repeat(d_rank, d_counts[at])])
                    home = np.concatenate([home, np.repeat(d_home, d_counts[at])])
                order = np.lexsort((rank, ids))
                ids, rank, home = ids[order], rank[order], home[order]
                edges = np.searchsorted(ids, np.arange(len(mine) + 1))
                need = np.maximum(1, np.ceil(threshold * sizes - 1e-9).astype(np.int64))
                chosen = {int(mine[i]): int(i) for i in np.flatnonzero(np.diff(edges) >= need)}
            for j, k in enumerate(keys):
                i = chosen.get(j)
                if i is None:
                    yield None, k, digest(j), None, None, None, None
                    continue
                a, b = edges[i], edges[i + 1]
                yield None, k, digest(j), int(sizes[i]), _ranks_bytes(rank[a:b]), None, None
                to = b - need[i] + 1
                back = np.lexsort((rank[a:to], home[a:to]))
                h, r = home[a:to][back], rank[a:to][back]
                cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
                for x, y in zip(cuts, cuts[1:]):
                    yield int(h[x]), k, digest(j), int(sizes[i]), _ranks_bytes(r[x:y]), int(rank[to - 1]), int(b - a - (y - x))

        for block, data, keys in rows:
            if block != current:
                if head is not None:
                    yield from flush()
                current, pieces, head = block, [], None
            if keys is None:
                pieces.append(data)
            else:
                head = (data, keys)
        if head is not None:
            yield from flush()

    blocks = _mapped(spread(docs), to_blocks, f"_to int, _block long, _range int, _data binary, _keys array<{key_type}>")
    replies = _mapped(blocks.repartitionById(ranges, F.col("_to")), to_shared, f"_block long, _data binary, _keys array<{key_type}>")
    grouped = replies.repartition("_block").sortWithinPartitions("_block")
    found = cut(_mapped(grouped, to_sets, f"_home long, _k {key_type}, _digest binary, _size int, _ranks binary, _last long, _rest int"))
    met = cut(_meet(found.where("_home is not null"), key_type, threshold, tree_sets))
    return _settle(met, found.where("_home is null and _ranks is not null"), key, key_type, threshold), _members(found.where("_home is null"), key)


def _members(rows: DataFrame, key: str) -> DataFrame:
    """(key, rep) of every document."""
    classes = cut(rows.groupBy("_digest").agg(F.min("_k").alias("_rep"), F.count("*").alias("_n")))
    heavy = heavy_classes(classes, "_n", rows.count())
    return join_classes(rows.select("_k", "_digest"), classes, "_digest", heavy).select(F.col("_k").alias(key), F.col("_rep").alias("rep"))


def _meet(prefixes: DataFrame, key_type: str, threshold: float, tree_sets: int) -> DataFrame:
    """(_a, _b), _a < _b, of the sets whose prefixes share as many tokens as a pair within the threshold must."""
    homes = prefixes.groupBy("_home").agg(F.count("*").alias("_n"), (F.sum(F.length("_ranks")) / 7).alias("_tokens")).where("_n > 1")
    split = prefixes.join(homes, "_home").withColumn("_parts", F.ceil(F.greatest(F.col("_n") / tree_sets, F.col("_tokens") / _HELD)).cast("int"))
    # copies of one text fall into one part, so that one of them stands for all
    split = split.withColumn("_part", F.pmod(F.xxhash64("_digest"), F.col("_parts")).cast("int"))
    met = split.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    met = met.select("_home", F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j"), "_part", "_digest", "_k", "_size", "_ranks", "_last", "_rest")
    met = met.repartition("_home", "_i", "_j").sortWithinPartitions("_home", "_i", "_j", "_digest", "_k")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        current, last_digest, number, tokens = None, None, -1, 0
        batch: list[tuple] = []

        def flush() -> Iterator[tuple]:
            batch.sort(key=lambda s: (s[0], s[5]))
            groups, across, parts, keys, sizes, packed, lasts, rests = zip(*batch)
            batch.clear()
            sets = Sets(groups, [_ranks_of(x) for x in packed], sizes, rests)
            del groups, sizes, packed, rests
            across, parts, lasts = (np.asarray(x) for x in (across, parts, lasts))
            need = np.ceil(threshold * sets.sizes - 1e-9).astype(np.int64)
            for p, j, have in _slices(meetings(sets, sets, np.arange(len(keys)), threshold, _HELD)):
                ok = ~(across[p] & (parts[p] == parts[j]))
                p, j, have = p[ok], j[ok], have[ok]
                # beyond its last prefix token the set whose prefix ends first has one token less than it needs
                beyond = np.where(lasts[p] < lasts[j], need[p], np.where(lasts[j] < lasts[p], need[j], np.minimum(need[p], need[j]))) - 1
                common = np.ceil(threshold / (1 + threshold) * (sets.sizes[p] + sets.sizes[j]) - 1e-6).astype(np.int64)
                for x, y, h, m in zip(p.tolist(), j.tolist(), have.tolist(), (common - beyond).tolist()):
                    yield min(keys[x], keys[y]), max(keys[x], keys[y]), h, m

        for home, i, j, part, digest, k, size, data, last, rest in rows:
            if (home, i, j) != current:
                if tokens > _HELD or len(batch) > _HELD >> 3:
                    yield from flush()
                    tokens = 0
                current, last_digest, number = (home, i, j), None, number + 1
            if digest != last_digest:  # the first of equal digests has the least key
                batch.append((number, i != j, part, k, size, data, last, rest))
                last_digest, tokens = digest, tokens + len(data) // 7
        if batch:
            yield from flush()

    shared = _mapped(met, run, f"_a {key_type}, _b {key_type}, _have int, _least int")
    return shared.groupBy("_a", "_b").agg(F.sum("_have").alias("_have"), F.max("_least").alias("_least")).where("_have >= _least").select("_a", "_b")


def _settle(pairs: DataFrame, sets: DataFrame, key: str, key_type: str, threshold: float) -> DataFrame:
    """Exact overlaps of pairs: each probe meets the tree of its candidates."""
    full = sets.select("_k", "_size", "_ranks")
    rows = (
        pairs.join(full, F.col("_b") == F.col("_k")).select("_a", F.lit(True).alias("_c"), "_k", "_size", "_ranks")
    ).unionByName(
        pairs.select("_a").distinct().join(full, F.col("_a") == F.col("_k")).select("_a", F.lit(False).alias("_c"), "_k", "_size", "_ranks")
    )
    rows = rows.repartition("_a").sortWithinPartitions("_a", "_c", "_k")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        probes: list[tuple] = []
        group: list[tuple] = []
        tokens = 0

        def flush() -> Iterator[tuple]:
            group.sort(key=lambda s: (s[0], s[3]))
            sets = Sets([s[0] for s in group], [_ranks_of(s[3]) for s in group], [s[2] for s in group], [0] * len(group))
            own = Sets([*range(len(probes))], [_ranks_of(s[2]) for s in probes], [s[1] for s in probes], [0] * len(probes))
            for p, j, both in _slices(meetings(sets, own, np.full(len(probes), -1), threshold, _HELD)):
                for x, y, b in zip(p.tolist(), j.tolist(), both.tolist()):
                    yield probes[x][0], group[y][1], b / (probes[x][1] + group[y][2] - b)

        for _, candidate, k, size, data in rows:
            if tokens > _HELD:
                yield from flush()
                probes, group, tokens = ([] if not candidate else probes[-1:]), [], 0
            if not candidate:
                probes.append((k, size, data))
            else:
                group.append((len(probes) - 1, k, size, data))
            tokens += len(data) // 7
        if group:
            yield from flush()

    return _mapped(rows, run, f"`{key}_a` {key_type}, `{key}_b` {key_type}, similarity double")


def all_pairs(links: DataFrame, members: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every pair (key_a, key_b) of documents that ``near_duplicates`` found alike: each copy with each, and each copy of
    one text with each copy of a text linked to it.

    This is the whole list, of as many rows as there are pairs; ``links`` and ``members`` say the same in one row a
    document and one a pair of texts.
    """
    a, b = f"{key}_a", f"{key}_b"
    x, y = members.select("rep", F.col(key).alias("_x")), members.select("rep", F.col(key).alias("_y"))
    inside = x.join(y, "rep").where("_x < _y").select(F.col("_x").alias(a), F.col("_y").alias(b))
    across = links.join(x.withColumnRenamed("rep", a), a).join(y.withColumnRenamed("rep", b), b)
    return inside.unionByName(across.select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b)))
