"""Mixing sources to target weights by temperature and budgeted block permutations (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER_PATH, cut, with_tokens


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Natural shares times (target / natural) to the exponent, normalised: natural shares at 0, the target at 1."""
    raw = {k: p * (target[k] / p) ** exponent if target[k] > 0 else 0.0 for k, p in natural.items() if p > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {}


def bisect_exponent(holds, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest exponent in [low, high] for which ``holds``, a condition that fails from some point on."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def weights_for_entropy(tokens: dict[str, int], goal: float) -> tuple[dict[str, float], float]:
    """Source token shares raised to a power in [0, 1] and normalised so that their entropy is ``goal`` (or the nearest it
    gets), and one minus the power: 0 leaves the natural shares, 1 makes all even."""
    total = sum(tokens.values())
    natural = {k: v / total for k, v in tokens.items() if v > 0}
    even = {k: 1 / len(natural) for k in natural}
    exponent = bisect_exponent(lambda e: entropy(tempered(natural, even, e)) <= goal)
    return tempered(natural, even, exponent), exponent


def budgets(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: float | str | None = None, goal_entropy: float | None = None) -> tuple[dict[str, float], float]:
    """Tokens to take from each source, and the exponent of the target in their weights.

    Sources without tokens or with no share take no part.  Weights are the natural token shares times (target / natural) to
    the exponent: natural shares at 0, the target at 1.  The exponent is bisected to the largest at which the repeats of
    every source suffice for ``total`` tokens ('available': as many as the sources hold).  Without ``total`` it is as many
    as the repeats allow at the exact target, so the exponent comes out as 1.  With ``goal_entropy`` the target is not
    the given shares but the natural ones raised to the power that meets this entropy.
    """
    live = {k: n for k, n in tokens.items() if n > 0 and target.get(k, 0) > 0 and repeats.get(k, 0) > 0}
    if not live:
        return {}, 1.0
    held = sum(live.values())
    natural = {k: n / held for k, n in live.items()}
    share_sum = sum(target[k] for k in live)
    goal = {k: target[k] / share_sum for k in live} if goal_entropy is None else weights_for_entropy(live, goal_entropy)[0]
    most = {k: live[k] * repeats[k] for k in live}
    size = min(most[k] / goal[k] for k in live if goal[k] > 0) if total is None else held if total == "available" else total
    fits = lambda e: all(w * size <= most[k] * (1 + 1e-9) for k, w in tempered(natural, goal, e).items())
    exponent = bisect_exponent(fits)
    return {k: min(w * size, most[k]) for k, w in tempered(natural, goal, exponent).items()}, exponent


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "index_name",
    name: str = "mix",
    share: str = "target_share",
    repeats: str = "max_repeats",
    tokenizer: str = TOKENIZER_PATH,
    total: float | str | None = None,
    goal_entropy: float | None = None,
    block_rows: int = 20000,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A selection for each mix, and the shares it reaches.

    ``selection`` (mix, source, key, copies, n_tokens) has one row per document used, ``copies`` times, at most its
    source's repeats.  ``shares`` (mix, source, target_share, max_repeats, available_tokens, n_docs, n_tokens,
    reached_share, most_copies, exponent, entropy) has one row per target, also where a source is empty (then all zero);
    ``exponent`` and the entropy of the shares reached are those of the mix, see ``budgets`` for these and ``total``.  Null texts and
    texts without tokens are not used; null shares or repeats count as 0.  Keys are taken to be unique.

    A source's documents are put in an order by hash, in blocks of about ``block_rows``; whole passes are taken first
    and the rest of the budget is filled block by block, so a source of any size is summed by its blocks.
    """
    goals = targets.select(
        F.col(name).alias("_mix"), F.col(source).alias("_s"), F.coalesce(F.col(share), F.lit(0.0)).alias("_share"), F.coalesce(F.col(repeats), F.lit(0)).alias("_max")
    )
    docs = documents.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t")).where("_t is not null")
    used = docs.join(goals.select("_s").distinct(), "_s", "left_semi")
    counted = cut(with_tokens(used, "_t", tokenizer, "_n").where("_n > 0").withColumn("_h", F.xxhash64(F.lit(seed), "_k")))
    # one number a source named in the targets
    size = {r["_s"]: (r["_n"], r["_c"]) for r in counted.groupBy("_s").agg(F.sum("_n").alias("_n"), F.count("*").alias("_c")).collect()}
    rows = goals.collect()
    wanted, exponents = [], []
    for m in sorted({r["_mix"] for r in rows if r["_mix"] is not None}):
        own = [r for r in rows if r["_mix"] == m]
        take, exponent = budgets({r["_s"]: size.get(r["_s"], (0, 0))[0] for r in own}, {r["_s"]: r["_share"] for r in own}, {r["_s"]: r["_max"] for r in own}, total, goal_entropy)
        exponents.append((m, exponent))
        for s, b in take.items():
            passes = int(b // size[s][0])
            wanted.append((m, s, passes, float(b - passes * size[s][0]), max(1, -(-size[s][1] // block_rows))))
    spark = documents.sparkSession
    asked = spark.createDataFrame(wanted, "_mix string, _s string, _passes int, _rest double, _blocks int")
    blocks = {s: n for _, s, _, _, n in wanted}
    parts = spark.createDataFrame([*blocks.items()], "_s string, _blocks int")
    placed = counted.join(parts, "_s").withColumn("_b", F.floor((F.shiftrightunsigned("_h", 1).cast("double") / F.lit(2.0**63)) * F.col("_blocks")).cast("int"))
    by_block = placed.groupBy("_s", "_b").agg(F.sum("_n").alias("_bn"))
    before = by_block.withColumn("_off", F.sum("_bn").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_bn")).select("_s", "_b", "_off")
    inside = F.sum("_n").over(Window.partitionBy("_s", "_b").orderBy(F.shiftrightunsigned("_h", 1), "_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ordered = placed.withColumn("_in", inside).join(before, ["_s", "_b"]).select("_s", "_k", "_n", (F.col("_off") + F.col("_in")).alias("_at"))
    offered = ordered.join(asked.drop("_blocks"), "_s").withColumn("_fits", F.col("_at") + F.col("_n") <= F.col("_rest"))
    # what the last block leaves open is closed by the one further document whose size comes nearest to it
    filled = offered.groupBy("_mix", "_s").agg(F.max(F.when(F.col("_fits"), F.col("_at") + F.col("_n")).otherwise(0)).alias("_sum"))
    open_ = offered.where("not _fits").join(filled, ["_mix", "_s"]).withColumn("_miss", F.abs(F.col("_rest") - F.col("_sum") - F.col("_n")))
    last = open_.where(F.col("_miss") < F.col("_rest") - F.col("_sum")).groupBy("_mix", "_s").agg(F.min(F.struct("_miss", "_at", "_k"))["_k"].alias("_last"))
    chosen = (
        offered.join(last, ["_mix", "_s"], "left")
        .withColumn("_copies", F.col("_passes") + F.when(F.col("_fits") | F.coalesce(F.col("_k") == F.col("_last"), F.lit(False)), 1).otherwise(0))
        .where("_copies > 0")
    )
    selection = chosen.select(F.col("_mix").alias(name), F.col("_s").alias(source), F.col("_k").alias(key), F.col("_copies").alias("copies"), F.col("_n").alias("n_tokens"))
    got = chosen.groupBy("_mix", "_s").agg(F.count("*").alias("_d"), F.sum(F.col("_n") * F.col("_copies")).alias("_g"), F.max("_copies").alias("_c"))
    held = spark.createDataFrame([(s, n) for s, (n, _) in size.items()], "_s string, _have long")
    shares = (
        goals.join(got, ["_mix", "_s"], "left").join(held, "_s", "left").fillna(0, ["_d", "_g", "_c", "_have"])
        .withColumn("_all", F.sum("_g").over(Window.partitionBy("_mix")))
        .withColumn("_reached", F.when(F.col("_all") > 0, F.col("_g") / F.col("_all")).otherwise(0.0))
        .withColumn("_entropy", F.sum(F.when(F.col("_reached") > 0, -F.col("_reached") * F.log("_reached")).otherwise(0.0)).over(Window.partitionBy("_mix")))
        .join(F.broadcast(spark.createDataFrame(exponents, "_mix string, _e double")), "_mix", "left")
        .select(
            F.col("_mix").alias(name), F.col("_s").alias(source), F.col("_share").alias("target_share"), F.col("_max").alias("max_repeats"),
            F.col("_have").alias("available_tokens"), F.col("_d").alias("n_docs"), F.col("_g").alias("n_tokens"),
            F.col("_reached").alias("reached_share"), F.col("_c").alias("most_copies"), F.col("_e").alias("exponent"), F.col("_entropy").alias("entropy"),
        )
    )
    return selection, shares
