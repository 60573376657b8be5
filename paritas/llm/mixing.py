"""Mixing sources to target weights by a temperature.

The token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are),
found by bisection, and the normalised weights are realised as prefixes of block permutations.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Blocks of each source; documents fall into them by a hash, and a source is read block by block.
BLOCKS = 512
SEED = 13
STEPS = 60


class Mix(NamedTuple):
    """The chosen exponent and per source its weight, budget of tokens and passes over its tokens."""

    exponent: float
    sources: dict[str | None, tuple[float, float, float]]


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent for s, n in tokens.items() if n > 0}
    norm = sum(powers.values())
    return {s: p / norm for s, p in powers.items()}


def entropy(shares: dict) -> float:
    return -sum(w * math.log(w) for w in shares.values() if w > 0)


def solve(tokens: dict, budget: float | str | None = None, max_passes: float | None = None,
          target_entropy: float | None = None) -> Mix:
    """The exponent for the given limits, by bisection.

    ``max_passes`` asks for an exponent large enough that no source is read more often than that,
    ``target_entropy`` for one small enough that the weights' entropy is at least that share of the most
    possible. The exponent is the smallest one for the first condition or the largest one for the
    second; the larger of the two where both are given, so that the limit of passes always holds that
    exponent 1 can keep. ``budget`` is the tokens of the mix: those of the corpus, or with "cover" as
    many as read the largest source once and so no source less.
    """
    empty = {s: (0.0, 0.5, 1.0) for s, n in tokens.items() if not n > 0}
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens:
        return Mix(1.0, empty)

    def size(shares: dict) -> float:
        if budget == "cover":
            return max(tokens[s] / w for s, w in shares.items())
        return sum(tokens.values()) if budget is None else budget

    def passes(exponent: float) -> float:
        shares = weights(tokens, exponent)
        return max(size(shares) * w / tokens[s] for s, w in shares.items())

    def enough_entropy(exponent: float) -> bool:
        return entropy(weights(tokens, exponent)) >= target_entropy * math.log(len(tokens)) - 1e-12

    def bisect(holds, low: float, high: float) -> float:
        """Between ``low``, where the condition fails, and ``high``, where it holds."""
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(middle) else (middle, high)
        return high

    found = []
    if max_passes is not None:
        found.append(0.0 if passes(0.0) <= max_passes else bisect(lambda e: passes(e) <= max_passes, 0.0, 1.0))
    if target_entropy is not None:
        found.append(1.0 if enough_entropy(1.0) else 1.0 - bisect(lambda e: enough_entropy(1.0 - e), 0.0, 1.0))
    exponent = max(found, default=1.0)
    shares = weights(tokens, exponent)
    total = size(shares)
    return Mix(exponent, {s: (w, total * w, total * w / tokens[s]) for s, w in shares.items()} | empty)


def mix(docs: DataFrame, tokens: str, budget: float | str | None = None, max_passes: float | None = None,
        target_entropy: float | None = None) -> DataFrame:
    """``docs`` as often as its source's budget reads it, with mix_pass (from 0), mix_block (place of
    its block in the permutation) and mix_weight.

    ``docs`` needs doc_id, source (null is a source of its own) and a column of token counts (null
    counts as 0). A source is read in passes, each a permutation of its blocks, inside a block by a hash of the
    id; it ends with the document that reaches its budget. Documents without tokens come with the
    pass that reads their place. Only one row per source comes to the driver. Repeated rows are read
    each; no rows give none.
    """
    size = F.coalesce(F.col(tokens), F.lit(0))
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(BLOCKS))
    placed = docs.withColumn("_mix_block", block).withColumn("_mix_size", size.cast("long"))
    per_block = settled(placed.groupBy("source", "_mix_block").agg(F.sum("_mix_size").alias("_mix_in_block")),
                        "mix-blocks")
    totals = {r.source: r.n for r in per_block.groupBy("source").agg(F.sum("_mix_in_block").alias("n")).collect()}
    chosen = solve(totals, budget, max_passes, target_entropy)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(s, w, b, int(math.ceil(p - 1e-9)), float(totals[s])) for s, (w, b, p) in chosen.sources.items()],
        "source string, mix_weight double, _mix_budget double, _mix_passes int, _mix_total double")

    cells = per_block.alias("a").join(plan.alias("b"), F.expr("a.source <=> b.source")).select(
        F.col("a.source").alias("_mix_source"), "_mix_block", "_mix_in_block", "mix_weight", "_mix_budget", "_mix_total",
        F.explode(F.sequence(F.lit(0), F.greatest(F.col("_mix_passes"), F.lit(1)) - 1)).alias("mix_pass"))
    # a source has BLOCKS cells in each pass, so its windows are bounded
    order = Window.partitionBy("_mix_source", "mix_pass").orderBy(
        F.xxhash64("_mix_block", "mix_pass", F.lit(SEED)), "_mix_block")
    before = F.coalesce(F.sum("_mix_in_block").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("mix_block", F.row_number().over(order).cast("int") - 1).withColumn(
        "_mix_left", F.col("_mix_budget") - F.col("mix_pass") * F.col("_mix_total") - before)
    cells = cells.where(F.col("_mix_left") > 0).withColumn(
        "_mix_whole", F.col("_mix_left") >= F.col("_mix_in_block") - 0.5)
    read = placed.join(cells.drop("_mix_in_block", "_mix_budget", "_mix_total").withColumnRenamed("_mix_block", "_mix_b"),
                       placed.source.eqNullSafe(F.col("_mix_source")) & (placed["_mix_block"] == F.col("_mix_b")))
    whole = read.where("_mix_whole")
    # the one block in which a source's budget ends
    inside = Window.partitionBy("_mix_source", "mix_pass", "_mix_block").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id")
    ends = read.where("not _mix_whole").withColumn(
        "_mix_before", F.coalesce(F.sum("_mix_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.where(F.col("_mix_before") < F.col("_mix_left")).drop("_mix_before")
    return whole.union(ends).select(*docs.columns, "mix_pass", "mix_block", "mix_weight")
