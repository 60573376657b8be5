"""Exact order statistics per key without ever holding a group in one task.

Spark's ``percentile`` and ``median`` keep all distinct values of a group in one buffer, which a
key with a third of all rows would overflow. Here the values are counted first and the wanted
ranks are then located in two rounds of bucket counts: a logarithmic grid over all doubles, which
has some seventy thousand cells, then an even grid of sixteen million cells inside the cells that
hold a wanted rank. A cell of the second grid spans some sixteen million doubles at most. Every
window below is thus bounded whatever the size of the group, and streams over sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, fold_nan, to_numeric, typed

_CELLS_PER_OCTAVE = 16
_OFFSET = 20_000  # beyond the lowest logarithm of a double, 1074 octaves below one
_INFINITY_CELL = 100_000
_FINE_CELLS = 1 << 24


def _coarse(v: Column) -> Column:
    """Cell number that never decreases with the value."""
    size = F.abs(v)
    cell = F.when(size == float("inf"), _INFINITY_CELL).otherwise(
        F.floor(F.log2(size) * _CELLS_PER_OCTAVE).cast("int") + _OFFSET
    )
    # Declared free of NULLs: otherwise the joins below would add filters that differ from branch
    # to branch, and the counted values could not be shared between them.
    return F.coalesce(F.when(v > 0, cell).when(v < 0, -cell), F.lit(0))


def _fine(v: Column, low: Column, high: Column) -> Column:
    share = (v - low) / (high - low)
    return F.coalesce(F.when(high > low, F.floor(share * _FINE_CELLS).cast("int")), F.lit(0))


def _holding(
    cells: DataFrame, group: list[Column], order: str, wanted: Column, keep: list[Column]
) -> DataFrame:
    """Cells that hold a wanted rank: ``keep`` and the ranks made relative to the cell."""
    upto = F.sum("_count").over(
        Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.col("_upto") - F.col("_count")

    def inside(t: Column) -> Column:
        return (t.rank >= before) & (t.rank < F.col("_upto"))

    relative = F.transform(F.filter(wanted, inside), lambda t: t.withField("rank", t.rank - before))
    placed = cells.select("*", upto.alias("_upto")).where(F.exists(wanted, inside))
    return placed.select(*keep, relative.alias("_wanted"))


def _ranks(quantiles: Iterable[float]) -> Column:
    """Lower and upper rank of every quantile among ``_n`` values, and the share between them."""
    slots = []
    for place, q in enumerate(quantiles):
        position = (F.col("_n") - 1) * q
        for side, rank in enumerate((F.floor(position), F.ceil(position))):
            slots.append(F.struct(F.lit(2 * place + side).alias("slot"), rank.alias("rank"),
                                  (position - F.floor(position)).alias("share")))
    return F.array(*slots)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """One row per key with a column per entry of ``quantiles``, linearly interpolated.

    Keys must not be NULL. Missing values do not count; a key without values gets no row.
    """
    names = fields(keys)
    coarse, fine = F.col("_coarse"), F.col("_fine")
    v = F.col("_v")
    counted = (
        df.select(*names, to_numeric(*typed(df, value)).alias("_v")).where(v.isNotNull())
        .groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_count"))
        .select("*", _coarse(v).alias("_coarse"))
    )
    everything = F.sum("_count").over(Window.partitionBy(*(names or [F.lit(0)])))
    coarse_cells = counted.groupBy(*names, coarse).agg(
        F.sum("_count").alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    ).select("*", everything.alias("_n"))
    in_coarse = _holding(coarse_cells, names, "_coarse", _ranks(quantiles.values()),
                         [*names, coarse, F.col("_low"), F.col("_high")])
    near = counted.join(in_coarse, [*keys, "_coarse"]).select(
        *names, coarse, v, "_count", _fine(v, F.col("_low"), F.col("_high")).alias("_fine")
    )
    # Grouped by another expression than the join was dealt by, so that its output is reduced and
    # shuffled again: only then can adaptive execution split the join where one cell of a hot key
    # holds most values. The ranks are looked up afterwards for the same reason.
    cell = F.struct(*names, coarse).alias("_cell")
    fine_cells = near.groupBy(cell, fine).agg(F.sum("_count").alias("_count")).select(
        *[F.col("_cell")[k].alias(k) for k in [*keys, "_coarse"]], fine, "_count")
    fine_cells = fine_cells.join(in_coarse.select(*names, coarse, "_wanted"), [*keys, "_coarse"])
    in_fine = _holding(fine_cells, [*names, coarse], "_fine", F.col("_wanted"), [*names, coarse, fine])
    values = near.join(in_fine, [*keys, "_coarse", "_fine"])
    found = _holding(values, [*names, coarse, fine], "_v", F.col("_wanted"), [*names, v])
    slots = found.select(*names, v, F.explode("_wanted").alias("_t"))
    picks = []
    for place, name in enumerate(quantiles):
        low = F.max(F.when(F.col("_t.slot") == 2 * place, v))
        high = F.max(F.when(F.col("_t.slot") == 2 * place + 1, v))
        share = F.max(F.when(F.col("_t.slot") == 2 * place, F.col("_t.share")))
        between = F.when(low == high, low).otherwise(low + (high - low) * share)
        picks.append(fold_nan(between, T.DoubleType()).alias(name))
    return slots.groupBy(*names).agg(*picks)
