"""How well a mapping reproduces the target.

Both sides are stacked and reduced twice, first per key and compared values, then per key. Distinct
keys, matching rows and accuracies are all read from the second grain, so that one scan a side and
no join answer every question, and both reductions combine on the map side whatever a key holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGGREGATION, CONVERSION, ColumnMapping
from ..functions import (
    field,
    fields,
    fold_nan,
    is_close,
    percentage,
    percentage_text,
    stringify,
    text_equal_ci,
    typed,
)
from .keys import cast_keys
from .matching import Matcher

KEYS, KEYS_AND_VALUES = "keys", "keys_and_values"

# Names of columns that live between the two grains only.
_OURS, _THEIRS = "_paritas_ours", "_paritas_theirs"
_OUR_ROWS, _THEIR_ROWS, _MATCHES = "_paritas_s", "_paritas_t", "_paritas_m"
_OUR_KEY, _THEIR_KEY = "_paritas_whole_s", "_paritas_whole_t"
_ORDER = "_paritas_order"


def _complete(df: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [fold_nan(*typed(df, k)).isNotNull() for k in keys])


def accuracy_entries(
    matcher: Matcher, functions: Sequence[str] = (AGGREGATION, CONVERSION)
) -> list[ColumnMapping]:
    """Columns of the mapping that have an accuracy: aggregated or converted, with a destination."""
    return [e for e in matcher.plan.contributing if e.function in functions and e.destinations]


def _stacked(
    source: DataFrame | None,
    target: DataFrame,
    matcher: Matcher,
    entries: Sequence[ColumnMapping],
    target_order: Sequence[str],
    helpers: Sequence[str],
) -> DataFrame:
    """Rows of both sides under one schema: helpers, counters, whether the key is complete, and the
    values that accuracies compare. A grouped source has one row per complete key."""
    plan, sides = matcher.plan, matcher.sides
    if sides.source_is_unique:
        left = matcher.mapped_source.withColumn(_OUR_KEY, F.lit(True))
    elif source is None:
        raise ValueError("a source that is not grouped has to be given")
    else:
        left = cast_keys(source.withColumn(_OUR_KEY, _complete(source, plan.source_keys)), plan.source_keys)
    right = cast_keys(target.withColumn(_THEIR_KEY, _complete(target, plan.target_keys)), plan.target_keys)
    ours = [field(e.column).alias(f"a{i}") for i, e in enumerate(entries)]
    theirs = [field(e.destinations[0]).alias(f"b{i}") for i, e in enumerate(entries)]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    left = left.select(
        *[sides.source.comparable[h].alias(h) for h in helpers],
        one.alias(_OUR_ROWS), none.alias(_THEIR_ROWS), field(_OUR_KEY), F.lit(False).alias(_THEIR_KEY),
        *([F.struct(*ours).alias(_OURS)] if entries else []))
    right = right.select(
        *[sides.target.comparable[h].alias(h) for h in helpers],
        none.alias(_OUR_ROWS), one.alias(_THEIR_ROWS), F.lit(False).alias(_OUR_KEY), field(_THEIR_KEY),
        *([F.struct(*theirs).alias(_THEIRS), F.struct(*fields(target_order)).alias(_ORDER)] if entries else []))
    return left.unionByName(right, allowMissingColumns=True)


def _reduced(rows: DataFrame, names: Sequence[str], matches: Column, with_values: bool) -> DataFrame:
    """One row per combination of ``names``, with the values of the one source row and of the first
    target row."""
    kept = [
        F.sum(_OUR_ROWS).alias(_OUR_ROWS), F.sum(_THEIR_ROWS).alias(_THEIR_ROWS),
        F.max(_OUR_KEY).alias(_OUR_KEY), F.max(_THEIR_KEY).alias(_THEIR_KEY), matches.alias(_MATCHES)]
    if with_values:
        kept += [F.first(_OURS, ignorenulls=True).alias(_OURS), F.min_by(_THEIRS, _ORDER).alias(_THEIRS),
                 F.min(_ORDER).alias(_ORDER)]
    return rows.groupBy(*names).agg(*kept)


def evaluation(
    target: DataFrame,
    matcher: Matcher,
    entries: Sequence[ColumnMapping] = (),
    target_order: Sequence[str] = (),
    match_on: str = KEYS,
    source: DataFrame | None = None,
    with_matches: bool = True,
) -> DataFrame:
    """One row: ``total_source_keys, total_target_keys, matched_keys``, ``total`` and ``matches_<i>``
    of the i-th entry.

    Keys with a missing component count as keys of neither side, though they meet in the match.
    ``total`` is the number of source rows whose key has a partner; with ``match_on`` keys and
    values only those among the matched rows. Without ``with_matches`` the compared values are left
    out, if nothing else needs them, and ``matched_keys`` counts rows with equal keys.
    """
    if match_on not in (KEYS, KEYS_AND_VALUES):
        raise ValueError(f"match_on must be {KEYS!r} or {KEYS_AND_VALUES!r}")
    strict = match_on == KEYS_AND_VALUES
    helpers = matcher.sides.helpers
    keys = helpers[: len(matcher.plan.source_keys)]
    wanted = helpers if with_matches or strict else keys
    product = F.sum(_OUR_ROWS) * F.sum(_THEIR_ROWS)
    grain = _reduced(_stacked(source, target, matcher, entries, target_order, wanted), wanted, product, bool(entries))
    if len(wanted) > len(keys):
        grain = _reduced(grain, keys, F.sum(_MATCHES), bool(entries))
    in_source, in_target = F.col(_OUR_ROWS) > 0, F.col(_THEIR_ROWS) > 0
    paired = in_source & in_target & ((F.col(_MATCHES) > 0) if strict else F.lit(True))
    agrees = []
    for i, entry in enumerate(entries):
        a, b = F.col(f"{_OURS}.a{i}"), F.col(f"{_THEIRS}.b{i}")
        if entry.function == AGGREGATION:
            agrees.append(is_close(a, b))
        else:
            agrees.append(text_equal_ci(stringify(a, grain.schema[_OURS].dataType[f"a{i}"].dataType),
                                        stringify(b, grain.schema[_THEIRS].dataType[f"b{i}"].dataType)))
    return grain.agg(
        F.count_if(in_source & F.col(_OUR_KEY)).alias("total_source_keys"),
        F.count_if(in_target & F.col(_THEIR_KEY)).alias("total_target_keys"),
        F.coalesce(F.sum(_MATCHES), F.lit(0)).cast("bigint").alias("matched_keys"),
        F.count_if(paired).alias("total"),
        *[F.count_if(paired & test).alias(f"matches_{i}") for i, test in enumerate(agrees)],
    )


def match_rate() -> Column:
    """Matched rows per source key in percent, over a row of ``evaluation``."""
    return percentage_text(percentage(F.col("matched_keys"), F.col("total_source_keys")))


def accuracy_cells(entries: Sequence[ColumnMapping]) -> list[Column]:
    """A struct ``kind, column_name, matches, total, accuracy`` per entry, over a row of ``evaluation``."""
    cells = []
    for i, entry in enumerate(entries):
        matches = F.col(f"matches_{i}")
        share = percentage_text(percentage(matches, F.col("total")))
        cells.append(F.struct(
            F.lit("aggregation" if entry.function == AGGREGATION else "conversion").alias("kind"),
            F.lit(entry.column).alias("column_name"),
            matches.alias("matches"),
            F.col("total").alias("total"),
            F.when(F.col("total") > 0, share).otherwise("0%").alias("accuracy"),
        ))
    return cells


def key_match_stats(source: DataFrame, target: DataFrame, matcher: Matcher) -> DataFrame:
    """Distinct keys of either side, matched rows, and matched rows per source key in percent.

    The rate can exceed 100 when matching rows multiply; without source keys it is zero.
    """
    row = evaluation(target, matcher, source=source)
    return row.select("total_source_keys", "total_target_keys", "matched_keys", match_rate().alias("match_rate"))


def mapping_accuracy(
    target: DataFrame,
    matcher: Matcher,
    target_order: Sequence[str],
    functions: Sequence[str] = (AGGREGATION, CONVERSION),
    match_on: str = KEYS,
) -> DataFrame:
    """``kind, column_name, matches, total, accuracy`` per aggregated or converted column.

    Each mapped source row is compared with the first target row of its key. Aggregates agree within
    a tolerance, conversions as trimmed text regardless of case.
    """
    if match_on not in (KEYS, KEYS_AND_VALUES):
        raise ValueError(f"match_on must be {KEYS!r} or {KEYS_AND_VALUES!r}")
    entries = accuracy_entries(matcher, functions)
    if not entries:
        return target.sparkSession.createDataFrame(
            [], "kind string, column_name string, matches bigint, total bigint, accuracy string")
    row = evaluation(target, matcher, entries, target_order, match_on, with_matches=False)
    return row.select(F.inline(F.array(*accuracy_cells(entries))))
