"""Data rules: one failure predicate per rule, shared by the counts and the failing rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from numbers import Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALLOWED_RULE, NULL_RULE, RANGE_RULE, REGEX_RULE, UNIQUE_RULE, Rule, RuleSet
from ..functions import (
    field,
    fields,
    fold_nan,
    is_missing,
    match_at_start,
    percentage,
    percentage_text,
    stringify,
    threshold_status,
    to_numeric,
    typed,
)
from .sketches import read_sketches, value_sketches

# The headers of a printed result, in place of the column names used here.
REPORT_HEADERS = {
    "column_name": "Column Name",
    "rule": "Rule",
    "pass_count": "Pass",
    "fail_count": "Fail",
    "pass_pct": "Pass %",
}


def _same_kind(members: Iterable, dtype: T.DataType) -> list:
    """Members that can equal a value of the column: a text never equals a number."""
    members = list(members)
    if isinstance(dtype, T.StringType):
        return [m for m in members if isinstance(m, str)]
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [t for t in (_moment(m) for m in members) if t is not None]
    numbers = [m for m in members if isinstance(m, Real) and math.isfinite(m)]
    if isinstance(dtype, T.BooleanType):
        return [bool(m) for m in numbers if m in (0, 1)]
    if isinstance(dtype, T.IntegralType):
        limit = 1 << 63
        return [int(m) for m in numbers if m == int(m) and -limit <= int(m) < limit]
    if isinstance(dtype, T.NumericType):
        infinite = [float(m) for m in members if isinstance(m, float) and math.isinf(m)]
        return [float(m) for m in numbers] + infinite
    return []


def _moment(member) -> datetime | None:
    if isinstance(member, datetime):
        return member
    try:
        return datetime.fromisoformat(member) if isinstance(member, str) else None
    except ValueError:
        return None


def _lists_missing(members: Iterable) -> bool:
    return any(m is None or (isinstance(m, float) and math.isnan(m)) for m in members)


def is_allowed(col: Column, dtype: T.DataType, members: Iterable) -> Column:
    """Membership without conversion between texts and numbers. Missing is a member only of a
    list for a text column that names it."""
    members = list(members)
    wanted = _same_kind(members, dtype)
    held = F.coalesce(col.isin(*wanted), F.lit(False)) if wanted else F.lit(False)
    if isinstance(dtype, T.StringType) and _lists_missing(members):
        held = held | col.isNull()
    return held


def matches_pattern(col: Column, dtype: T.DataType, pattern: str) -> Column:
    """Python pattern against the start of the value's text; missing is matched as its text."""
    return stringify(col, dtype).rlike(match_at_start(pattern))


def in_range(col: Column, dtype: T.DataType, low: float | None, high: float | None) -> Column:
    """Inclusive bounds on the value as a number; what is no number is out of range."""
    number = to_numeric(col, dtype)
    inside = number.isNotNull()
    if low is not None:
        inside = inside & (number >= low)
    if high is not None:
        inside = inside & (number <= high)
    return F.coalesce(inside, F.lit(False))


def outside_bounds(col: Column, dtype: T.DataType, low: float | None, high: float | None) -> Column:
    """Numbers beyond a bound. Unlike the count of the rule it leaves missing values out."""
    number = to_numeric(col, dtype)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (number < low)
    if high is not None:
        outside = outside | (number > high)
    return F.coalesce(outside, F.lit(False))


def fails(df: DataFrame, rule: Rule) -> Column:
    """Predicate behind the fail count of a rule other than uniqueness."""
    col, dtype = typed(df, rule.column)
    if rule.name == NULL_RULE:
        return is_missing(col, dtype)
    if rule.name == ALLOWED_RULE:
        return ~is_allowed(col, dtype, rule.allowed)
    if rule.name == REGEX_RULE:
        return ~matches_pattern(col, dtype, rule.pattern)
    if rule.name == RANGE_RULE:
        return ~in_range(col, dtype, rule.low, rule.high)
    raise ValueError(f"rule {rule.name!r} is not decided row by row")


def shows_as_failing(df: DataFrame, rule: Rule) -> Column:
    """Predicate behind the rows listed for a rule other than uniqueness."""
    if rule.name == RANGE_RULE:
        return outside_bounds(*typed(df, rule.column), rule.low, rule.high)
    return fails(df, rule)


# -- counts -------------------------------------------------------------------------------------


def _counts(df: DataFrame, numbered: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Counts of all rules that are decided row by row, in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(fails(df, rule)).alias(f"_fail{no}") for no, rule in numbered],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(no).alias("rule_no"),
                F.lit(rule.column).alias("column_name"),
                F.lit(rule.name).alias("rule"),
                (F.col("_total") - F.col(f"_fail{no}")).alias("pass_count"),
                F.col(f"_fail{no}").alias("fail_count"),
                F.col("_total").alias("_total"),
            )
            for no, rule in numbered
        ]
    )
    return row.select(F.inline(entries))


def _unique_count(df: DataFrame, no: int, rule: Rule) -> DataFrame:
    """Distinct values pass, all other rows fail. Grouped by value first, so that neither a hot
    value nor a large number of values meets in one task."""
    value = fold_nan(*typed(df, rule.column))
    sizes = df.select(value.alias("_value")).groupBy("_value").agg(F.count(F.lit(1)).alias("_size"))
    counts = sizes.agg(
        F.count("_value").alias("pass_count"),
        F.coalesce(F.sum("_size"), F.lit(0)).alias("_total"),
    )
    return counts.select(
        F.lit(no).alias("rule_no"),
        F.lit(rule.column).alias("column_name"),
        F.lit(rule.name).alias("rule"),
        "pass_count",
        (F.col("_total") - F.col("pass_count")).alias("fail_count"),
        "_total",
    )


def _unique_counts_approx(df: DataFrame, numbered: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Counts of all uniqueness rules from distinct sketches, in one aggregate over one scan."""
    columns = list(dict.fromkeys(rule.column for _, rule in numbered))
    row = read_sketches(value_sketches(df, [], distinct=columns), [])
    passed = [F.least(F.col("n_rows"), field(f"{rule.column}_distinct")) for _, rule in numbered]
    entries = F.array(*[
        F.struct(F.lit(no).alias("rule_no"), F.lit(rule.column).alias("column_name"), F.lit(rule.name).alias("rule"),
                 n.alias("pass_count"), (F.col("n_rows") - n).alias("fail_count"), F.col("n_rows").alias("_total"))
        for n, (no, rule) in zip(passed, numbered)])
    return row.select(F.inline(entries))


def rule_counts(df: DataFrame, rules: RuleSet, approx: bool = False) -> DataFrame:
    """``rule_no, column_name, rule, pass_count, fail_count, pass_pct, status`` per rule.

    One scan for all row-wise rules and one, pruned to its column, for each uniqueness rule: a
    joint distinct count would multiply every row by the number of columns instead. With ``approx`` all
    uniqueness rules share one scan, and their counts are off by some ``DISTINCT_ERROR`` of the distinct values.
    """
    numbered = list(enumerate(rules.rules))
    row_wise = [(no, rule) for no, rule in numbered if rule.name != UNIQUE_RULE]
    parts = [_counts(df, row_wise)] if row_wise else []
    unique = [(no, rule) for no, rule in numbered if rule.name == UNIQUE_RULE]
    parts += [_unique_counts_approx(df, unique)] if approx and unique else [_unique_count(df, *u) for u in unique]
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "rule_no int, column_name string, rule string, pass_count bigint, "
            "fail_count bigint, pass_pct string, status string")
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    pct = percentage(F.col("pass_count"), F.col("_total"))
    empty_unique = (F.col("rule") == UNIQUE_RULE) & (F.col("_total") == 0)
    text = percentage_text(F.when(empty_unique, 100.0).otherwise(pct))
    # The threshold is applied to the percentage as printed.
    printed = F.rtrim(text, F.lit("%")).cast("double")
    return rows.select(
        "rule_no", "column_name", "rule", "pass_count", "fail_count",
        text.alias("pass_pct"), threshold_status(printed).alias("status"),
    )


# -- rows ---------------------------------------------------------------------------------------


def failing_rows(df: DataFrame, rule: Rule) -> DataFrame:
    if rule.name == UNIQUE_RULE:
        return failing_duplicates(df, rule.column)
    return df.where(shows_as_failing(df, rule))


def failing_duplicates(df: DataFrame, column: str) -> DataFrame:
    """All rows of any value that occurs more than once; missing values count as one value.

    The repeated values are found by a two-step count and looked up with a semi join. A window
    over the value would gather a hot value in one task, the left side of a semi join is split.
    """
    value = fold_nan(*typed(df, column))
    keyed = df.withColumn("_value", value)
    repeated = (
        keyed.groupBy("_value").agg(F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > 1).select(F.col("_value").alias("_repeated"))
    )
    same = F.col("_value").eqNullSafe(F.col("_repeated"))
    return keyed.join(repeated, same, "left_semi").select(*fields(df.columns))


def rule_details(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Failing rows of all rules, each tagged with ``rule_no, column_name, rule``.

    The row-wise rules share one scan: a row is repeated once per rule that it fails.
    """
    numbered = list(enumerate(rules.rules))
    row_wise = [(no, rule) for no, rule in numbered if rule.name != UNIQUE_RULE]
    tag = "struct<rule_no:int,column_name:string,rule:string>"

    def tagged(no: int, rule: Rule) -> Column:
        return F.struct(F.lit(no).alias("rule_no"), F.lit(rule.column).alias("column_name"),
                        F.lit(rule.name).alias("rule"))

    parts = []
    if row_wise:
        hits = F.array(*[F.when(shows_as_failing(df, r), tagged(no, r)) for no, r in row_wise])
        parts.append(
            df.withColumn("_tag", F.explode(F.filter(hits, lambda t: t.isNotNull())))
            .select("_tag.*", *fields(df.columns))
        )
    for no, rule in numbered:
        if rule.name == UNIQUE_RULE:
            rows = failing_duplicates(df, rule.column).withColumn("_tag", tagged(no, rule).cast(tag))
            parts.append(rows.select("_tag.*", *fields(df.columns)))
    if not parts:
        return df.limit(0).withColumn("_tag", F.lit(None).cast(tag)).select("_tag.*", *fields(df.columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_set(df: DataFrame, config: Mapping) -> RuleSet:
    return RuleSet.of(config, df.columns)
