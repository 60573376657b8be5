"""The composite jobs. Each returns lazy DataFrames and runs nothing by itself."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TableMapping
from ..functions import fields, fixed_text
from ..operators.accuracy import KEYS, accuracy_cells, accuracy_entries, evaluation, match_rate
from ..operators.digest import dataset_fingerprint
from ..operators.matching import Matcher
from ..operators.profiling import (
    describe_categorical,
    describe_numeric,
    null_profile,
    numeric_columns,
    preview,
    text_columns,
)
from ..operators.rules import REPORT_HEADERS, rule_counts, rule_details, rule_set


def execute_matching(
    source: DataFrame,
    target: DataFrame,
    mapping: Mapping | TableMapping,
    order_by: Sequence[str] | None = None,
    scale: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The merged table with its indicator, and the match statistics as one row."""
    matcher = Matcher(source, target, mapping, order_by, scale)
    return matcher.merged(), matcher.stats()


def execute_validation(df: DataFrame, rules: Mapping, report_headers: bool = False) -> DataFrame:
    """One row per rule; see ``rule_counts``."""
    rows = rule_counts(df, rule_set(df, rules))
    return rows.withColumnsRenamed(REPORT_HEADERS) if report_headers else rows


def skipped_columns(df: DataFrame, rules: Mapping) -> list[str]:
    """Columns that have rules but do not exist."""
    return list(rule_set(df, rules).skipped)


def validation_details(df: DataFrame, rules: Mapping) -> DataFrame:
    """Failing rows of every rule, tagged with the rule."""
    return rule_details(df, rule_set(df, rules))


def validation_detail_counts(df: DataFrame, rules: Mapping) -> DataFrame:
    """How many rows ``validation_details`` lists per rule. This differs from the fail count of the
    rules on ranges and uniqueness. Rules without such rows are not listed."""
    return validation_details(df, rules).groupBy("rule_no", "column_name", "rule").agg(
        F.count(F.lit(1)).alias("n_rows"))


def _lines(row: DataFrame, section: str, name: Column, values: Mapping[str, Column]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), c.cast("string").alias("value")) for m, c in values.items()]
    return row.select(
        F.lit(section).alias("section"), name.alias("column_name"), F.inline(F.array(*cells))
    )


def profile_table(df: DataFrame, order_by: Sequence[str], preview_rows: int = 5) -> DataFrame:
    """``section, column_name, metric, value``: preview, summary, types and missing values."""
    session = df.sparkSession
    parts = [
        _lines(preview(df, order_by, preview_rows), "preview", F.lit(None).cast("string"),
               {"row": F.to_json(F.struct(*fields(df.columns)))}),
        session.createDataFrame(
            [("types", name, "type", kind) for name, kind in df.dtypes],
            "section string, column_name string, metric string, value string",
        ),
        _lines(null_profile(df), "nulls", F.col("column_name"), {"null_count": F.col("null_count")}),
    ]
    if numeric_columns(df):
        metrics = ("mean", "std", "min", "p25", "p50", "p75", "max")
        parts.append(_lines(describe_numeric(df), "summary", F.col("column_name"),
                            {"count": F.col("count"), **{m: fixed_text(F.col(m), 6) for m in metrics}}))
    if text_columns(df):
        parts.append(_lines(describe_categorical(df), "summary", F.col("column_name"),
                            {m: F.col(m) for m in ("count", "unique", "top", "freq")}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluate_mapping(
    source: DataFrame,
    target: DataFrame,
    mapping: Mapping | TableMapping,
    target_order: Sequence[str],
    order_by: Sequence[str] | None = None,
    match_on: str = KEYS,
) -> DataFrame:
    """``section, item, metric, value``: mapped columns, key statistics and accuracies.

    ``match_on`` says whether accuracy is taken over rows whose keys agree, or only over rows
    whose mapped values agree as well.
    """
    plan = TableMapping.of(mapping)
    matcher = Matcher(source, target, plan, order_by)
    entries = accuracy_entries(matcher)
    row = evaluation(target, matcher, entries, target_order, match_on, source)

    def line(section: Column, item: Column, metric: str, value: Column) -> Column:
        return F.struct(section.alias("section"), item.alias("item"), F.lit(metric).alias("metric"),
                        value.cast("string").alias("value"))

    lines = [line(F.lit("mapped_columns"), F.lit(e.column), "destination", F.lit(e.destinations[0]))
             for e in plan.columns if e.destinations]
    lines += [line(F.lit("key_matches"), F.lit("keys"), name, F.col(name))
              for name in ("total_source_keys", "total_target_keys", "matched_keys")]
    lines.append(line(F.lit("key_matches"), F.lit("keys"), "match_rate", match_rate()))
    lines += [line(F.concat(cell["kind"], F.lit("_accuracy")), cell["column_name"], metric, cell[metric])
              for cell in accuracy_cells(entries) for metric in ("matches", "total", "accuracy")]
    return row.select(F.inline(F.array(*lines)))


def _config_lines(mapping: TableMapping, rules: Mapping) -> list[tuple[str, str, str, str | None]]:
    lines = [
        ("mapping", "keys", "source", ", ".join(mapping.source_keys)),
        ("mapping", "keys", "target", ", ".join(mapping.target_keys)),
    ]
    for entry in mapping.columns:
        detail = entry.reducer
        if entry.dictionary is not None:
            detail = json.dumps(entry.dictionary, ensure_ascii=False)
        lines += [
            ("mapping", entry.column, "destinations", ", ".join(entry.destinations)),
            ("mapping", entry.column, "function", entry.function),
            ("mapping", entry.column, "transformation", detail),
        ]
    for column, entry in rules.items():
        lines += [("validation_configuration", column, rule, str(value))
                  for rule, value in entry.items()]
    return lines


def audit_report(
    source: DataFrame,
    target: DataFrame,
    mapping: Mapping | TableMapping,
    rules: Mapping,
    generated_at: str,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """``section, item, metric, value``: everything an auditor needs, in long form."""
    plan = TableMapping.of(mapping)
    matcher = Matcher(source, target, plan, order_by)
    shape = {"rows": F.col("n_rows"), "columns": F.col("n_columns"), "checksum": F.col("checksum")}
    results = rule_counts(target, rule_set(target, rules))
    config = [*_config_lines(plan, rules), ("report", "report", "generated_at", generated_at)]

    def audit(df: DataFrame, side: str) -> DataFrame:
        return _lines(dataset_fingerprint(df), "data_audit", F.lit(side), shape)

    def counted(df: DataFrame) -> DataFrame:
        return _lines(df, "matching", F.lit("records"), {c: F.col(c) for c in df.columns})

    outcome = results.select(
        F.lit("validation_results").alias("section"),
        F.concat_ws(": ", "column_name", "rule").alias("column_name"),
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
            for m in ("pass_count", "fail_count", "pass_pct", "status")])),
    )
    measured = [audit(source, "source"), audit(target, "target"), counted(matcher.stats()), outcome]
    return reduce(
        lambda a, b: a.unionByName(b),
        [part.withColumnRenamed("column_name", "item") for part in measured],
        source.sparkSession.createDataFrame(
            config, "section string, item string, metric string, value string"),
    )


def audit_document(report: DataFrame) -> DataFrame:
    """The report as one JSON document with its checksum. A report holds a few lines per
    configured rule and column, never rows of the tables."""
    lines = F.array_sort(F.collect_list(F.struct("section", "item", "metric", "value")))
    document = report.agg(F.to_json(lines).alias("document"))
    return document.withColumn("checksum", F.sha2("document", 256))

