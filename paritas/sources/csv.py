"""Lenient CSV scan: broken lines are dropped, short ones padded, everything else kept."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import field, null_tokens_to_null
from .files import delimiter_of
from .column_types import apply_types, common_types, infer_types, inferred_types
from .heads import file_heads

_BROKEN = "_broken_line"


def clean_header(name: str) -> str:
    return name.strip().replace("\ufeff", "")


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip white space, then byte order marks, from all column names."""
    return df.toDF(*[clean_header(name) for name in df.columns])


def unique_headers(names: Sequence[str]) -> list[str]:
    """Name the unnamed columns and number repeated names."""
    seen: dict[str, int] = {}
    out = []
    for place, raw in enumerate(names):
        name = raw or f"Unnamed: {place}"
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        out.append(f"{name}.{repeat}" if repeat else name)
    return out


def _names_of(line: str, delimiter: str) -> list[str]:
    return unique_headers(next(csv.reader([line.lstrip("\ufeff")], delimiter=delimiter)))


def header_of(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    """Column names from the first line with content. One line reaches the driver."""
    lines = spark.read.text(path).where(F.trim("value") != "").head(1)
    return _names_of(lines[0]["value"], delimiter) if lines else []


#: First lines of a file among which its header is looked for; lines without content may stand before it.
HEADER_LINES = 20


def header_catalogue(spark: SparkSession, path: str, delimiter: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for each different header of the files below ``path``, most files first.

    Some kilobytes of each file are read, by Spark's tasks. Files without content are left out.
    """
    filled = file_heads(spark, path, HEADER_LINES).where(F.trim("value") != "")
    headers = filled.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(found, key=lambda r: (-len(r.files), r.header)):
        groups.setdefault(tuple(_names_of(row.header, delimiter)), []).extend(row.files)
    return [(list(names), files) for names, files in groups.items()]


def _unquoted(line: Column, delimiter: str) -> Column:
    return F.regexp_replace(line, rf'(?<=^|[{re.escape(delimiter)}"])"[^"]*"', "")


def _is_open(line: Column, delimiter: str) -> Column:
    """Whether a field begins with a quote that the line does not close."""
    return _unquoted(line, delimiter).rlike(rf'(^|[{re.escape(delimiter)}])"')


def _field_count(line: Column, delimiter: str) -> Column:
    """Fields in a raw line; delimiters inside quotes do not count."""
    unquoted = _unquoted(line, delimiter)
    without = F.replace(unquoted, F.lit(delimiter), F.lit(""))
    return F.length(unquoted) - F.length(without) + 1


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str | None = None,
    columns: Sequence[str] | None = None,
    header: bool = True,
    multiline: bool | str = False,
) -> DataFrame:
    """All columns as text. Lines with too many fields are dropped, short ones get NULLs.

    ``multiline`` allows line breaks inside quotes: True at the price of one task per file, ``"split"`` with as
    many tasks as a file has splits, at the price of a shuffle of the lines. Without it a short line that ends
    inside a quoted field raises an error. Columns are read by position; files whose headers differ in more than their
    quoting raise an error (``read_parts`` reads them by name).
    """
    delimiter = delimiter or delimiter_of(spark, path)
    if columns:
        names = list(columns)
    elif header:
        groups = header_catalogue(spark, path, delimiter)
        if len(groups) > 1:
            raise ValueError(f"files with different headers, read them by name with read_parts: {groups[0][0]} in "
                             f"{groups[0][1][0]}, {groups[1][0]} in {groups[1][1][0]}")
        names = groups[0][0] if groups else []
    else:
        names = header_of(spark, path, delimiter)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    hidden = [f"c{place}" for place in range(len(names))]
    if multiline == "split":
        return _parsed_records(quoted_records(spark, path, delimiter, header), hidden, delimiter, len(names), names)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*hidden, _BROKEN]])
    rows = (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", _BROKEN)
        # With pruned columns the reader could not tell a broken line from a good one.
        .option("columnPruning", False)
        .csv(path)
    )
    # The reader refuses a scan of the broken line alone, so tie it to a data column.
    line = F.concat(F.col(_BROKEN), F.left(F.coalesce(hidden[0], F.lit("")), F.lit(0)))
    short = _field_count(line, delimiter) <= len(names)
    kept = rows.where(F.col(_BROKEN).isNull() | short)
    if not multiline:
        # Half a record must not pass as a short line.
        failure = F.concat(F.lit("a quoted field goes on behind its line; read with multiline=True: "),
                           F.input_file_name())
        kept = kept.where(F.when(F.coalesce(_is_open(line, delimiter), F.lit(False)), F.raise_error(failure).cast("boolean"))
                          .otherwise(F.lit(True)))
    return normalize_headers(kept.select(*hidden).toDF(*names))


def _parsed_records(records: DataFrame, hidden: list[str], delimiter: str, width: int, names: list[str]) -> DataFrame:
    schema = ", ".join(f"{name} string" for name in [*hidden, _BROKEN])
    options = {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    parsed = records.select(F.from_csv("record", schema, options).alias("_r"), "record").select("_r.*", "record")
    short = _field_count(F.replace("record", F.lit("\n"), F.lit(" ")), delimiter) <= width
    return normalize_headers(parsed.where(F.col(_BROKEN).isNull() | short).select(*hidden).toDF(*names))


#: Lines of one record beyond which an open quote counts as a mistake.
RECORD_LINES = 100_000


def _line_effects(lines: DataFrame, delimiter: str) -> DataFrame:
    """``lines`` with what each does to the state *inside quotes*: it leaves it as it is, turns it (``_turn`` 1), or ends
    in a state of its own (``_fixed``) whatever was before."""
    value = F.col("value")
    # behind a closing quote the field goes on to its delimiter, and quotes in it are plain
    until_close = r'^(?:[^"]|"")*"(?!")'
    rest = F.regexp_replace(value, f"{until_close}[^{re.escape(delimiter)}]*", "")
    quoting = F.contains(value, F.lit('"'))
    outside = quoting & _is_open(value, delimiter)
    inside = ~quoting | F.when(value.rlike(until_close), (rest != "") & _is_open(rest, delimiter)).otherwise(True)
    return lines.select("*", outside.alias("_out"), inside.alias("_in")).select(
        *lines.columns, F.when(F.col("_out") == F.col("_in"), F.col("_out")).alias("_fixed"),
        (F.col("_out") & ~F.col("_in")).cast("int").alias("_turn"))


def _state(base: Column, turns: Column, start: Column) -> Column:
    """State after ``turns`` turns in all, the last fixed one being ``base`` (_fixed, _turns) if there is one."""
    odd = F.pmod(turns - F.coalesce(base["_turns"], F.lit(0)), F.lit(2)) == 1
    return F.coalesce(base["_fixed"], start) != odd


def _last_fixed(window) -> Column:
    known = F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns"))
    return F.last(known, ignorenulls=True).over(window)


def _split_starts(effects: DataFrame) -> DataFrame:
    """``file, split, start, chain, ahead``: the state in which each split of a file begins, the first of the splits that
    only go on with the record open then, and the next split.

    One row per split enters: the composition of its lines is the last state they fix and the turns behind it.
    """
    at = Window.partitionBy("file", "split").orderBy("position")
    marks = effects.select("file", "split", "position", "_fixed", "_turn").withColumn("_turns", F.sum("_turn").over(at))
    marks = marks.withColumn("_base", _last_fixed(at))
    after = [_state(F.col("_base"), F.col("_turns"), F.lit(begun)) for begun in (False, True)]
    ends = F.struct(*[state.alias(name) for state, name in zip(after, ("from_out", "from_in"))])
    # whether the split, begun inside, is ever outside behind one of its lines
    splits = marks.groupBy("file", "split").agg(F.max_by(ends, "position").alias("end"), F.max(~after[1]).alias("closes"))
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("end.from_out") == F.col("end.from_in"), F.col("end.from_out"))
    turn = (F.col("end.from_out") & ~F.col("end.from_in")).cast("int")
    splits = splits.select("file", "split", "closes", fixed.alias("_fixed"), turn.alias("_turn"))
    splits = splits.withColumn("_turns", F.sum("_turn").over(order)).select(
        "*", _last_fixed(before).alias("_base"), F.coalesce(F.lag("_turns").over(order), F.lit(0)).alias("_so_far"))
    splits = splits.withColumn("start", _state(F.col("_base"), F.col("_so_far"), F.lit(False)))
    goes_on = F.lag(F.col("start") & ~F.col("closes")).over(order)
    splits = splits.withColumn("_first", ~F.coalesce(goes_on, F.lit(False)))
    return splits.select("file", "split", "start", F.last(F.when(F.col("_first"), F.col("split")), ignorenulls=True).over(
        order).alias("chain"), F.lead("split").over(order).alias("ahead"))


def quoted_records(spark: SparkSession, path: str | list[str], delimiter: str, header: bool) -> DataFrame:
    """``record``: the records of the files below ``path`` as text, line breaks inside quotes as ``\\n``.

    Every split of a file is read by a task of its own. The state inside quotes before a line follows from that of its
    split and the lines between; a record that goes on in further splits is put together by the first of them. Blank
    records and, with ``header``, the first other record of each file are left out.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("position"))
    effects = _line_effects(lines, delimiter)
    at = Window.partitionBy("file", "split").orderBy("position")
    filled = (F.trim("value") != "").cast("int")
    known = (effects.withColumn("_turns", F.sum("_turn").over(at)).withColumn("_base", _last_fixed(at))
             .withColumn("_filled", F.sum(filled).over(at)).join(_split_starts(effects), ["file", "split"]))
    known = known.withColumn("_after", _state(F.col("_base"), F.col("_turns"), F.col("start")))
    known = known.withColumn("_begins", ~F.coalesce(F.lag("_after").over(at), F.col("start")))
    known = known.withColumn("_number", F.sum(F.col("_begins").cast("int")).over(at))
    whole = Window.partitionBy("file", "split")
    known = known.withColumn("_last", F.max("_number").over(whole)).withColumn("_open", F.max_by("_after", "position").over(whole))
    leading, trailing = F.col("_number") == 0, (F.col("_number") == F.col("_last")) & F.col("_open") & F.col("ahead").isNotNull()
    keyed = known.select(
        "file", F.when(leading, F.col("chain")).when(trailing, F.col("ahead")).otherwise(F.col("split")).alias("_split"),
        F.when(leading | trailing, 0).otherwise(F.col("_number")).alias("_record"),
        F.struct("split", "position", "value").alias("_line"),
        ((F.col("split") == 0) & F.col("_begins") & (filled == 1) & (F.col("_filled") == 1)).alias("_header"))
    records = keyed.groupBy("file", "_split", "_record").agg(
        F.sort_array(F.collect_list("_line")).alias("_lines"), F.max("_header").alias("_header"))
    text = F.when(F.size("_lines") > RECORD_LINES, F.raise_error(F.concat(
        F.lit("a quoted field goes on for too many lines: "), F.col("file"))).cast("string")).otherwise(
        F.array_join(F.transform("_lines", lambda line: line["value"]), "\n"))
    kept = records.where(~F.col("_header")) if header else records
    return kept.select(text.alias("record")).where(F.trim("record") != "")


def read_parts(spark: SparkSession, path: str, delimiter: str | None = None, infer: bool = True, **scan_options) -> DataFrame:
    """All files below ``path`` by the names of their columns, whatever their order.

    Files with one header are a part. Types are found per part and merged: whole numbers and numbers to numbers, unlike
    ones to text, a part without values to what the others say. Columns that a part lacks are NULL there. The number of
    different headers bounds the plan, not that of the files.
    """
    delimiter = delimiter or delimiter_of(spark, path)
    parts = []
    for names, files in header_catalogue(spark, path, delimiter):
        text = scan_csv(spark, files, delimiter=delimiter, columns=names, **scan_options)
        parts.append(text.select(*[null_tokens_to_null(field(c)).alias(c) for c in text.columns]))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    if infer:
        found = [inferred_types(part, empty="void") for part in parts]
        merged = common_types(found)
        parts = [apply_types(part, types, merged) for part, types in zip(parts, found)]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, infer: bool = True, **scan_options) -> DataFrame:
    """Scan, turn null tokens into NULL and give every column its type."""
    text = scan_csv(spark, path, **scan_options)
    text = text.select(*[null_tokens_to_null(field(c)).alias(c) for c in text.columns])
    return infer_types(text) if infer and text.columns else text


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts under the same column names."""
    if not parts:
        raise ValueError("nothing to concatenate")
    return reduce(lambda left, right: left.unionByName(right), parts)
