"""Alignment of a mapped source with a target.

Two rows match when their keys agree as text and all mapped values agree, missing with missing.
Spark cannot split a hot key in a full outer join, so the aligned table is put together from
joins that it can split: an inner join and two anti joins against distinct keys. The statistics
need no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConfigError, TableMapping
from ..functions import field, fields, fold_nan, quoted, stringify, typed
from .keys import cast_keys, join_key
from .mapping import apply_rules
from .profiling import seeded_sample

# The name and the texts of the indicator.
INDICATOR = "_merge"
BOTH, LEFT_ONLY, RIGHT_ONLY = "both", "left_only", "right_only"

# Names of columns that live inside a join only.
_HELPER, _FOUND = "_paritas_k", "_paritas_found"
# Places of a row in the grid of a combination that is hot on both sides.
_LINE, _COLUMN, _CELL, _NUMBER = "_paritas_line", "_paritas_column", "_paritas_cell", "_paritas_number"
# Rows of a combination on either side, and among them those with each set of NaN values.
_OURS, _THEIRS, _REPEAT = "_paritas_s", "_paritas_t", "_paritas_n"
#: Binary columns of a side up to which equal rows are counted instead of joined; NaN and NULL match, so each
#: set of columns that hold NaN has a count of its own.
COUNTED_BINARY = 3
#: Equal rows that one task writes out of one count; more are cut into pieces and dealt over the tasks.
COUNTED_ROWS = 10_000
#: Cells of all grids for each task of a shuffle or core, and the most rows of a side and the most pairs that one cell holds.
CELLS_A_TASK, CELL_ROWS, CELL_PAIRS = 4, 100_000, 5_000_000
#: Tasks a core, at least, that join the cells: in fewer, one may hold twice the pairs of others, and all wait for it.
TASKS_A_CORE = 16
# Digits of the largest value of each integral type.
_WHOLE_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(dtype, T.StringType) else dtype.simpleString()


@dataclass(frozen=True)
class Side:
    """One table ready to be compared. ``comparable`` maps the names of helper columns to the
    comparable form of each key and value."""

    rows: DataFrame
    columns: tuple[str, ...]
    compared: tuple[str, ...]
    comparable: Mapping[str, Column]

    def keyed(self) -> DataFrame:
        return self.rows.withColumns(dict(self.comparable))

    def distinct(self) -> DataFrame:
        """Distinct combinations of the helpers, reduced on the map side."""
        seen = self.rows.select(*fields(dict.fromkeys(self.compared))).distinct()
        return seen.select(*[col.alias(name) for name, col in self.comparable.items()])


@dataclass(frozen=True)
class Alignment:
    source: Side
    target: Side
    source_is_unique: bool

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.source.compared, self.target.compared))

    @property
    def helpers(self) -> list[str]:
        return list(self.source.comparable)


def align(
    source: DataFrame,
    target: DataFrame,
    mapping: Mapping | TableMapping,
    order_by: Sequence[str] | None = None,
    scale: int | None = None,
) -> Alignment:
    plan = TableMapping.of(mapping)
    plan.require_keys()
    mapped = cast_keys(apply_rules(source, plan, order_by, scale), plan.source_keys)
    # Renewed columns, since source and target may stem from the same DataFrame.
    renewed = target.select(*[field(name).alias(name) for name in target.columns])
    keyed = cast_keys(renewed, plan.target_keys)
    pairs = [*zip(plan.source_keys, plan.target_keys), *plan.joined]
    for side, df in (("source", mapped), ("target", keyed)):
        if INDICATOR in [name.lower() for name in df.columns]:
            raise ConfigError(f"the {side} has a column {INDICATOR!r}, which is the indicator's name")
    left, right = {}, {}
    for place, (a, b) in enumerate(pairs):
        if a not in mapped.columns:
            raise ConfigError(f"column {a!r} is compared, but its mapping yields no column")
        if b not in keyed.columns:
            raise ConfigError(f"the target has no column {b!r}")
        if place < len(plan.source_keys):
            forms = join_key(field(a)), join_key(field(b))
        else:
            forms = _comparable(a, mapped.schema[a].dataType, b, keyed.schema[b].dataType, scale)
        left[f"{_HELPER}{place}"], right[f"{_HELPER}{place}"] = forms
    return Alignment(
        Side(mapped, tuple(mapped.columns), tuple(a for a, _ in pairs), left),
        Side(keyed, tuple(keyed.columns), tuple(b for _, b in pairs), right),
        bool(plan.contributing),
    )


def _comparable(a: str, left: T.DataType, b: str, right: T.DataType, scale: int | None):
    if _kind(left) != _kind(right):
        raise ConfigError(
            f"cannot compare {a!r} ({left.simpleString()}) with {b!r} ({right.simpleString()})"
        )
    one, other = fold_nan(field(a), left), fold_nan(field(b), right)
    if _kind(left) == "number":
        if scale is not None:
            wide = T.DecimalType(38, scale)
            return one.cast(wide), other.cast(wide)
        if left != right:
            wide = _common_number(a, left, b, right)
            return one.cast(wide), other.cast(wide)
    elif left != right:
        return one.cast("timestamp"), other.cast("timestamp")
    return one, other


def _digits(dtype: T.DataType) -> tuple[int, int] | None:
    """Digits before and behind the point of an exact type; nothing for binary fractions."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    whole = _WHOLE_DIGITS.get(dtype.simpleString())
    return None if whole is None else (whole, 0)


def _common_number(a: str, left: T.DataType, b: str, right: T.DataType) -> T.DataType:
    """A type in which both sides keep their exact values, if both are exact."""
    one, other = _digits(left), _digits(right)
    if one is None or other is None:
        return T.DoubleType()
    whole, scale = max(one[0], other[0]), max(one[1], other[1])
    if scale == 0 and whole <= 19 and not isinstance(left, T.DecimalType) and not isinstance(right, T.DecimalType):
        return T.LongType()
    if whole + scale > 38:
        raise ConfigError(f"{a!r} ({left.simpleString()}) and {b!r} ({right.simpleString()}) have no common "
                          "decimal type; say with scale= how many digits count")
    return T.DecimalType(whole + scale, scale)


def _is_kept(dtype: T.DataType, wider: T.DataType) -> bool:
    """Whether values of ``dtype`` come back from ``wider`` as they were."""
    if dtype == wider:
        return True
    if isinstance(wider, T.DoubleType):
        return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType))
    own, other = _digits(dtype), _digits(wider)
    return own is not None and other is not None and own[0] <= other[0] and own[1] <= other[1]


def _same(left: DataFrame, right: DataFrame, helpers: Sequence[str], keys: int) -> Column:
    """Keys are never NULL once they are text; values are compared null-safe."""
    parts = [
        left[h] == right[h] if place < keys else left[h].eqNullSafe(right[h])
        for place, h in enumerate(helpers)
    ]
    return reduce(lambda a, b: a & b, parts)


class Matcher:
    """Lazy results of aligning a source with a target."""

    def __init__(
        self,
        source: DataFrame,
        target: DataFrame,
        mapping: Mapping | TableMapping,
        order_by: Sequence[str] | None = None,
        scale: int | None = None,
    ):
        self.plan = TableMapping.of(mapping)
        self.sides = align(source, target, self.plan, order_by, scale)

    @property
    def mapped_source(self) -> DataFrame:
        return self.sides.source.rows

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        return _same(left, right, self.sides.helpers, len(self.plan.source_keys))

    # -- output columns -------------------------------------------------------------------

    def _layout(self) -> list[tuple[str, str | None, str | None]]:
        """``(output name, source column, target column)``.

        A pair under one name becomes one column; other clashes get ``_x`` and ``_y``, names that
        differ only in case included.
        """
        shared = {a for a, b in self.sides.pairs if a == b}
        ours, theirs = self.sides.source.columns, self.sides.target.columns
        clashing = ({n.lower() for n in ours} & {n.lower() for n in theirs}) - {n.lower() for n in shared}
        layout: list[tuple[str, str | None, str | None]] = [
            (f"{name}_x" if name.lower() in clashing else name, name, name if name in shared else None)
            for name in ours
        ]
        layout += [(f"{name}_y" if name.lower() in clashing else name, None, name)
                   for name in theirs if name not in shared]
        return layout

    def _shape(self, rows: DataFrame, indicator: str | Column, left=None, right=None) -> DataFrame:
        """Output columns of ``rows``; those of an absent side are NULL."""
        out = []
        for name, a, b in self._layout():
            found = [side[quoted(column)] for side, column in ((left, a), (right, b))
                     if side is not None and column is not None]
            if not found:
                side, column = (self.sides.source, a) if a is not None else (self.sides.target, b)
                found = [F.lit(None).cast(side.rows.schema[column].dataType)]
            out.append((F.coalesce(*found) if len(found) > 1 else found[0]).alias(name))
        label = F.lit(indicator) if isinstance(indicator, str) else indicator
        return rows.select(*out, label.alias(INDICATOR))

    # -- rows -----------------------------------------------------------------------------

    def matched(self, grid_rows: int | None = None) -> DataFrame:
        """Rows present on both sides.

        A combination with many rows on both sides yields their product, which no join can split on either side
        alone. With ``grid_rows`` such combinations, of at least so many rows on each side, are cut into grids: rows of
        one side are dealt over its lines and repeated for its columns, those of the other the other way round, and the
        cells are joined. All grids together have a few cells a task, of about ``grid_rows`` by ``grid_rows`` rows at
        least: finer ones would only repeat more rows. Cells of large products are cut further, to ``CELL_PAIRS``, and
        dealt over many tasks a core, whatever the number of shuffle partitions. All others are joined as they are.
        """
        left, right = self.sides.source.keyed(), self.sides.target.keyed()
        if grid_rows is None or self.sides.source_is_unique:
            return self._shape(left.join(right, self._same(left, right), "inner"), BOTH, left, right)
        spark = left.sparkSession
        tasks, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
        grids = self._grids(grid_rows, max(tasks, cores))
        tasks = max(tasks, TASKS_A_CORE * cores)
        cold = left.join(grids, self._of_grid(), "left_anti")
        # renewed columns, here and below, since the grids stem from both sides
        right = right.select(*[field(c).alias(c) for c in right.columns])
        rows = self._shape(cold.join(right, self._same(cold, right), "inner"), BOTH, cold, right)
        left = self._dealt(self.sides.source, grids, _LINE, _COLUMN, tasks)
        right = self._dealt(self.sides.target, grids, _COLUMN, _LINE, tasks)
        return rows.unionByName(self._shape(left.join(right, left[_CELL] == right[_CELL], "inner"), BOTH, left, right))

    def _grids(self, grid_rows: int, tasks: int) -> DataFrame:
        """The combinations with many rows on both sides, at most one in ``grid_rows`` rows, with the lines and columns
        of their grids.

        A grid gets cells by its share of all products. Its lines and columns are as the rows of the two sides, which
        repeats the fewest rows, at most about the root of the number of cells times; only cells with more than
        ``CELL_ROWS`` rows of a side are cut further, for the memory of a task, and those with more than ``CELL_PAIRS``,
        for its time.
        """
        helpers = self.sides.helpers
        left, right = self.sides.source.keyed(), self.sides.target.keyed()
        stacked = left.select(*helpers, F.lit(1).alias(_OURS), F.lit(0).alias(_THEIRS)).unionByName(
            right.select(*helpers, F.lit(0).alias(_OURS), F.lit(1).alias(_THEIRS)))
        sizes = stacked.groupBy(*helpers).agg(F.sum(_OURS).alias(_OURS), F.sum(_THEIRS).alias(_THEIRS)).where(
            (F.col(_OURS) >= grid_rows) & (F.col(_THEIRS) >= grid_rows))
        ours, theirs = F.col(_OURS).cast("double"), F.col(_THEIRS).cast("double")
        share = F.least(F.lit(float(CELL_PAIRS)), F.greatest(F.lit(float(grid_rows) ** 2), F.col("_all") / (CELLS_A_TASK * tasks)))
        cells = sizes.crossJoin(sizes.agg(F.sum(ours * theirs).alias("_all"))).withColumn("_cells", F.ceil(ours * theirs / share))

        def cuts(own: Column, other: Column) -> Column:
            even = F.least(F.col("_cells"), F.ceil(F.sqrt(F.col("_cells") * own / other)), F.ceil(own / grid_rows))
            return F.greatest(even, F.ceil(own / CELL_ROWS))

        return cells.select(*[F.col(h).alias(f"{h}_hot") for h in helpers], cuts(ours, theirs).alias(f"{_LINE}_hot"),
                            cuts(theirs, ours).alias(f"{_COLUMN}_hot"))

    def _of_grid(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(h).eqNullSafe(F.col(f"{h}_hot")) for h in self.sides.helpers])

    def _dealt(self, side: Side, grids: DataFrame, own: str, other: str, tasks: int) -> DataFrame:
        """The rows of ``side`` that have a grid, each in one place of ``own`` and all of ``other``, with their cell.

        Rows get their numbers where they are read, not behind a join that may order them otherwise when a task runs
        again. Cells are spread over a fixed number of tasks: by their size in bytes adaptive execution would put many
        into one.
        """
        numbered = side.keyed().withColumn(_NUMBER, F.monotonically_increasing_id())
        placed = numbered.join(grids, self._of_grid(), "inner").select(
            *fields([*side.columns, *self.sides.helpers]),
            F.pmod(F.xxhash64(_NUMBER), F.col(f"{own}_hot")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_hot") - 1)).alias(other))
        # NULL equals NULL within a struct. Both sides need one type, what may be NULL included, to be joined as they lie.
        cell = F.struct(*self.sides.helpers, _LINE, _COLUMN)
        cell = cell.cast(placed.select(cell).schema[0].dataType.simpleString())
        return placed.select(*[field(c).alias(c) for c in side.columns], cell.alias(_CELL)).repartition(tasks, _CELL)

    def left_only(self) -> DataFrame:
        """Source rows without a partner."""
        left, seen = self.sides.source.keyed(), self.sides.target.distinct()
        rows = left.join(seen, self._same(left, seen), "left_anti")
        return self._shape(rows, LEFT_ONLY, left=left)

    def right_only(self) -> DataFrame:
        """Target rows without a partner."""
        right, seen = self.sides.target.keyed(), self._seen_source()
        rows = right.join(seen, self._same(right, seen), "left_anti")
        return self._shape(rows, RIGHT_ONLY, right=right)

    def unmatched(self) -> DataFrame:
        """Rows of either side without a partner.

        Where every column of both sides is compared, rows are told apart by nothing else: both sides are
        stacked and counted per combination, and rows are written again from the counts of combinations
        that one side lacks. That takes a shuffle reduced on the map side and one of the counts left, and no
        join; a negative zero comes out as zero. Other tables take an anti join on each side.
        """
        if self._all_is_compared():
            return self._counted_difference()
        return self.left_only().unionByName(self.right_only())

    def _all_is_compared(self) -> bool:
        """Whether the rows of both sides follow from the compared combination."""
        for side in (self.sides.source, self.sides.target):
            if set(side.columns) != set(side.compared) or len(self._binary(side)) > COUNTED_BINARY:
                return False
            shape = side.keyed().schema
            if not all(_is_kept(shape[column].dataType, shape[helper].dataType)
                       for column, helper in zip(side.compared, self.sides.helpers)):
                return False
        return True

    @staticmethod
    def _binary(side: Side) -> list[str]:
        return [name for name in side.columns if isinstance(side.rows.schema[name].dataType, (T.FloatType, T.DoubleType))]

    def _counted_difference(self) -> DataFrame:
        helpers, source, target = self.sides.helpers, self.sides.source, self.sides.target

        def counters(side: Side, own: str, other: str) -> DataFrame:
            """Helpers, and one array of counts a side: a one in the place of the row's set of NaN values."""
            nan = [F.when(F.isnan(field(name)), 1 << place).otherwise(0)
                   for place, name in enumerate(self._binary(side))]
            kind = reduce(lambda a, b: a + b, nan, F.lit(0))
            return side.keyed().select(*helpers, *[
                F.when(kind == place, 1).otherwise(0).cast("long").alias(f"{own}{place}")
                for place in range(1 << len(nan))])

        stacked = counters(source, _OURS, _THEIRS).unionByName(
            counters(target, _THEIRS, _OURS), allowMissingColumns=True)
        kinds = {side: range(1 << len(self._binary(rows))) for side, rows in ((_OURS, source), (_THEIRS, target))}
        counts = [f"{side}{place}" for side, places in kinds.items() for place in places]
        sizes = stacked.groupBy(*helpers).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
        ours, theirs = (reduce(lambda a, b: a + b, [F.col(f"{side}{place}") for place in places])
                        for side, places in kinds.items())
        cells = F.array(*[F.struct(F.lit(side == _OURS).alias("left"), F.lit(place).alias("nan"), F.col(f"{side}{place}").alias("n"))
                          for side, places in kinds.items() for place in places])
        lonely = sizes.where((ours == 0) | (theirs == 0)).select(*helpers, F.inline(cells)).where("n > 0")

        # Pieces of counts are dealt over a fixed number of tasks: by their size in bytes adaptive execution would
        # put many into one, and each stands for up to COUNTED_ROWS rows.
        tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pieces = lonely.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COUNTED_ROWS))))
        rows = pieces.repartition(tasks, *helpers, "left", "nan", "_piece").withColumn(_REPEAT, F.explode(F.sequence(
            F.lit(1).cast("long"), F.least(F.lit(COUNTED_ROWS), F.col("n") - F.col("_piece") * COUNTED_ROWS))))

        def original(side: Side, name: str) -> Column:
            dtype = side.rows.schema[name].dataType
            value = F.col(helpers[side.compared.index(name)]).cast(dtype)
            binary = self._binary(side)
            if name not in binary:
                return value
            bit = F.col("nan").bitwiseAND(1 << binary.index(name))
            return F.when(bit != 0, F.lit(float("nan")).cast(dtype)).otherwise(value)

        out = []
        for name, a, b in self._layout():
            left = None if a is None else original(source, a)
            right = None if b is None else original(target, b)
            if left is None:
                out.append(F.when(~F.col("left"), right).alias(name))
            elif right is None:
                out.append(F.when(F.col("left"), left).alias(name))
            else:
                out.append(F.when(F.col("left"), left).otherwise(right).alias(name))
        return rows.select(*out, F.when(F.col("left"), LEFT_ONLY).otherwise(RIGHT_ONLY).alias(INDICATOR))

    def merged(self, grid_rows: int | None = None) -> DataFrame:
        """All rows of both sides with the indicator; ``grid_rows`` as for ``matched``.

        When the source holds one row per key the target can be joined from the left, which
        finds matched and target-only rows together.
        """
        if not self.sides.source_is_unique:
            return self.matched(grid_rows).unionByName(self.unmatched())
        left = self.sides.source.keyed().withColumn(_FOUND, F.lit(True))
        right = self.sides.target.keyed()
        rows = right.join(left, self._same(right, left), "left")
        label = F.when(left[_FOUND].isNull(), RIGHT_ONLY).otherwise(BOTH)
        return self._shape(rows, label, left, right).unionByName(self.left_only())

    def sample(self, key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
        """The same ``n`` merged rows for the same seed, with ``is_match`` to part those on both sides
        from the others. ``key`` names output columns that tell the merged rows apart."""
        rows = seeded_sample(self.merged(), key, n, seed)
        return rows.withColumn("is_match", F.col(INDICATOR) == BOTH)

    # -- counts ---------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """``total_match, missing_source, missing_target`` in merged rows.

        Both sides are counted per compared combination and the counts multiplied, so the
        matching rows are never formed. One shuffle, reduced on the map side, and no join.
        """
        helpers = self.sides.helpers
        left = self.sides.source.keyed().select(*helpers, F.lit(1).alias("_s"), F.lit(0).alias("_t"))
        right = self.sides.target.keyed().select(*helpers, F.lit(0).alias("_s"), F.lit(1).alias("_t"))
        sizes = left.unionByName(right).groupBy(*helpers).agg(
            F.sum("_s").alias("_s"), F.sum("_t").alias("_t")
        )

        def total(amount: Column) -> Column:
            return F.coalesce(F.sum(amount), F.lit(0)).cast("bigint")

        return sizes.agg(
            total(F.col("_s") * F.col("_t")).alias("total_match"),
            total(F.when(F.col("_s") == 0, F.col("_t"))).alias("missing_source"),
            total(F.when(F.col("_t") == 0, F.col("_s"))).alias("missing_target"),
        )

    def _seen_source(self) -> DataFrame:
        """Source combinations without repetition."""
        source = self.sides.source
        return source.keyed() if self.sides.source_is_unique else source.distinct()

    def matched_keys(self) -> DataFrame:
        """Distinct keys, as text, among the matched rows."""
        left, right = self._seen_source(), self.sides.target.distinct()
        both = left.join(right, self._same(left, right), "left_semi")
        keys = both.select(*self.sides.helpers[: len(self.plan.source_keys)])
        return keys if self.sides.source_is_unique else keys.distinct()

    def source_with_partner(self) -> DataFrame:
        """Mapped source rows whose key occurs among the matched rows."""
        source = self.sides.source
        if not self.sides.source_is_unique:
            return rows_with_keys(source.rows, self.plan.source_keys, self.matched_keys())
        left, right = source.keyed(), self.sides.target.distinct()
        both = left.join(right, self._same(left, right), "left_semi")
        return both.select(*fields(source.columns))


def rows_with_keys(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows whose keys, as text, occur among the rows of ``wanted`` (key columns in order)."""
    names = [f"_w{place}" for place in range(len(keys))]
    seen = wanted.toDF(*names).distinct().select(*[join_key(F.col(n)).alias(n) for n in names])
    texts = [join_key(stringify(*typed(df, k))) for k in keys]
    keyed = df.withColumns({f"_t{place}": text for place, text in enumerate(texts)})
    same = reduce(lambda a, b: a & b, [F.col(f"_t{i}") == F.col(n) for i, n in enumerate(names)])
    return keyed.join(seen, same, "left_semi").select(*fields(df.columns))


def first_per_key(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Values of the first row per key, missing values included.

    A minimum over structs instead of a ranking window: it combines on the map side, so a hot
    key never travels to one task as a whole.
    """
    first = F.min_by(F.struct(*fields(values)), F.struct(*fields(order_by)))
    rows = df.groupBy(*fields(keys)).agg(first.alias("_first"))
    return rows.select(*fields(keys), *[F.col("_first")[v].alias(v) for v in values])
