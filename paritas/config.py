"""The declarative configs: how columns map, and which rules a table must obey."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

# Spellings used inside the configs.
DIRECT = "Direct mapping"
CONVERSION = "Conversion mapping"
AGGREGATION = "Aggregation"

NULL_RULE = "Null values"
UNIQUE_RULE = "Unique values"
ALLOWED_RULE = "Values outside allowed list"
REGEX_RULE = "Values not matching regex"
RANGE_RULE = "Values out of range"


class ConfigError(ValueError):
    """A config that cannot be carried out."""


@dataclass(frozen=True)
class ColumnMapping:
    column: str
    function: str
    destinations: tuple[str, ...] = ()
    dictionary: Mapping[str, str] | None = None
    reducer: str | None = None

    @property
    def contributes(self) -> bool:
        """A conversion without a dictionary leaves no column behind."""
        return self.function != CONVERSION or self.dictionary is not None


@dataclass(frozen=True)
class TableMapping:
    source_keys: tuple[str, ...]
    target_keys: tuple[str, ...]
    columns: tuple[ColumnMapping, ...] = ()

    @classmethod
    def of(cls, config: Mapping | TableMapping) -> TableMapping:
        if isinstance(config, TableMapping):
            return config
        return cls(
            tuple(config.get("key_source") or ()),
            tuple(config.get("key_target") or ()),
            tuple(_column_mapping(c, entry) for c, entry in (config.get("mappings") or {}).items()),
        )

    @property
    def contributing(self) -> list[ColumnMapping]:
        return [entry for entry in self.columns if entry.contributes]

    @property
    def joined(self) -> list[tuple[str, str]]:
        """Value columns to compare. Of several destinations the last one counts."""
        return [(e.column, e.destinations[-1]) for e in self.columns if e.destinations]

    def require_keys(self) -> None:
        if not self.source_keys or not self.target_keys:
            raise ConfigError("both the source and the target need key columns")
        if len(self.source_keys) != len(self.target_keys):
            raise ConfigError("source and target need equally many key columns")


def _column_mapping(column: str, entry: Mapping) -> ColumnMapping:
    function, detail = entry.get("function"), entry.get("transformation")
    destinations = tuple(entry.get("destinations") or ())
    if function == DIRECT:
        return ColumnMapping(column, function, destinations)
    if function == CONVERSION:
        table = json.loads(detail) if isinstance(detail, str) and detail else detail or None
        if table is not None and not isinstance(table, Mapping):
            raise ConfigError(f"conversion of {column!r} needs an object of texts")
        # a value without a target keeps its own text
        texts = None if table is None else {str(k): str(v) for k, v in table.items() if v is not None}
        return ColumnMapping(column, function, destinations, dictionary=texts)
    if function == AGGREGATION:
        if not detail:
            raise ConfigError(f"aggregation of {column!r} names no reducer")
        return ColumnMapping(column, function, destinations, reducer=detail)
    raise ConfigError(f"unknown mapping function {function!r} for column {column!r}")


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    allowed: tuple = ()
    pattern: str = ""
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()
    skipped: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, config: Mapping, columns: list[str]) -> RuleSet:
        """Rules in config order. Columns that the table lacks are skipped and listed."""
        rules: list[Rule] = []
        for column, entry in config.items():
            if column in columns:
                rules += _rules(column, entry)
        return cls(tuple(rules), tuple(c for c in config if c not in columns))


def _rules(column: str, entry: Mapping) -> list[Rule]:
    found = []
    if entry.get("validate_nulls"):
        found.append(Rule(column, NULL_RULE))
    if entry.get("validate_uniqueness"):
        found.append(Rule(column, UNIQUE_RULE))
    if "validate_list_of_values" in entry:
        allowed = entry["validate_list_of_values"]
        if not isinstance(allowed, (list, tuple, set, frozenset)):
            raise ConfigError(f"the allowed values of {column!r} must be a list")
        found.append(Rule(column, ALLOWED_RULE, allowed=tuple(allowed)))
    if "validate_regex" in entry:
        found.append(Rule(column, REGEX_RULE, pattern=entry["validate_regex"]))
    if entry.get("validate_range"):
        low, high = entry.get("min_value"), entry.get("max_value")
        found.append(
            Rule(column, RANGE_RULE, low=None if low is None else float(low),
                 high=None if high is None else float(high))
        )
    return found
