"""Random tables: matching and rules must give what the same steps give in pandas."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from paritas.plans import execute_matching, execute_validation, validation_details

SEEDS = (1, 2, 3)


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, (int, float, np.number)) else value


def bag(rows):
    return Counter(tuple(plain(v) for v in row) for row in rows)


def frames(spark, seed):
    rng = random.Random(seed)

    def number():
        return rng.choice([None, 1.0, 2.0, 2.5, float("nan")])

    source = [(rng.choice([None, *range(6)]), rng.choice([None, "x", "y"]), i, number(),
               rng.choice([None, "P", "F", "O"])) for i in range(40)]
    target = [(rng.choice([None, *range(7)]), rng.choice(["x", "y", "z"]), number(),
               rng.choice([None, "PENDING", "F", "O"]), i) for i in range(30)]
    left = spark.createDataFrame(source, "a int, b string, o int, v double, s string")
    right = spark.createDataFrame(target, "c int, d string, w double, t string, n int")
    pandas_left = pd.DataFrame(source, columns=list("abovs")).convert_dtypes()
    pandas_right = pd.DataFrame(target, columns=list("cdwtn")).convert_dtypes()
    return left, right, pandas_left, pandas_right


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("reducer", ["sum", "max", "median"])
def test_matching(spark, seed, reducer):
    left, right, p_left, p_right = frames(spark, seed)
    mapping = {
        "key_source": ["a", "b"], "key_target": ["c", "d"],
        "mappings": {
            "v": {"destinations": ["w"], "function": "Aggregation", "transformation": reducer},
            "s": {"destinations": ["t"], "function": "Conversion mapping", "transformation": '{"P": "PENDING"}'},
        },
    }
    p_left["s"] = p_left["s"].replace({"P": "PENDING"})
    grouped = p_left.sort_values("o").groupby(["a", "b"], as_index=False).agg({"v": reducer, "s": "first"})
    for df, keys in ((grouped, "ab"), (p_right, "cd")):
        for key in keys:
            df[key] = df[key].astype(str)
        for col in df.columns.intersection(["v", "w"]):
            df[col] = df[col].astype("Float64")
    expected = grouped.merge(p_right, left_on=["a", "b", "v", "s"], right_on=["c", "d", "w", "t"],
                             how="outer", indicator=True)
    merged, stats = execute_matching(left, right, mapping, order_by=["o"])
    columns = ["a", "b", "v", "s", "c", "d", "w", "t", "n"]
    want = bag((*row[:-1], str(row[-1])) for row in expected[[*columns, "_merge"]].itertuples(index=False))
    assert bag(merged.select(*columns, "_merge").collect()) == want
    counts = expected["_merge"].value_counts()
    assert tuple(stats.first()) == (counts["both"], counts["right_only"], counts["left_only"])


@pytest.mark.parametrize("seed", SEEDS)
def test_matching_row_by_row(spark, seed):
    left, right, p_left, p_right = frames(spark, seed)
    p_left["a"], p_right["c"] = p_left["a"].astype(str), p_right["c"].astype(str)
    expected = p_left.merge(p_right, left_on=["a"], right_on=["c"], how="outer", indicator=True)
    merged, stats = execute_matching(left, right, {"key_source": ["a"], "key_target": ["c"]})
    assert merged.columns == list(expected.columns)
    want = bag((*row[:-1], str(row[-1])) for row in expected.itertuples(index=False))
    assert bag(merged.collect()) == want
    counts = expected["_merge"].value_counts()
    assert tuple(stats.first()) == (counts["both"], counts["right_only"], counts["left_only"])


@pytest.mark.parametrize("seed", SEEDS)
def test_rules(spark, seed):
    rng = random.Random(seed)
    texts = [None, "1", "2.5", "abc", "-7", " 3 ", "1d", "b1", "inf"]
    data = [(rng.choice(texts), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 2.0, 1e20])) for _ in range(60)]
    df = spark.createDataFrame(data, "t string, i bigint, d double")
    frame = pd.DataFrame(data, columns=["t", "i", "d"]).astype({"t": "string", "i": "Int64", "d": "Float64"})
    allowed = {"t": ["1", "abc", 2], "i": [1, "2", 3.0], "d": [2, 1e20, "0.5"]}
    rules = {c: {"validate_nulls": True, "validate_uniqueness": True, "validate_list_of_values": allowed[c],
                 "validate_regex": r"[12<]|b\d$", "validate_range": True, "min_value": 0, "max_value": 3}
             for c in ("t", "i", "d")}
    got = {(r.column_name, r.rule): (r.pass_count, r.fail_count) for r in execute_validation(df, rules).collect()}
    listed = Counter((r.column_name, r.rule) for r in validation_details(df, rules).collect())
    n = len(frame)
    for name in rules:
        col = frame[name]
        number = pd.to_numeric(col, errors="coerce")
        inside = (number.notna() & (number >= 0) & (number <= 3)).fillna(False)
        outside = ((number < 0) | (number > 3)).fillna(False)
        passing = {
            "Null values": col.notna().sum(),
            "Unique values": col.nunique(),
            "Values outside allowed list": col.isin(allowed[name]).sum(),
            "Values not matching regex": col.astype(str).str.match(r"[12<]|b\d$", na=False).sum(),
            "Values out of range": inside.sum(),
        }
        for rule, count in passing.items():
            assert got[name, rule] == (count, n - count), (name, rule)
        assert listed[name, "Unique values"] == frame.duplicated(subset=[name], keep=False).sum()
        assert listed[name, "Values out of range"] == outside.sum()
        assert listed[name, "Null values"] == col.isna().sum()


POOLS = {
    "text": ["a", "", '""', '"a,b"', '"x""y"', "1", " 2 ", "NA", 'ab"c', "n/a", "é", "-"],
    "whole": ["1", "007", "-3", "", "NA", "2.0", "1e2", "+5"],
    "number": ["1.5", ".5", "2", "", "1e-3", "-inf", "null"],
    "flag": ["True", "FALSE", "", "true"],
    "mixed": ["1", "True", "x", ""],
    "none": ["", "NA", "NaN"],
}
KINDS = {"Int64": "bigint", "Float64": "double", "boolean": "boolean", "string": "string"}


@pytest.mark.parametrize("seed", SEEDS)
def test_reading_text_files(spark, tmp_path, seed):
    from paritas import sources

    rng = random.Random(seed)
    names = list(POOLS)
    lines = [",".join(names), ",".join("1" for _ in names)]
    lines[1] = "a,1,1.5,True,x,"
    for _ in range(200):
        width = rng.choice([2, 3, 5, 6, 6, 6, 6, 6, 6, 7, 8])
        fields = [rng.choice(POOLS[name]) for name in names][:width] + ["z"] * (width - 6)
        if width > 6 and rng.random() < 0.5:
            fields[6] = ""
        lines.append(",".join(fields) if rng.random() > 0.03 else rng.choice(["", "   "]))
    path = tmp_path / "table.csv"
    path.write_text("\n".join(lines) + "\n")
    expected = pd.read_csv(path, sep=",", on_bad_lines="skip", low_memory=False).convert_dtypes()
    df = sources.read_csv(spark, str(path))
    assert dict(df.dtypes) == {c: KINDS[str(t)] for c, t in expected.dtypes.items()}
    assert bag(df.collect()) == bag(expected.itertuples(index=False))
