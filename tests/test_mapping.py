"""Conversion, reducers and the mapping of a source."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from paritas.config import ConfigError, TableMapping
from paritas.operators import aggregates, keys, mapping
from paritas.operators.quantiles import exact_quantiles


def config(key="k", **columns):
    return {"key_source": [key], "key_target": ["t"], "mappings": columns}


def direct(*to):
    return {"destinations": list(to), "function": "Direct mapping", "transformation": None}


def by_key(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_first_is_the_first_known_value_and_null_keys_drop(spark):
    df = spark.createDataFrame(
        [(1, "a", 3, None), (1, "a", 1, None), (1, "a", 2, "x"), (2, "b", 1, None), (None, "c", 1, "y"),
         (3, "d", 1, "z")], "k int, s string, o int, v string")
    out = mapping.apply_rules(df, config(v=direct("w")), order_by=["o"])
    assert by_key(out) == {1: ("x",), 2: (None,), 3: ("z",)}


def test_reducers_on_missing_groups(spark):
    df = spark.createDataFrame(
        [(1, None), (1, float("nan")), (2, 1.0), (2, 4.0), (2, None), (2, 2.0), (3, 5.0)], "k int, v double")
    names = ["sum", "mean", "median", "min", "max", "count", "nunique", "std", "var", "prod"]
    out = by_key(aggregates.aggregate(df, ["k"], [("v", n, n) for n in names]))
    assert out[1] == (0.0, None, None, None, None, 0, 0, None, None, 1.0)
    assert out[2][:7] == (7.0, 7 / 3, 2.0, 1.0, 4.0, 3, 3)
    assert out[2][7] == pytest.approx(statistics.stdev([1, 4, 2]))
    assert out[2][9] == 8.0
    assert out[3][7:9] == (None, None)


def test_composite_keys_need_every_component(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 3), (None, 1, 4), ("a", 1, 5)], "k string, l int, v int")
    out = aggregates.aggregate(df, ["k", "l"], [("v", "sum", "v")])
    assert [tuple(r) for r in out.collect()] == [("a", 1, 7)]


def test_last_and_order_ties(spark):
    df = spark.createDataFrame([(1, 1, 2, "a"), (1, 1, 1, "b"), (1, 2, 1, None)], "k int, o int, p int, v string")
    out = aggregates.aggregate(df, ["k"], [("v", "first", "f"), ("v", "last", "l")], order_by=["o", "p"])
    assert by_key(out) == {1: ("b", "a")}


def test_conversion_falls_back_to_the_value(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (4, float("nan"))], "k int, v double")
    entry = {"destinations": ["w"], "function": "Conversion mapping",
             "transformation": '{"1.0": "one", "<NA>": "none"}'}
    out = mapping.apply_rules(df, config(v=entry), order_by=["k"])
    assert by_key(out) == {1: ("one",), 2: ("2.5",), 3: ("none",), 4: ("none",)}


def test_large_dictionary_uses_a_join(spark):
    table = {str(i): f"v{i}" for i in range(500)}
    df = spark.range(0, 1000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    out = mapping.convert_column(df, "v", table)
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == ["k", "v"]
    expected = {i: (f"v{i}" if i < 500 else str(i),) for i in range(1000)}
    assert by_key(out) == expected


def test_mapping_without_effect_keeps_rows(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k int, v int")
    assert mapping.apply_rules(df, config()).collect() == df.collect()
    empty = {"destinations": ["w"], "function": "Conversion mapping", "transformation": ""}
    assert mapping.apply_rules(df, config(v=empty)).collect() == df.collect()


@pytest.mark.parametrize("entry, message", [
    ({"function": "Direct Match", "destinations": ["w"]}, "unknown mapping function"),
    ({"function": "Aggregation", "destinations": ["w"], "transformation": "sums"}, "unknown reducer"),
    ({"function": "Aggregation", "destinations": ["w"], "transformation": "mean"}, "needs numbers"),
    ({"function": "Direct mapping", "destinations": ["w"]}, "order"),
])
def test_bad_configs_are_named(spark, entry, message):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ConfigError, match=message):
        mapping.apply_rules(df, config(v=entry))


def test_last_destination_is_compared():
    plan = TableMapping.of(config(v=direct("a", "b")))
    assert plan.joined == [("v", "b")]


def test_scaled_sums_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, 0.1)] * 10 + [(2, 1e15), (2, 0.3)], "k int, v double")
    entry = {"destinations": ["w"], "function": "Aggregation", "transformation": "sum"}
    out = mapping.apply_rules(df, config(v=entry), scale=2)
    assert {k: str(v[0]) for k, v in by_key(out).items()} == {1: "1.00", 2: "1000000000000000.30"}


def test_key_helpers(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (None, None)], "k int, v string")
    assert [tuple(r) for r in keys.prepare_keys(df, ["k"]).collect()] == [("1", None), ("__NA__", "a")]
    unique = lambda d, k: keys.keys_are_unique(d, k).first().is_unique
    assert unique(df, ["k"]) is True
    assert unique(df, []) is False
    assert unique(df.limit(0), ["k"]) is False
    assert unique(df.union(df), ["k"]) is False


def test_distinct_value_targets(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    small = mapping.distinct_value_targets(df, "v", {"a": "A"})
    large = mapping.distinct_value_targets(df, "v", {"a": "A", **{str(i): "x" for i in range(200)}})
    for out in (small, large):
        assert by_key(out) == {"a": ("A", 2), "b": ("", 1), "<NA>": ("", 0)}


def quantile(items, q):
    items, pos = sorted(items), q * (len(items) - 1)
    low, high = items[math.floor(pos)], items[math.ceil(pos)]
    return low if low == high else low + (high - low) * (pos - math.floor(pos))


def test_exact_quantiles_against_brute_force(spark):
    rng = random.Random(5)
    groups = {
        "uniform": [rng.uniform(-5, 5) for _ in range(997)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(500)],
        "close": [1.0 + i * 2.0**-52 for i in range(400)],
        "hot": [3.25] * 900 + [1.0, 2.0, 4.0],
        "signed": [-2.0, -1.0, 0.0, -0.0, 1.0, 2.0],
        "tiny": [5e-324, 1e-323, 0.0, -5e-324],
        "one": [42.0],
        "infinite": [float("-inf"), 1.0, 2.0, float("inf")],
    }
    data = [(k, v) for k, items in groups.items() for v in items]
    rng.shuffle(data)
    df = spark.createDataFrame([*data, ("none", None), ("none", float("nan"))], "k string, v double")
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for key, items in groups.items():
        for name, q in wanted.items():
            expected = quantile(items, q)
            if math.isnan(expected):  # between the infinities
                assert got[key][name] is None
            else:
                assert got[key][name] == pytest.approx(expected, rel=1e-15, abs=0.0), (key, name)


def test_quantiles_read_the_table_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = exact_quantiles(df, ["l_returnflag"], "l_extendedprice", {"m": 0.5})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") >= 2
