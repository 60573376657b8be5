"""Sketches, approximate reducers and rules, and keys that are hot on both sides."""

import pytest
from pyspark.sql import functions as F

from paritas.config import UNIQUE_RULE, Rule, RuleSet
from paritas.operators import sketches
from paritas.operators.aggregates import aggregate
from paritas.operators.matching import Matcher
from paritas.operators.rules import rule_counts


@pytest.fixture
def numbers(spark):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 4 + 1)
    value = F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(40_000)) / 8.0)
    return spark.range(0, 200_000, 1, 8).select(key.alias("k"), (F.col("id") % 10).alias("part"), value.alias("v"),
                                                F.sha2(value.cast("string"), 256).alias("s"), F.lit(None).cast("double").alias("none"))


def errors(found, exact_values):
    """Share of the ranks by which the medians are off."""
    off = []
    for r in found:
        values = exact_values[r.k]
        low, high = sum(v < r.v_p50 for v in values), sum(v <= r.v_p50 for v in values)
        off.append(max(0.0, low / len(values) - 0.5, 0.5 - high / len(values)))
    return off


def test_sketches_merge_to_those_of_the_whole(numbers):
    values = {r.k: r.v for r in numbers.groupBy("k").agg(F.collect_list("v").alias("v")).collect()}
    stored = sketches.value_sketches(numbers, ["k", "part"], ["v", "s", "none"], ["v", "none"])
    assert stored.count() == 30
    for df in (sketches.merged_sketches(stored, ["k"]), sketches.value_sketches(numbers, ["k"], ["v", "s", "none"], ["v", "none"])):
        found = sketches.read_sketches(df, ["k"]).collect()
        assert max(errors(found, values)) < sketches.RANK_ERROR
        for r in found:
            exact = len(set(values[r.k]))
            assert abs(r.v_distinct - exact) < 4 * sketches.DISTINCT_ERROR * exact
            assert abs(r.s_distinct - exact) < 4 * sketches.DISTINCT_ERROR * exact
            assert r.none_distinct == 0 and r.none_p50 is None
        assert sum(r.n_rows for r in found) == 200_000


def test_approximate_reducers(numbers):
    triples = [("v", "median", "m"), ("v", "nunique", "u"), ("v", "max", "top")]
    exact = {r.k: r for r in aggregate(numbers, ["k"], triples).collect()}
    found = aggregate(numbers, ["k"], triples, approx=True).collect()
    assert len(found) == len(exact) == 5
    for r in found:
        assert r.m == pytest.approx(exact[r.k].m, abs=0.01 * 5000) and r.top == exact[r.k].top
        assert abs(r.u - exact[r.k].u) < 4 * sketches.DISTINCT_ERROR * exact[r.k].u


def test_uniqueness_rules_share_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    rules = RuleSet([Rule(c, UNIQUE_RULE) for c in ("l_orderkey", "l_partkey", "l_returnflag")])
    exact, out = rule_counts(df, rules).collect(), rule_counts(df, rules, approx=True)
    found = out.collect()
    for a, b in zip(sorted(exact), sorted(found)):
        assert abs(a.pass_count - b.pass_count) <= 4 * sketches.DISTINCT_ERROR * a.pass_count
        assert a.pass_count + a.fail_count == b.pass_count + b.fail_count and a[:3] == b[:3]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 1
    nothing = rule_counts(df.limit(0), rules, approx=True).collect()
    assert all(r.pass_count == r.fail_count == 0 for r in nothing)


def test_a_key_that_is_hot_on_both_sides(spark):
    source = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                               F.col("id").alias("a"))
    target = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"),
                                               F.col("id").alias("b"))
    # repeated rows on both sides, and keys without a value
    source = source.union(source.where("a < 10")).union(spark.sql("SELECT CAST(NULL AS STRING), 1L FROM range(30)"))
    target = target.union(target.where("b < 10")).union(spark.sql("SELECT CAST(NULL AS STRING), 2L FROM range(40)"))
    matcher = Matcher(source, target, {"key_source": ["k"], "key_target": ["t"], "mappings": {}})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        plain, grid = matcher.matched(), matcher.matched(grid_rows=100)
        digest = [F.count(F.lit(1)), F.sum(F.hash("k", "a", "t", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1_000_003)]
        assert grid.agg(*digest).first() == plain.agg(*digest).first()
        share = [df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] for df in (plain, grid)]
        assert share[0] > 2_000_000 and share[1] < share[0] / 6, share
        assert matcher.merged(grid_rows=100).count() == matcher.merged().count()
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
