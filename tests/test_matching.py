"""Alignment of two tables: the edge frames, naming, and hot keys."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paritas.config import ConfigError
from paritas.operators.accuracy import key_match_stats, mapping_accuracy
from paritas.operators.matching import Matcher, first_per_key
from paritas.plans import evaluate_mapping, execute_matching

DIRECT = "Direct mapping"


def mapping(keys, **columns):
    return {
        "key_source": [k for k, _ in keys],
        "key_target": [t for _, t in keys],
        "mappings": {c: {"destinations": [d], "function": DIRECT} for c, d in columns.items()},
    }


def kinds(df):
    return Counter(r["_merge"] for r in df.collect())


def stats(row):
    return tuple(row.collect()[0])


@pytest.fixture
def pair(spark):
    source = spark.createDataFrame([("1", 1.0, 1), ("2", None, 2), ("3", 3.0, 3)], "k string, v double, z int")
    target = spark.createDataFrame(
        [("1", 1.0, 7), ("2", None, 8), ("3", 4.0, 9), ("nan", 1.0, 9)], "k2 string, w double, z int")
    return source, target


def test_values_compare_null_safe(pair):
    merged, counts = execute_matching(*pair, mapping([("k", "k2")], v="w"), order_by=["z"])
    assert kinds(merged) == {"both": 2, "left_only": 1, "right_only": 2}
    assert stats(counts) == (2, 2, 1)


def test_nan_equals_null(spark, pair):
    source = pair[0].withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    merged, counts = execute_matching(source, pair[1], mapping([("k", "k2")], v="w"), order_by=["z"])
    assert kinds(merged) == {"both": 2, "left_only": 1, "right_only": 2}
    assert stats(counts) == (2, 2, 1)


def test_null_keys_meet_only_without_grouping(spark):
    source = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    target = spark.createDataFrame([(None,), ("<NA>",), ("1",)], "t string")
    plain = Matcher(source, target, mapping([("k", "t")]))
    assert kinds(plain.merged()) == {"both": 3}
    assert stats(plain.stats()) == (3, 0, 0)
    mapped = {**mapping([("k", "t")]), "mappings": {"v": {"function": DIRECT, "destinations": []}}}
    grouped = Matcher(source, target, mapped, order_by=["v"])
    assert kinds(grouped.merged()) == {"both": 1, "right_only": 2}
    assert stats(grouped.stats()) == (1, 2, 0)


def test_duplicates_multiply(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    target = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "t int, w string")
    m = Matcher(source, target, mapping([("k", "t")]))
    assert kinds(m.merged()) == {"both": 4, "left_only": 1, "right_only": 1}
    assert stats(m.stats()) == (4, 1, 1)
    assert m.matched().count() == 4 and m.left_only().count() == 1 and m.right_only().count() == 1
    assert [r[0] for r in m.matched_keys().collect()] == ["1"]


def test_column_names(spark):
    source = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, val string, note int")
    target = spark.createDataFrame([(2, "b", 20), (3, "c", 30)], "id int, val string, note int")
    m = Matcher(source, target, mapping([("id", "id")], val="val"), order_by=["note"])
    assert m.merged().columns == ["id", "val", "note", "_merge"]  # note is not mapped, so not kept
    plain = Matcher(source, target, mapping([("id", "id")]))
    assert plain.merged().columns == ["id", "val_x", "note_x", "val_y", "note_y", "_merge"]
    got = sorted((r.id, r.val, r.note, r._merge) for r in m.merged().collect())
    assert got == [("1", "a", None, "left_only"), ("2", "b", 20, "both"), ("3", "c", 30, "right_only")]


def test_a_table_matches_itself(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    m = Matcher(df, df, mapping([("k", "k")]))
    assert m.merged().columns == ["k", "v_x", "v_y", "_merge"]
    assert kinds(m.merged()) == {"both": 5} and stats(m.stats()) == (5, 0, 0)
    mapped = Matcher(df, df, mapping([("k", "k")], v="v"), order_by=["v"])
    assert kinds(mapped.merged()) == {"both": 2, "right_only": 1}
    assert {tuple(r) for r in mapped.merged().collect()} == {
        ("1", "a", "both"), ("2", "b", "both"), ("2", None, "right_only")}


def test_dotted_names(spark):
    source = spark.createDataFrame([(1, "a", 1, 2.0), (2, "b", 2, 3.0)], "`a.1` int, `v.x` string, `o.o` int, `q.q` double")
    target = spark.createDataFrame([(2, "b", 3.0)], "`t.1` int, `w.x` string, `r.r` double")
    config = mapping([("a.1", "t.1")], **{"v.x": "w.x"})
    config["mappings"]["q.q"] = {"destinations": ["r.r"], "function": "Aggregation", "transformation": "median"}
    merged, counts = execute_matching(source, target, config, order_by=["o.o"])
    assert merged.columns == ["a.1", "v.x", "q.q", "t.1", "w.x", "r.r", "_merge"]
    assert kinds(merged) == {"both": 1, "left_only": 1} and stats(counts) == (1, 0, 1)
    lines = _lines(evaluate_mapping(source, target, config, ["t.1"], ["o.o"], "keys_and_values"))
    assert lines["aggregation_accuracy", "q.q", "accuracy"] == "100.00%"


def test_types_of_compared_columns(spark):
    source = spark.createDataFrame([(1, 5)], "k int, v int")
    floats = spark.createDataFrame([("1", 5.0)], "t string, w double")
    texts = spark.createDataFrame([("1", "5")], "t string, w string")
    assert kinds(Matcher(source, floats, mapping([("k", "t")], v="w"), ["k"]).merged()) == {"both": 1}
    with pytest.raises(ConfigError, match="cannot compare"):
        Matcher(source, texts, mapping([("k", "t")], v="w"), ["k"])


def test_missing_parts_are_named(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ConfigError, match="key columns"):
        Matcher(df, df, {"key_source": [], "key_target": ["k"]})
    with pytest.raises(ConfigError, match="no column"):
        Matcher(df, df, mapping([("k", "k")], v="absent"), ["k"])
    empty = {"v": {"function": "Conversion mapping", "transformation": "", "destinations": ["v"]},
             "w": {"function": DIRECT, "destinations": []}}
    with pytest.raises(ConfigError, match="yields no column"):
        Matcher(df.withColumn("w", F.lit(1)), df, {**mapping([("k", "k")]), "mappings": empty}, ["k"])


def test_merged_equals_a_full_outer_join(spark):
    source = spark.range(0, 400).select((F.col("id") % 37).alias("k"), (F.col("id") % 5).alias("v"), "id")
    target = spark.range(0, 300).select((F.col("id") % 41).alias("t"), (F.col("id") % 3).alias("w"))
    config = {"key_source": ["k"], "key_target": ["t"],
              "mappings": {"v": {"function": "Aggregation", "transformation": "min", "destinations": ["w"]}}}
    for c in (config, {"key_source": ["k"], "key_target": ["t"]}):
        m = Matcher(source, target, c)
        left, right = m.sides.source.keyed(), m.sides.target.keyed()
        full = left.join(right, m._same(left, right), "full_outer").select(
            left["k"], left["v"], right["t"], right["w"])
        mine = Counter(tuple(r) for r in m.merged().select("k", "v", "t", "w").collect())
        assert mine == Counter(tuple(r) for r in full.collect())
        assert tuple(kinds(m.merged())[x] for x in ("both", "right_only", "left_only")) == stats(m.stats())


@pytest.fixture
def skewed(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    hot = F.when(F.col("id") % 3 == 0, F.lit("7")).otherwise((F.col("id") % 50000).cast("string"))
    source = spark.range(0, 5000, 1, 4).select(F.col("id").cast("string").alias("k"), F.lit(2.0).alias("v"))
    target = spark.range(0, 150000, 1, 8).select(
        hot.alias("t"), (F.col("id") % 5).cast("double").alias("w"),
        F.sha2(F.col("id").cast("string"), 256).alias("pay"))
    yield source, target
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _splits(df) -> int:
    out = df.select(F.sum(F.hash(*df.columns)).alias("h"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return len(re.findall(r"SortMergeJoin\(skew=true\)", plan))


def test_a_hot_key_is_split(skewed):
    from paritas.operators.matching import rows_with_keys
    from paritas.operators.rules import failing_duplicates

    source, target = skewed
    by_key = Matcher(source, target, mapping([("k", "t")]))
    by_value = Matcher(source, target, mapping([("k", "t")], v="w"), order_by=["k"])
    assert _splits(by_key.matched()) == 1
    assert _splits(by_key.right_only()) == 1
    assert _splits(by_key.merged()) == 2
    assert _splits(by_value.merged()) == 1
    assert _splits(failing_duplicates(target, "t")) == 1
    assert _splits(rows_with_keys(target, ["t"], by_key.matched_keys())) == 1


def test_first_per_key_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (2, 1, "c")], "k int, o int, v string")
    assert {tuple(r) for r in first_per_key(df, ["k"], ["v"], ["o"]).collect()} == {(1, None), (2, "c")}


@pytest.fixture
def shops(spark):
    source = spark.createDataFrame(
        [(1, 10.0, "north"), (1, 5.0, "north"), (2, 7.0, "south"), (3, 1.0, "harbour"), (4, 2.0, "west")],
        "shop int, sales double, district string")
    target = spark.createDataFrame(
        [("1", 15.0, "N"), ("2", 7.0, " s "), ("3", 2.0, "harbour"), ("9", 0.0, "N")],
        "shop_id string, turnover double, area string")
    config = {
        "key_source": ["shop"], "key_target": ["shop_id"],
        "mappings": {
            "sales": {"destinations": ["turnover"], "function": "Aggregation", "transformation": "sum"},
            "district": {"destinations": ["area"], "function": "Conversion mapping",
                         "transformation": '{"north": "N", "south": "S", "west": "W"}'},
        },
    }
    return source, target, config


def _lines(df):
    return {(r.section, r.item, r.metric): r.value for r in df.collect()}


def test_evaluation(shops):
    source, target, config = shops
    lines = _lines(evaluate_mapping(source, target, config, ["shop_id"], order_by=["sales"]))
    assert lines["mapped_columns", "sales", "destination"] == "turnover"
    assert lines["key_matches", "keys", "total_source_keys"] == "4"
    assert lines["key_matches", "keys", "total_target_keys"] == "4"
    assert lines["key_matches", "keys", "matched_keys"] == "1"
    assert lines["key_matches", "keys", "match_rate"] == "25.00%"
    assert lines["aggregation_accuracy", "sales", "accuracy"] == "66.67%"
    assert lines["conversion_accuracy", "district", "accuracy"] == "100.00%"
    strict = _lines(evaluate_mapping(source, target, config, ["shop_id"], ["sales"], "keys_and_values"))
    assert strict["conversion_accuracy", "district", "total"] == "1"
    assert strict["conversion_accuracy", "district", "accuracy"] == "100.00%"


def test_evaluation_of_nothing(shops):
    source, target, config = shops
    lines = _lines(evaluate_mapping(source.limit(0), target, config, ["shop_id"], order_by=["sales"]))
    assert lines["key_matches", "keys", "match_rate"] == "0.00%"
    assert lines["aggregation_accuracy", "sales", "accuracy"] == "0%"


def test_difference_by_counts_equals_the_anti_joins(spark, monkeypatch):
    monkeypatch.setattr("paritas.operators.matching.COUNTED_ROWS", 3)
    nan = float("nan")
    rows = [(1, 1.0, 5), (1, 1.0, 5), (2, nan, 6), (2, None, 6), (3, nan, None), (None, 2.0, 1), (4, 0.5, 2)] + 10 * [(9, nan, 9)]
    others = [("1", 1.0, 5), ("2", None, 7), ("2", nan, 7), ("3", None, None), ("7", nan, 1), ("7", None, 1), (None, 2.0, 1)] + 7 * [("8", 8.0, 8)]
    target = spark.createDataFrame(others, "t string, w double, u long")
    keys = [("k", "t"), ("v", "w"), ("z", "u")]
    for source in (spark.createDataFrame(rows, "k int, v double, z int"),
                   spark.createDataFrame(rows[4:], "k int, v float, z int"), spark.createDataFrame([], "k int, v double, z int")):
        plain, grouped = Matcher(source, target, mapping(keys[:1])), Matcher(
            source, target, mapping(keys[:1], v="w", z="u"), order_by=["z", "v"])
        assert not plain._all_is_compared() and grouped._all_is_compared()
        narrow = Matcher(source.select("k"), target.select("t"), mapping(keys[:1]))
        for m in (grouped, narrow):
            expected = m.left_only().unionByName(m.right_only())
            assert m.unmatched().dtypes == expected.dtypes
            assert Counter(map(repr, m.unmatched().collect())) == Counter(map(repr, expected.collect()))
            plan = m.unmatched()._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan


def test_difference_that_counts_cannot_tell(spark):
    # a long beyond 2^53 does not come back from a double: such tables are joined
    source = spark.createDataFrame([(1, 9007199254740993)], "k int, v long")
    target = spark.createDataFrame([("1", 1.0)], "t string, w double")
    m = Matcher(source, target, mapping([("k", "t")], v="w"), order_by=["v"])
    assert not m._all_is_compared()
    assert m.unmatched().where("_merge = 'left_only'").first().v == 9007199254740993


def test_evaluation_reads_each_side_once(spark, shops, tmp_path):
    source, target, config = shops
    source.write.parquet(str(tmp_path / "s"))
    target.write.parquet(str(tmp_path / "t"))
    lines = evaluate_mapping(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "t")), config,
                             ["shop_id"], ["sales"], "keys_and_values")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange ") <= 6 and "Join" not in plan


def test_evaluation_of_incomplete_and_repeated_keys(spark):
    source = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (3, None)], "k int, u string")
    target = spark.createDataFrame([("1", "x"), ("1", "x"), (None, "z"), ("<NA>", "z"), ("4", "w")], "t string, w string")
    row = key_match_stats(source, target, Matcher(source, target, mapping([("k", "t")]))).first()
    # the missing key is no key of the source, but meets both texts of the target
    assert tuple(row)[:3] == (3, 3, 6) and row.match_rate == "200.00%"
    two = Matcher(source, target, mapping([("k", "t"), ("u", "w")]))
    assert tuple(key_match_stats(source, target, two).first())[:3] == (2, 3, 6)


def test_accuracy_compares_with_the_first_target_row(spark):
    source = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (3, 4.0), (5, None)], "k int, v double")
    target = spark.createDataFrame(
        [("1", 9.0, 2), ("1", 5.0, 1), ("2", None, 1), ("2", 1.0, 2), ("3", 4.0, None), ("3", 5.0, 1), ("6", 1.0, 1)],
        "t string, w double, o int")
    config = {"key_source": ["k"], "key_target": ["t"], "mappings": {
        "v": {"destinations": ["w"], "function": "Aggregation", "transformation": "sum"}}}
    matcher = Matcher(source, target, config)
    # keys 1 (5 = 5), 2 (1, missing) and 3 (4 = 4, a missing place comes first); then those with an equal row anywhere
    assert tuple(mapping_accuracy(target, matcher, ["o"]).first())[2:] == (2, 3, "66.67%")
    assert tuple(mapping_accuracy(target, matcher, ["o"], match_on="keys_and_values").first())[2:] == (2, 3, "66.67%")
    assert tuple(key_match_stats(source, target, matcher).first())[:3] == (4, 4, 3)


def test_decimals_are_compared_exactly(spark):
    source = spark.sql("select 1 k, cast('99999999999999.98' as decimal(18,2)) v")
    target = spark.sql("select 1 t, cast('99999999999999.99' as decimal(20,3)) w")
    both = Matcher(source, target, mapping([("k", "t")], v="w"), ["k"])
    assert both.stats().first().total_match == 0
    same = spark.sql("select 1 t, cast('99999999999999.98' as decimal(20,3)) w")
    assert Matcher(source, same, mapping([("k", "t")], v="w"), ["k"]).stats().first().total_match == 1
    whole = spark.sql("select 1 t, 9007199254740993L w")
    near = spark.sql("select 1 k, cast('9007199254740992' as decimal(20,0)) v")
    assert Matcher(near, whole, mapping([("k", "t")], v="w"), ["k"]).stats().first().total_match == 0
    wide = spark.sql("select 1 t, cast(1 as decimal(38,30)) w")
    with pytest.raises(ConfigError, match="scale="):
        Matcher(source, wide, mapping([("k", "t")], v="w"), ["k"])


def test_names_that_differ_in_case(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    target = spark.createDataFrame([(1, "a"), (3, "c")], "ID int, Name string")
    merged = Matcher(source, target, mapping([("id", "ID")], name="Name"), ["id"]).merged()
    assert merged.columns == ["id_x", "name_x", "ID_y", "Name_y", "_merge"]
    assert {r._merge for r in merged.collect()} == {"both", "left_only", "right_only"}
    with pytest.raises(ConfigError, match="_merge"):
        Matcher(source, target.withColumn("_Merge", target.ID), mapping([("id", "ID")]))


def test_a_hot_cell_is_split(spark):
    from pyspark.sql import functions as F

    from paritas.operators.quantiles import exact_quantiles

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000)
        df = spark.range(300_000).select(key.alias("k"), (1000 + F.col("id") / 300_000).alias("v"))
        found = exact_quantiles(df, ["k"], "v", {"q": 0.5})
        assert _splits(found) >= 1
        assert found.where("k = 0").first().q == pytest.approx(
            df.where("k = 0").agg(F.median("v")).first()[0])
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.skewJoin.skewedPartitionThresholdInBytes",
                     "adaptive.advisoryPartitionSizeInBytes", "adaptive.skewJoin.skewedPartitionFactor"):
            spark.conf.unset(f"spark.sql.{name}")


def _generated(df) -> tuple[int, int]:
    """Rows of ``df``, and rows that explodes wrote on the way."""
    out = df.groupBy().count()
    rows = out.collect()[0][0]

    def below(node) -> int:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return below(node.executedPlan())
        if "QueryStage" in name:
            return below(node.plan())
        found = node.metrics().get("numOutputRows").get().value() if name == "Generate" else 0
        return found + sum(below(node.children().apply(i)) for i in range(node.children().size()))

    return rows, below(out._jdf.queryExecution().executedPlan())


def test_rows_of_grids_grow_as_the_rows_not_as_their_product(spark):
    generated = {}
    for n in (400, 1200):
        source = spark.range(2 * n).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
        target = spark.range(2 * n).select((F.col("id") % 2).alias("t"), F.col("id").alias("b"))
        matcher = Matcher(source, target, {"key_source": ["k"], "key_target": ["t"], "mappings": {}})
        rows, generated[n] = _generated(matcher.matched(grid_rows=4))
        assert rows == 2 * n * n
    # 32 cells for the 8 tasks: 16 a key, so 4 lines and 4 columns, and each row of both sides comes four times
    assert generated == {400: 4 * 400 * 4, 1200: 4 * 1200 * 4}


@pytest.mark.parametrize("cell_rows", [100_000, 5])
def test_grids_give_the_rows_of_the_plain_join(spark, monkeypatch, cell_rows):
    monkeypatch.setattr("paritas.operators.matching.CELL_ROWS", cell_rows)
    # hot on both sides, on one, on none; missing keys and values; a key that equals the text of a missing one; equal rows
    source = 30 * [("h", None, 1)] + 20 * [("h", 2.0, 1)] + 9 * [(None, 0.0, 1)] + 9 * [("one", 1.0, 1)] + [("c", 1.0, 1), ("x", 1.0, 1)]
    target = 17 * [("h", None, 2)] + 5 * [("h", 2.0, 3)] + 6 * [("<NA>", -0.0, 4)] + [("one", 1.0, 5), ("c", 1.0, 6), ("y", None, 7)]
    config = {"key_source": ["k"], "key_target": ["t"], "mappings": {
        "v": {"destinations": ["w"], "function": "Conversion mapping", "transformation": None}}}
    matcher = Matcher(spark.createDataFrame(source, "k string, v double, a long"),
                      spark.createDataFrame(target, "t string, w double, b long"), config)
    assert not matcher.sides.source_is_unique and len(matcher.sides.helpers) == 2
    plain = Counter(map(repr, matcher.merged().collect()))
    assert sum(plain.values()) == 30 * 17 + 20 * 5 + 9 * 6 + 9 + 1 + 2
    for broadcast in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        try:
            assert Counter(map(repr, matcher.merged(grid_rows=4).collect())) == plain
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    empty = Matcher(spark.createDataFrame([], "k string, v double, a long"),
                    spark.createDataFrame(target, "t string, w double, b long"), config)
    assert empty.merged(grid_rows=4).count() == len(target)


def test_few_shuffle_partitions_make_no_long_task(spark, monkeypatch):
    source = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    target = spark.range(600).select((F.col("id") % 3).alias("t"), F.col("id").alias("b"))
    matcher = Matcher(source, target, {"key_source": ["k"], "key_target": ["t"], "mappings": {}})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tasks = matcher.matched(grid_rows=4).groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count"))
        rows, longest = tasks.first()
        # 36 cells for 8 cores, and more tasks than cells
        assert rows == 3 * 300 * 200 and longest < rows / 4
        monkeypatch.setattr("paritas.operators.matching.CELL_PAIRS", 600)
        cells = [r["_paritas_line_hot"] * r["_paritas_column_hot"] for r in matcher._grids(4, 2).collect()]
        assert len(cells) == 3 and min(cells) >= 300 * 200 / 600
        assert matcher.matched(grid_rows=4).count() == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
