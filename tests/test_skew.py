import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import composition as comp
from tallyframe.operators import skew
from tallyframe.operators.redistribute import redistribute_genus
from tallyframe.operators.skew import skew_join
from tallyframe.plans.queries import tidy


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_skew_join_equals_join(spark, how, hot_rows):
    left = spark.createDataFrame(
        [(1, "x", i) for i in range(400)] + [(2, "y", i) for i in range(20)] + [(None, "x", 1), (9, "z", 2)],
        "k int, s string, v int").repartition(7)
    right = spark.createDataFrame([(1, "x", 10), (1, "x", 11), (2, "y", 20), (3, "q", 30)], "k int, s string, w int")
    for keys in (["k"], ["k", "s"]):
        other = right if len(keys) == 2 else right.drop("s")
        found = skew_join(left, other, keys, how, hot_rows).select("k", "v", "w").collect()
        plain = left.join(other, keys, how).select("k", "v", "w").collect()
        assert sorted(found, key=str) == sorted(plain, key=str)


def test_hot_keys_are_spread(spark):
    left = spark.range(0, 1000, 1, 8).select(F.lit(1).alias("k"))
    joined = skew_join(left, spark.createDataFrame([(1, 2)], "k int, w int"), ["k"], hot_rows=200)
    rows = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 1000 and "_salt" in joined._jdf.queryExecution().toString()


def test_operators_do_not_depend_on_the_salts(make_items, monkeypatch):
    rng = random.Random(2)
    rows = [(1, f"{g} s{i:03}", rng.randint(1, 9), float(i % 9 + 1)) for g in ("Mus", "Rattus") for i in range(60)]
    rows += [(1, "Mus sp", 40, None, "Genus"), (2, "Mus a", 3, 1.0), (2, "Rattus sp", 4, None, "Genus")]
    items = make_items(rows, 6)

    def run():
        return [sorted(tidy(df).collect(), key=str) for df in (
            comp.frequencies(items), comp.size_selectivity(items), redistribute_genus(items))]

    plain = run()
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    assert run() == plain


def _largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def test_rows_without_a_key_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).alias("k"), "id")
        joined = skew_join(left, spark.createDataFrame([(k, k) for k in range(5)], "k bigint, w bigint"), ["k"], "left", hot_rows=200)
        assert joined.count() == 4000 and _largest_task(joined) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_small_side_is_broadcast_whichever_it_is(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 100)
    small, large = spark.createDataFrame([(1, 2)], "k int, v int"), spark.range(500).select(F.lit(1).alias("k"), "id")
    joined = skew.sized_join(small, large, ["k"])
    assert joined.count() == 500 and "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    assert not skew.is_small(small)


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_a_hot_group_without_a_name_is_scanned(spark, hot_rows):
    from tallyframe.operators.scan import Scan, ordered_scan

    rows = spark.createDataFrame([(None, i % 17) for i in range(60)] + [("a", i) for i in range(5)], "g string, v int").repartition(4)
    found = ordered_scan(rows, ["g"], [Scan(["v"], rank="r", running={"s": "v"})], hot_rows, 25).collect()
    assert len(found) == 65 and sorted(r.r for r in found if r.g is None) == list(range(1, 61))
    assert max(r.s for r in found if r.g is None) == sum(i % 17 for i in range(60))


def test_stages_are_deleted_when_asked(spark):
    from tallyframe.session import clear_stages, cut_lineage

    clear_stages(spark)
    cut_lineage(spark.range(3))
    assert clear_stages(spark) == 1 and clear_stages(spark) == 0


def test_a_stage_is_measured_while_it_is_written(spark):
    from tallyframe.session import cut_lineage, measured_stage, stage_size

    df = spark.createDataFrame([(1, "abc", [1, 2]), (2, None, None), (3, "é", [])], "k int, t string, a array<int>")
    stage = measured_stage(df.repartition(3))
    rows, size = stage_size(stage)
    assert (rows, size) == stage.__dict__["_size"] == stage_size(df) and rows == 3 and size >= 3 * 24 + 3 + 2
    assert measured_stage(stage) is stage
    plain = cut_lineage(df)
    assert measured_stage(plain) is plain and stage_size(plain) == (rows, size)
    assert "_size" not in stage.filter("k = 1").__dict__ and "_is_stage" not in stage.select("k").__dict__
    for empty in (df.filter("false"), spark.createDataFrame([], df.schema), df.filter("k > 9")):
        assert stage_size(measured_stage(empty)) == (0, 0)
