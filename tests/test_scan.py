import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import composition as comp
from tallyframe.operators import ranks
from tallyframe.operators.names import code_columns
from tallyframe.operators.scan import Scan, group_totals, grouped_median, ordered_scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(1, rng.randint(1, 5), f"n{rng.randint(0, 40):02}") for _ in range(900)]   # the hot group
    out += [(k, rng.randint(1, 5), f"n{i:02}") for k in (2, 3, 4) for i in range(30)]
    out += [(1, 3, "same")] * 300                                                     # identical copies
    return out


def expected(rows):
    out = {}
    for key in {k for k, _, _ in rows}:
        ordered = sorted((-v, n) for k, v, n in rows if k == key)
        running = 0
        for rank, (v, n) in enumerate(ordered, 1):
            running += -v
            out.setdefault(key, []).append((rank, running, -v, n))
    return out


@pytest.mark.parametrize("hot_rows,chunk_rows,partitions", [(10**6, 10**6, 1), (200, 50, 1), (200, 50, 17), (20, 40, 3)])
def test_chunked_scan_equals_window(spark, rows, hot_rows, chunk_rows, partitions):
    df = spark.createDataFrame(rows, "g bigint, v bigint, n string").repartition(partitions)
    scans = [Scan(["-v", "n"], rank="rank", running={"running": "v"}), Scan(["n"], rank="by_name")]
    out = ordered_scan(df, ["g"], scans, hot_rows, chunk_rows)
    assert set(out.columns) == {"g", "v", "n", "rank", "running", "by_name"}
    found = {}
    for r in out.collect():
        found.setdefault(r.g, []).append((r["rank"], r.running, r.v, r.n))
    assert {k: sorted(v) for k, v in found.items()} == expected(rows)
    names = out.groupBy("g").agg(F.countDistinct("by_name").alias("k"), F.max("by_name").alias("m"), F.count("*").alias("c"))
    assert all(r.k == r.m == r.c for r in names.collect())


def test_scan_without_groups(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(9)
    out = ordered_scan(df, [], [Scan(["x"], rank="rank", running={"s": "x"})], hot_rows=100, chunk_rows=90)
    assert all(r["rank"] == r.x + 1 and r.s == r.x * (r.x + 1) // 2 for r in out.collect())


@pytest.mark.parametrize("hot_rows", [10**6, 10])
def test_grouped_median(spark, hot_rows):
    df = spark.createDataFrame([(1, float(i)) for i in range(101)] + [(2, float(i * i)) for i in range(40)] + [(3, None)],
                               "g int, x double").repartition(5)
    found = {r.g: r["median"] for r in grouped_median(df, ["g"], "x", hot_rows=hot_rows).collect()}
    assert found == {1: 50.0, 2: (19 * 19 + 20 * 20) / 2}


def counting(spark, df):
    """``df`` and the number of its rows that were read so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


@pytest.mark.parametrize("hot_rows", [10**6, 300, 50])
def test_one_reading_gives_ranks_sums_and_totals(spark, make_items, hot_rows):
    rng = random.Random(3)
    rows = [(1, f"n{i:04}", rng.randint(1, 9)) for i in range(400)] + [(2, f"n{i}", 1) for i in range(40)]
    rows += [(None, "lost", 5), (3, "unknown", None), (3, "known", 4)]
    items, seen = counting(spark, make_items(rows, 5))
    for run in (lambda: ranks.rank_abundance(items, hot_rows=hot_rows),
                lambda: ranks.cumulative_share(items, hot_rows=hot_rows),
                lambda: ranks.first_crossing(ranks.cumulative_share(items, hot_rows=hot_rows), 0.3),
                lambda: group_totals(items, ["DataSet"], {"t": "CountInt"}, hot_rows)):
        before = seen.value
        found = run().collect()
        assert seen.value - before == len(rows)
        assert {r.DataSet for r in found} == {1, 2, 3}
    totals = {1: sum(r[2] for r in rows[:400]), 2: 40, 3: 4}
    ranked = ranks.rank_abundance(items, hot_rows=hot_rows).collect()
    assert len(ranked) == len(rows) - 1
    for key in (1, 2):
        running = 0
        wanted = sorted((-c, n) for d, n, c in rows if d == key)
        for r, (c, n) in zip(sorted((r for r in ranked if r.DataSet == key), key=lambda r: r["rank"]), wanted, strict=True):
            running -= c
            assert (r.PreyScientificName, r.running_count) == (n, running)
            assert r.cumulative == pytest.approx(running / totals[key]) and r.frequency == pytest.approx(-c / totals[key])
    assert all(r.t == totals[r.DataSet] for r in found)


def test_scans_of_empty_tables_and_unknown_values(spark):
    none = spark.createDataFrame([], "g int, x bigint")
    assert ordered_scan(none, ["g"], [Scan(["x"], "r", {"s": "x"})], totals={"t": "x"}).collect() == []
    assert ordered_scan(none, [], [Scan(["x"], "r", {"s": "x"})]).collect() == []
    df = spark.createDataFrame([(i, None if i < 60 else 1) for i in range(100)], "i int, x bigint").repartition(4)
    found = {r.i: (r.r, r.s) for r in ordered_scan(df, [], [Scan(["i"], "r", {"s": "x"})], chunk_rows=9).collect()}
    assert found == {i: (i + 1, None if i < 60 else i - 59) for i in range(100)}


def test_no_window_is_without_partition_keys(spark):
    df = spark.range(500).select((F.col("id") % 37).alias("x"), F.col("id").cast("string").alias("y"))
    for out in (ordered_scan(df, [], [Scan(["x"], "r", {"s": "x"})]), code_columns(df, {"a": "x", "b": "y"}),
                comp.correlation(df.withColumn("z", F.col("y").cast("int")), "x", "z", "spearman")):
        plan = out._jdf.queryExecution().optimizedPlan()
        nodes = [plan]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Window":
                assert not node.partitionSpec().isEmpty()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    seen_df, seen = counting(spark, df)
    coded = code_columns(seen_df, {"a": "x", "b": "y"}).collect()
    assert seen.value == 500
    names = sorted(str(i) for i in range(500))
    assert all(r.a == r.x + 1 and names[r.b - 1] == r.y for r in coded)
