import math
import random
import statistics

import pytest
from conftest import by_key
from pyspark.sql import functions as F

from tallyframe.operators import composition as comp
from tallyframe.operators import density, foraging, ranks
from tallyframe.operators.redistribute import redistribute_genus, union_adjusted
from tallyframe.plans import tables

MASSES = [20.0, 10.0, 40.0, 80.0, 5.0, 100.0]


@pytest.fixture(scope="module")
def diet(make_items, spark):
    items = make_items([(1, f"p{i}", c, m) for i, (c, m) in enumerate(zip([40, 30, 20, 10, 6, 4], MASSES))])
    meta = spark.createDataFrame([(1, 2.0)], "DataSet bigint, PreyPerPellet double")
    return items, meta


def test_rule_per_handling_time(diet):
    items, meta = diet
    totals = foraging.diet_totals(items, meta)
    assert by_key(foraging.intake_rate(totals))[1].NE_intake == pytest.approx(56.909090909)
    hs = [0.01, 0.02, 0.04, 0.08, 0.16, 0.5, 0.9]
    share = by_key(foraging.proportion_meeting_rule(items, totals, hs), "cand_h")
    assert [round(share[h].prop_meeting_rule * 6) for h in hs] == [6, 6, 6, 6, 5, 3, 3]
    tests = foraging.foraging_test(items, totals, hs)
    assert tests.count() == 6 * len(hs)
    below = {r.cand_h: r.NumPos for r in foraging.suboptimal_count(tests).collect()}
    assert all(below[h] + round(share[h].prop_meeting_rule * 6) <= 6 for h in hs)


def test_only_diets_with_more_than_twenty_prey_are_tested(make_items, spark):
    items = make_items([(1, "a", 10, 5.0), (1, "b", 10, 6.0), (2, "a", 10, 5.0), (2, "b", 11, 6.0), (3, "a", 99, 5.0),
                        (4, "a", 50, 1.0), (4, "b", 50, 2.0)])
    meta = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0), (4, None)], "DataSet bigint, PreyPerPellet double")
    tests = foraging.foraging_test(items, foraging.diet_totals(items, meta), [0.02])
    assert {r.DataSet for r in tests.collect()} == {2}


def test_attack_rate(spark):
    df = spark.createDataFrame([(50.0, 3.0), (50.0, None)], "s double, p double")
    known, unknown = [r[0] for r in df.select(foraging.attack_rate("s", "p", 0.02)).collect()]
    assert known == pytest.approx(0.0204081633) and unknown is None


def test_genus_counts_are_shared_half_to_even(make_items):
    items = make_items([
        (1, "Mus musculus", 30), (1, "Mus spretus", 10), (1, "Mus sp", 10, None, "Genus"),
        (2, "Rattus sp", 4, None, "Genus"), (2, "Mus musculus", 1),
        (3, "Apus (Mus) x", 3), (3, "Mus sp", 2, None, "Genus"), (3, "mus y", 5),
        (4, "Mus a", 0), (4, "Mus sp", 6, None, "Genus")])
    found = {(r.DataSet, r.PreyScientificName): r.CountInt for r in redistribute_genus(items).collect()}
    assert found == {
        (1, "Mus musculus"): 38, (1, "Mus spretus"): 12, (2, "Rattus sp"): 4, (2, "Mus musculus"): 1,
        (3, "Apus (Mus) x"): 5, (3, "mus y"): 5, (4, "Mus a"): 0, (4, "Mus sp"): 6}


def test_genus_sharing_against_brute_force(make_items):
    rng = random.Random(3)
    rows = []
    for diet in range(6):
        for genus in ("Mus", "Rattus", "Musimon", "Arv"):
            for epithet in rng.sample(["alba", "minor", "Mus", "nigra", "x"], 3):
                rows.append((diet, f"{genus} {epithet}", rng.randint(0, 30)))
            if rng.random() < 0.7:
                rows.append((diet, f"{genus} sp", rng.randint(1, 40), None, "Genus"))
    expected = {}
    for diet in range(6):
        mine = [r for r in rows if r[0] == diet]
        total = {r[1]: r[2] for r in mine}
        gone = set()
        for r in mine:
            if len(r) < 5:
                continue
            word = r[1].split(" ")[0]
            takers = [t for t in mine if word in t[1] and t[1] != r[1]]
            weight = sum(t[2] for t in takers)
            if weight:
                gone.add(r[1])
                for t in takers:
                    total[t[1]] += round(r[2] * t[2] / weight)
        expected |= {(diet, k): v for k, v in total.items() if k not in gone}
    found = {(r.DataSet, r.PreyScientificName): r.CountInt for r in redistribute_genus(make_items(rows, 7)).collect()}
    assert found == expected


def test_union_adjusted(make_items):
    items = make_items([(1, "a", 1), (1, "b", 2)])
    out = union_adjusted(items, items.filter("PreyScientificName = 'a'").withColumn("CountInt", F.lit(9).cast("bigint")),
                         ["DataSet", "PreyScientificName"])
    assert {(r.PreyScientificName, r.CountInt) for r in out.collect()} == {("a", 9), ("b", 2)}


def test_rank_regression(spark):
    ranked = spark.createDataFrame([(1, d, c) for d, c in zip([1, 2, 3, 4], [2, 1, 3, 4])] + [(2, 1, 1), (3, 1, 1), (3, 2, 2)],
                                   "DataSet bigint, DensRank bigint, CountRank bigint")
    fit = by_key(density.rank_regression(ranked))
    assert fit[1].dens_slopes == pytest.approx(0.8) and fit[1].pval_dens == pytest.approx(0.2)
    assert fit[2].dens_slopes is None and fit[3].pval_dens is None
    line = density.rank_line(ranked, density.rank_regression(ranked)).filter("DataSet = 1").orderBy("DensRank").collect()
    assert [r.fitted for r in line] == pytest.approx([1.3, 2.1, 2.9, 3.7])


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_rank_triplet_ties(make_items, hot_rows):
    items = make_items([(1, "a", 5, 9.0), (1, "b", 5, 9.0), (1, "c", 1, 9.0), (1, "d", 7, 1.0), (2, "z", 1, 1.0)], 4)
    items = items.withColumn("Density", F.when(F.col("PreyScientificName") == "a", 2.0).otherwise(1.0))
    found = {(r.DataSet, r.PreyScientificName): (r.DensRank, r.CountRank, r.MassRank)
             for r in ranks.rank_triplet(items, hot_rows=hot_rows).collect()}
    assert found == {(1, "a"): (4, 3, 4), (1, "b"): (1, 2, 3), (1, "c"): (2, 1, 2), (1, "d"): (3, 4, 1), (2, "z"): (1, 1, 1)}


def test_density_prediction_and_posterior(spark, make_items):
    obs = spark.createDataFrame([("O1", 1.0, 100.0), ("O1", 10.0, 10.0), ("O2", 1.0, 5.0)],
                                "Order string, BodyMass double, Density_km double")
    lines = density.allometry_by_order(density.log_observations(obs))
    items = make_items([(1, "a", 1, 100.0), (1, "b", 1, 5.0, "Species", "Mammalia", "O2")])
    for base, value in (("10", 1.0), ("e", 1.0)):
        row = density.predict_density(items, lines, base=base).collect()
        assert [r.PreyScientificName for r in row] == ["a"] and row[0].Density == pytest.approx(value)
    draws = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.5, 0.0), (3, 1.0, -1.0)], "draw int, Intercept1 double, orders1 double")
    long = density.long_draws(draws, [1])
    medians = density.median_by_level(long).first()
    assert (medians.slope, medians.intercept) == (0.0, 0.5)
    coded = spark.createDataFrame([("a", 1, 2.0)], "name string, group_idx bigint, LogMass double")
    found = {r.draw: r.density for r in density.posterior_density(coded, long, ["name"]).collect()}
    assert found[1] == pytest.approx(2.718281828 ** 2)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_posterior_summary_equals_the_draws(spark, chunk):
    rng = random.Random(3)
    lines = [(d, k, 20 + rng.gauss(0, 0.1), rng.gauss(-0.7, 0.05)) for d in range(40) for k in (1, 2)] + [(99, 1, None, 1.0), (1, 5, 2.0, 1.0)]
    draws = spark.createDataFrame(lines, "draw int, k bigint, intercept double, slope double").repartition(3)
    items = spark.createDataFrame([("a", 1, 1.5), ("b", 1, 1.5), ("c", 2, 0.2), ("d", 2, None), ("e", 4, 1.0), ("f", 5, 1.0)], "name string, group_idx int, LogMass double")
    found = by_key(density.posterior_summary(items, draws, ["name"], chunk_draws=chunk), "name")
    for name, k, x in (("a", 1, 1.5), ("b", 1, 1.5), ("c", 2, 0.2)):
        logs = [i + s * x for _, level, i, s in lines if level == k and i is not None]
        values, row = [math.exp(v) for v in logs], found[name]
        assert row.draws == 40 and (row.least, row.most) == pytest.approx((min(values), max(values)))
        assert (row["mean"], row.sd) == pytest.approx((statistics.mean(values), statistics.stdev(values)))
        assert (row.log_mean, row.log_sd) == pytest.approx((statistics.mean(logs), statistics.stdev(logs)))
    assert [found[n].draws for n in "def"] == [0, 0, 1] and found["d"]["mean"] is None and found["f"].sd is None


def test_fused_table_equals_the_single_operators(spark, make_items):
    rng = random.Random(1)
    rows = [(d, f"s{i:02}", rng.randint(1, 12), float(rng.randint(2, 9))) for d in range(1, 6) for i in range(3 * d)]
    prey = make_items(rows, 3).withColumn("Density", F.round(1 / F.col("PreyMass"), 9)).cache()
    meta = spark.createDataFrame([(d, 50, float(d) if d != 3 else None) for d in range(1, 6)],
                                 "DataSet bigint, Num_obs bigint, PreyPerPellet double")
    table = by_key(tables.diet_foraging_metrics(prey, meta, 0.5))
    totals = foraging.diet_totals(prey, meta)
    slopes = by_key(density.rank_regression(ranks.rank_triplet(prey)))
    flags, ends = by_key(comp.top_item_flags(prey)), by_key(comp.extreme_item_frequency(prey))
    predicted, common = by_key(comp.predicted_largest_frequency(prey)), by_key(comp.mass_of_most_common(prey))
    below = by_key(foraging.suboptimal_count(foraging.foraging_test(prey, totals, [0.5])))
    intake = by_key(foraging.intake_rate(totals))
    assert set(table) == {d for d in range(1, 6) if sum(r[2] for r in rows if r[0] == d) > 20}
    for d, row in table.items():
        assert row.dens_slopes == pytest.approx(slopes[d].dens_slopes)
        assert row.pval_dens == pytest.approx(slopes[d].pval_dens)
        assert (row.IsTopPreyBiggest, row.IsTopPreyMostDense) == (flags[d].IsTopPreyBiggest, flags[d].IsTopPreyMostDense)
        assert row.obs_largest_prey_freq == pytest.approx(ends[d].obs_largest_prey_freq)
        assert row.obs_smallest_prey_freq == pytest.approx(ends[d].obs_smallest_prey_freq)
        assert row.pred_largest_prey_freq == pytest.approx(predicted[d].pred_largest_prey_freq)
        assert row.mass_of_most_common_dropones == common[d].mass_of_most_common
        assert row.NumPos == (below[d].NumPos if d in below else None)
        assert row.NE_intake == (None if d == 3 else pytest.approx(intake[d].NE_intake))
