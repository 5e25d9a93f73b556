import math
import random

import pytest
from conftest import by_key
from pyspark.sql import functions as F

from tallyframe.operators import composition as comp
from tallyframe.operators import curves, ranks, rarefy

ROWS = [
    *[(1, f"a{i}", c) for i, c in enumerate([40, 30, 20, 10])],
    (2, "b0", 5), (2, "b1", 5),
    (3, "c0", 7),
    (4, "d0", 0), (4, "d1", 6), (4, "d2", 2),
]


@pytest.fixture(scope="module", params=[1, 17])
def items(make_items, request):
    return make_items(ROWS, request.param)


def test_plain_metrics(items):
    assert {k: r.richness for k, r in by_key(comp.richness(items)).items()} == {1: 4, 2: 2, 3: 1, 4: 3}
    entropy = by_key(comp.shannon_entropy(items))
    assert entropy[1].entropy == pytest.approx(1.2798542258336676)
    assert entropy[2].entropy == pytest.approx(0.6931471805599453)
    assert entropy[3].entropy == pytest.approx(0)
    assert entropy[4].entropy == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))
    top = by_key(comp.top_frequency(items))
    assert [top[k].top_frequency for k in (1, 2, 3)] == [0.4, 0.5, 1.0]


def test_metrics_over_the_spectrum(items):
    half = by_key(comp.sp50(items))
    assert half[1].sp50 == pytest.approx(4 / 3)
    assert half[2].sp50 == half[3].sp50 == half[4].sp50 == 1
    rank, one = by_key(comp.gini(items)), by_key(comp.gini(items, population="one"))
    assert rank[1].gini == pytest.approx(0.27) and one[1].gini == pytest.approx(0.25)
    assert rank[2].gini == pytest.approx(0) and one[3].gini == pytest.approx(0)


def test_lognormal_needs_three_items(items):
    fits = by_key(comp.lognormal_params(items))
    assert fits[1].ln_mean == pytest.approx(-1.5080716354)
    assert fits[1].ln_sd == pytest.approx(0.6011676120)
    assert fits[2].ln_mean is None and fits[3].ln_sd is None


def test_sp50_and_gini_against_the_definition(make_items):
    counts = [9, 9, 9, 5, 5, 4, 4, 4, 4, 1, 1, 1]
    items = make_items([(1, f"x{i:02}", c) for i, c in enumerate(counts)], 3)
    cumulative, total, rank = 0, sum(counts), None
    for k, c in enumerate(counts, 1):
        if (cumulative + c) / total > 0.5:
            rank = (k - 1) + (total / 2 - cumulative) / c
            break
        cumulative += c
    assert by_key(comp.sp50(items))[1].sp50 == pytest.approx(rank)
    for population, weights in (("rank", range(1, 13)), ("one", [1] * 12)):
        pairs = sorted(zip(counts, weights), key=lambda p: (p[0], -p[1]))
        area, height, z = 0, 0, sum(c * w for c, w in pairs)
        for c, w in pairs:
            area += (2 * height + c * w) * w
            height += c * w
        expected = 1 - area / (z * sum(w for _, w in pairs))
        assert by_key(comp.gini(items, population=population))[1].gini == pytest.approx(expected)


def test_size_selectivity(make_items):
    masses = [20.0, 10.0, 40.0, 80.0, 5.0, 100.0]
    rows = [(1, f"p{i}", c, m) for i, (c, m) in enumerate(zip([40, 30, 20, 10, 6, 4], masses))]
    rows += [(1, "unweighed", 50)] + [(2, f"q{i}", 3, 1.0 + i) for i in range(5)]
    found = by_key(comp.size_selectivity(make_items(rows)))
    assert found[1].summed_deviance == pytest.approx(0.897198399)
    assert found[1].max_overselected_size == 5.0
    assert found[2].summed_deviance is None


def test_top_items_and_extremes(make_items):
    items = make_items([
        (1, "b", 5, 10.0, "Genus"), (1, "a", 5, None), (1, "c", 5, 30.0), (1, "d", 1, 99.0), (1, "e", 2, 99.0)])
    top = by_key(comp.top_items(items))[1]
    assert top.top_item_mass == 20.0 and top.top_item_id_level == "Species"
    ends = by_key(comp.extreme_item_frequency(items))[1]
    assert ends.obs_largest_prey_freq == pytest.approx(1 / 18)
    assert ends.obs_smallest_prey_freq == pytest.approx(5 / 18)
    dense = items.withColumn("Density", F.lit(2.0))
    predicted = by_key(comp.predicted_largest_frequency(dense))[1]
    assert predicted.pred_largest_prey_freq == pytest.approx(1 / (1 + 4 / 2))


def test_top_item_flags(make_items):
    items = make_items([(1, "a", 5, 9.0), (1, "b", 3, 1.0), (2, "a", 5, 9.0), (2, "b", 5, 1.0), (3, "a", 1, 2.0)])
    flags = by_key(comp.top_item_flags(items.withColumn("Density", 1 / F.col("PreyMass"))))
    assert (flags[1].IsTopPreyBiggest, flags[1].IsTopPreyMostDense) == (1, 0)
    assert (flags[2].IsTopPreyBiggest, flags[2].IsTopPreyMostDense) == (0, 0)
    assert (flags[3].IsTopPreyBiggest, flags[3].IsTopPreyMostDense) == (1, 1)


def test_shares(make_items, spark):
    items = make_items([(1, "Aves", 2, None, "Class", "Aves"), (1, "x", 6), (2, "y", 4)])
    share = by_key(comp.share_of_total(items, "PreyClass"), "PreyClass")
    assert share["Aves"].share == pytest.approx(2 / 12)
    meta = spark.createDataFrame([(1,), (2,), (9,)], "DataSet bigint")
    birds = by_key(comp.bird_fraction(items, meta))
    assert [birds[k].FreqBirds for k in (1, 2, 9)] == [0.25, 0.0, 0.0]
    assert by_key(comp.unidentified_fraction(items))[1].funidBird == 0.25


def test_correlation_histogram_and_positive_share(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 9.0), (4.0, 5.0), (None, 1.0)], "a double, b double")
    assert comp.correlation(df, "a", "b", "spearman").first()[0] == pytest.approx(0.7378647873726218)
    bins = {r.bin: r.n for r in comp.histogram(df, "a", 3).collect()}
    assert bins == {0: 1, 1: 1, 2: 2}
    assert comp.count_positive_share(df.withColumn("s", F.col("a") - 2.5), "s").first()[0] == 0.5


def test_rank_abundance_orders_ties_by_name(items):
    rows = ranks.rank_abundance(items).orderBy("DataSet", "rank").collect()
    assert [r.PreyScientificName for r in rows if r.DataSet == 2] == ["b0", "b1"]
    first = [r for r in rows if r.DataSet == 1]
    assert [r["rank"] for r in first] == [1, 2, 3, 4]
    assert [r.cumulative for r in first] == pytest.approx([0.4, 0.7, 0.9, 1.0])
    crossing = by_key(ranks.first_crossing(ranks.cumulative_share(items), 0.4))
    assert crossing[1].crossing_item == "a1" and crossing[3].crossing_item == "c0"


def test_exponential_fit_recovers_and_matches_dense_solution(make_items):
    decline = [round(1e9 * math.exp(-0.3 * r)) for r in range(1, 11)]
    rows = [(1, f"a{i:02}", c) for i, c in enumerate(decline)]
    rows += [(2, f"b{i}", c) for i, c in enumerate([40, 30, 20, 10])]
    rows += [(3, f"c{i}", c) for i, c in enumerate([7, 7, 7, 2, 2, 1, 1, 1, 1, 1])]
    rows += [(4, "d0", 1), (4, "d1", 2)]
    fits = by_key(curves.exp_fit(make_items(rows, 5)))
    assert fits[1].specialization == pytest.approx(-0.3, abs=1e-6) and fits[1].rsquare == pytest.approx(1)
    assert fits[4].specialization is None
    for diet in (2, 3):
        counts = sorted((c for k, _, c in rows if k == diet), reverse=True)
        f = [c / sum(counts) for c in counts]

        def rss(a, b):
            return sum((y - a * math.exp(b * r)) ** 2 for r, y in enumerate(f, 1))

        a, b = fits[diet].y_intercept, fits[diet].specialization
        best = rss(a, b)
        assert all(best <= rss(a + da, b + db) for da in (-1e-4, 0, 1e-4) for db in (-1e-4, 0, 1e-4))
    curve = curves.exp_curve(curves.exp_fit(make_items(rows))).filter("DataSet = 2")
    assert curve.count() == 291


def test_rarefaction_follows_the_expected_richness(make_items):
    rows = [(1, f"a{i:02}", c) for i, c in enumerate([50, 30, 30, 10, 5, 5, 5, 1, 1, 1, 0])]
    rows += [(2, "only", 9), (3, "x", 4), (3, "y", None)]
    items = make_items(rows, 3)
    metrics = by_key(rarefy.rarefied_metrics(items, m=100, reps=400, seed=3))
    expected = by_key(rarefy.expected_rarefied_richness(items))
    assert metrics[1].rare_richness == pytest.approx(expected[1].expected_richness, abs=0.3)
    assert (metrics[2].rare_richness, metrics[2].rare_entropy, metrics[2].rare_top_frequency) == (1, 0, 1)
    assert metrics[3].rare_richness is None
    filled = by_key(rarefy.rarefied_metrics(items, fill=0.0))
    assert filled[3].rare_richness == 0
    drawn = rarefy.rarefy(items, m=50, reps=3).collect()
    assert len(drawn) == 2 * 150 and not any(r.PreyScientificName == "a10" for r in drawn)


def test_expected_richness_of_the_hand_case(items):
    found = by_key(rarefy.expected_rarefied_richness(items))
    assert found[1].expected_richness == pytest.approx(3.9999734384)


def test_draws_are_the_first_item_over_the_threshold(make_items):
    counts = sorted([13, 7, 7, 7, 2, 2, 1], reverse=True)
    items = make_items([(5, f"s{i}", c) for i, c in enumerate(counts)])
    drawn = {(r.rep, r.draw): r["rank"] for r in rarefy.rarefy(items, m=40, reps=5, seed=2).collect()}
    u = rarefy.uniform(5, 2, 200)
    for i, value in enumerate(u):
        cumulative, rank = 0, 0
        while not value * sum(counts) < cumulative:
            cumulative += counts[rank]
            rank += 1
        assert drawn[(i // 40 + 1, i % 40 + 1)] == rank


def _fit(counts):
    import numpy as np

    values, sizes = np.unique(-np.array(counts, float), return_counts=True)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(float)
    blocks = curves._Blocks(first, sizes.astype(np.int64), -values / sum(counts), np.array([0]))
    return [x[0] for x in curves.fit_exponentials(blocks)]


def test_no_diet_is_lost_to_the_exponential_fit():
    import numpy as np

    rng = random.Random(1)
    cases = [[1000, 1, 1, 1], [100000, 1, 1, 1, 1, 1], [50000] + [1] * 5000, [5] * 7, [3, 2, 1], [9, 9, 9, 1]]
    cases += [[int(rng.paretovariate(0.5)) + 1 for _ in range(rng.randint(3, 80))] for _ in range(300)]
    for counts in cases:
        a, b, rss, converged = _fit(counts)
        f = np.array(sorted(counts, reverse=True)) / sum(counts)
        rank = np.arange(1, len(f) + 1)
        best = np.inf
        for trial in [*-np.geomspace(1e-7, 25, 2500), 0.0]:
            e = np.exp(trial * (rank - 1))
            best = min(best, ((f - (f @ e) / (e @ e) * e) ** 2).sum())
        found = ((f - a * np.exp(b * rank)) ** 2).sum()
        assert converged and found <= best * (1 + 1e-9) + 1e-18 and rss == pytest.approx(found, abs=1e-12)
    assert not _fit([9, 0, 0])[3]


def test_small_densities_keep_their_ranks(make_items):
    from tallyframe.operators import ranks

    rows = [(1, f"a{i}", c, float(i + 1)) for i, c in enumerate([5, 9, 2])]
    items = make_items(rows).withColumn("Density", F.exp(-F.col("PreyMass") - 22))
    found = {r.PreyScientificName: r.DensRank for r in ranks.rank_triplet(items).collect()}
    assert found == {"a0": 3, "a1": 2, "a2": 1}


def test_histogram_has_its_empty_bins(spark):
    rows = comp.histogram(spark.createDataFrame([(0.0,), (1.0,), (8.0,), (None,)], "x double"), "x", 8).orderBy("bin").collect()
    assert [(r.bin, r.left, r.n) for r in rows] == [(0, 0.0, 1), (1, 1.0, 1)] + [(k, float(k), 0) for k in range(2, 7)] + [(7, 7.0, 1)]
    assert comp.histogram(spark.createDataFrame([(None,)], "x double"), "x").collect() == []


def test_remapping_by_a_table_renames_each_row_once(spark):
    from tallyframe.operators import names

    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "d")], "old string, new string")
    found = names.remap_names(spark.createDataFrame([("a",), ("x",), (None,), ("c",)], "sp string"), "sp", pairs)
    assert sorted(str(r.sp) for r in found.collect()) == ["None", "b", "d", "x"]
