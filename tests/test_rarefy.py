"""Multinomial samples: their law, their independence of the layout, and their cost."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from conftest import by_key

from tallyframe.operators import rarefy


def spectrum(counts):
    """The ranked spectrum of one group, as its task gets it."""
    sizes, n = np.unique(np.array([c for c in counts if c > 0]), return_counts=True)
    sizes, n = sizes[::-1], n[::-1]
    return pd.DataFrame({"c": sizes, "n_items": n, "items_before": np.cumsum(n) - n,
                         "count_before": np.cumsum(n * sizes) - n * sizes, "total": int((n * sizes).sum())})


def table(block, m, reps, seed=1, key=1):
    out = np.zeros((reps, int(block["n_items"].sum())), np.int64)
    for rep, rank, n in rarefy.sampled_counts(block, key, "c", m, reps, seed):
        assert (n > 0).all()
        np.add.at(out, (rep, rank - 1), n)
    return out


@pytest.mark.parametrize("m", [1, 7, 100, 5000])
@pytest.mark.parametrize("cells", [1 << 21, 16])
def test_samples_are_multinomial(monkeypatch, m, cells):
    """First and second moments of every item, and covariances, against the closed forms."""
    monkeypatch.setattr(rarefy, "CELLS", cells)
    counts = np.array(sorted([40, 9, 9, 9, 5] + [1] * 30, reverse=True))
    reps, f = 4000, counts / counts.sum()
    found = table(spectrum(counts), m, reps)
    assert (found.sum(axis=1) == m).all()
    sd = np.sqrt(m * f * (1 - f))
    assert (np.abs(found.mean(axis=0) - m * f) < 5 * sd / math.sqrt(reps)).all()
    missed = (found == 0).mean(axis=0)
    q = (1 - f) ** m
    assert (np.abs(missed - q) <= 5 * np.sqrt(q * (1 - q) / reps) + 1e-3).all()
    both = ((found[:, -1] == 0) & (found[:, -2] == 0)).mean()
    q2 = (1 - f[-1] - f[-2]) ** m
    assert abs(both - q2) <= 5 * math.sqrt(q2 * (1 - q2) / reps) + 1e-3


def test_richness_agrees_with_its_expectation_and_other_sampler(make_items):
    counts = [50, 30, 30, 10, 5, 5, 5, 1, 1, 1, 0]
    rows = [(1, f"a{i:02}", c) for i, c in enumerate(counts)]
    rows += [(2, "only", 9), (3, "x", 4), (3, "y", None), (4, "zero", 0), (None, "lost", 3)]
    reps = 400
    metrics = by_key(rarefy.sampled_metrics(make_items(rows, 3), m=100, reps=reps, seed=3))
    f = [c / sum(counts) for c in counts]
    q = [(1 - x) ** 100 for x in f]
    bound = 4 * math.sqrt(sum(x * (1 - x) for x in q) / reps)
    assert abs(metrics[1].rare_richness - sum(1 - x for x in q)) < bound
    other = by_key(rarefy.rarefied_metrics(make_items(rows, 2), m=100, reps=reps, seed=3))
    assert metrics[1].rare_entropy == pytest.approx(other[1].rare_entropy, abs=0.03)
    assert tuple(metrics[2])[1:] == (1, 0, 1)
    assert set(metrics) == {1, 2, 3, 4, None}
    assert all(tuple(metrics[k])[1:] == (None, None, None) for k in (3, 4, None))
    assert metrics == by_key(rarefy.sampled_metrics(make_items(rows, 7), m=100, reps=reps, seed=3))
    empty = rarefy.sampled_metrics(make_items(rows).filter("false"), m=100, reps=5)
    assert empty.collect() == []


def test_frequencies_are_those_of_the_metrics(make_items):
    rows = [(d, f"s{i:02}", 1 + i // d) for d in (1, 2) for i in range(25)]
    items = make_items(rows, 4)
    found = rarefy.sampled_frequencies(items, m=1000, reps=6).collect()
    metrics = by_key(rarefy.sampled_metrics(items, m=1000, reps=6))
    for d in (1, 2):
        own = [r for r in found if r.DataSet == d]
        assert len({(r.rep, r["rank"]) for r in own}) == len(own)
        assert {rep: sum(r.n for r in own if r.rep == rep) for rep in range(1, 7)} == dict.fromkeys(range(1, 7), 1000)
        assert len(own) / 6 == pytest.approx(metrics[d].rare_richness)
        assert max(r.n for r in own) / 1000 == pytest.approx(metrics[d].rare_top_frequency)


def test_cost_does_not_follow_the_sample():
    block = spectrum([1 + i % 40 for i in range(400)])

    def seconds(m):
        start = time.process_time()
        table(block, m, 200)
        return time.process_time() - start

    seconds(10)
    assert min(seconds(10**7) for _ in range(3)) < 5 * min(seconds(10**3) for _ in range(3)) + 0.05
    # A billion items met once each: few draws, so few cells.
    wide = pd.DataFrame({"c": [1], "n_items": [10**9], "items_before": [0], "count_before": [0], "total": [10**9]})
    drawn = list(rarefy.sampled_counts(wide, 1, "c", 1000, 3, 1))
    assert sum(int(n.sum()) for _, _, n in drawn) == 3000 and max(int(r.max()) for _, r, _ in drawn) > 9 * 10**8


def test_draws_are_not_rows_of_the_join(make_items):
    """The individuals are rows only behind the join with the names: before it, a rank holds the list of its draws."""
    rows = [(d, f"s{i:02}", 1 + i // 3) for d in (1, 2, None) for i in range(20)]
    drawn = rarefy.rarefy(make_items(rows, 3), m=30, reps=4, seed=5)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate explode") < plan.index("Join Inner")
    assert drawn.columns == ["DataSet", "rank", "rep", "draw", "PreyScientificName"]
    found = {(r.DataSet, r.rep, r.draw): (r["rank"], r.PreyScientificName) for r in drawn.collect()}
    counts = [1 + i // 3 for i in range(20)]
    order = sorted(range(20), key=lambda i: (-counts[i], i))
    block = spectrum(counts)
    expected = {}
    for d in (1, 2):
        for rep, ranks in enumerate(rarefy.draw_ranks(block, d, "c", 30, 4, 5), 1):
            expected |= {(d, rep, k): (int(r), f"s{order[r - 1]:02}") for k, r in enumerate(ranks, 1)}
    assert found == expected


def test_both_ways_to_the_ranks_agree():
    """Groups of few individuals look ranks up, larger ones search the blocks; counted and sorted tallies are the same."""
    counts = [40, 9, 9, 9, 5] + [1] * 30
    few, many = spectrum(counts), spectrum([c * 10**6 for c in counts])
    for key in (3, "x"):
        a, b = (rarefy.draw_ranks(block, key, "c", 50, 20, 2) for block in (few, many))
        assert (a == b).all()
    u = rarefy.uniform(3, 2, 1000) * sum(counts)
    upto = np.cumsum(sorted(counts, reverse=True))
    assert (rarefy.draw_ranks(few, 3, "c", 50, 20, 2).ravel() == np.searchsorted(upto, u, side="right") + 1).all()
    for ranks in (a, a * 1000):
        rep, rank, n = rarefy._tally(ranks)
        cells = {}
        for i, row in enumerate(ranks):
            for r in row:
                cells[i, int(r)] = cells.get((i, int(r)), 0) + 1
        assert list(zip(rep, rank, n)) == [(*k, cells[k]) for k in sorted(cells)]
