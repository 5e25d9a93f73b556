import collections
import re

import numpy as np
import pytest

from tallyframe.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target}: excess over the cap is shared again by weight until none is left."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    wanted, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = wanted - sum(cap * sizes[s] for s in full)
        total = sum(weight[s] for s in free)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / total for s in order}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        full.update(over)


def rows_of(prose):
    rows = [(k, prose(20 + k % 90, k), "en", ["a", "b", "é", "z", None, "Z"][min(5, k % 11)]) for k in range(400)]
    return rows + [(500, None, "en", "a"), (501, "", "en", "empty"), (None, "some words here", "en", "b"), (7, prose(27, 7), "en", "a"),
                   (7, prose(27, 7), "en", "a"), (502, "w " * 5000, "en", "z")]


@pytest.mark.parametrize("block_rows", [20_000, 7], ids=["one block", "reduction tree"])
def test_targets_and_totals(make_docs, prose, block_rows):
    rows = rows_of(prose)
    found = mixing.mix_sources(make_docs(rows), block_rows=block_rows).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = collections.Counter()
    for r, n in zip(rows, size):
        sizes[r[3]] += n
    target = brute_targets(sizes)
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in found) == sorted((str(r[0]), n, str(r[3])) for r, n in zip(rows, size))
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, total in taken.items():
        assert abs(total - target[source]) <= largest[source] / 2 + 1e-6


def test_reruns_and_partitions_agree(make_docs, prose):
    rows = rows_of(prose)
    one, two = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix_sources(make_docs(rows, n)).collect()) for n in (1, 5))
    assert one == two


def test_empty_table(make_docs):
    assert mixing.mix_sources(make_docs([(1, "a")]).limit(0)).collect() == []
    assert [r.taken for r in mixing.mix_sources(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_pivot_keeps_the_sum_and_is_fair():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 50, 30)
    p = rng.random(30)
    draws = []
    for _ in range(3000):
        out = mixing.pivot(p, size, rng)
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        assert out @ size == pytest.approx(p @ size, abs=1e-5)
        draws.append(out)
    assert np.abs(np.mean(draws, axis=0) - p).max() < 0.05
