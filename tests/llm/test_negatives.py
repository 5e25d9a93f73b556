import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, score string, blk int, id int, tree int, pos int, dim int"


def make(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 1, "s", 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(partitions)


def brute(rows, is_anchor, positives=5, most=10, low=30, high=90, scale=256):
    good = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, c) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j if j is not None else 0, n) for n, (j, w, _) in enumerate(good)
                        if n != k and len(w) == len(v))
        same = [(-s, good[n][0]) for s, _, _, n in scored if good[n][2] == c][:positives]
        for p, j in same:
            fit = [(-s, good[n][0]) for s, _, _, n in scored if good[n][2] != c and low * p <= 100 * -s <= high * p][:most]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fit)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def vectors(n, dim, seed, labels=4):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for k in range(n):
        c = rng.choice(range(labels)) if k % 3 else 0
        v = np.array([a + 0.4 * b + rng.gauss(0, 0.5) for a, b in zip(centre[c], centre[(c + 1) % labels])], np.float32)
        out.append((k, [float(x) for x in v], c))
    return out


@pytest.mark.parametrize("block_bytes,tree_rows", [(None, 256), (2000, 4), (600, 1)], ids=["one block", "many blocks", "single anchors"])
def test_against_brute_force(spark, block_bytes, tree_rows):
    rows = vectors(150, 6, 1)
    rows += [(1000, None, 1), (1005, [1.0] * 6, None), (1010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1015, [float("nan")] * 6, 1), (1020, [float("inf")] * 6, 2),
             (1025, [0.0] * 6, 1), (1030, [1.0, 2.0], 1), (1031, [2.0, 1.0], 1), (1032, [0.5, 0.5], 2), (1035, [], 1), (1036, [], 2), (1037, [], 1),
             (None, rows[7][1], 1), (None, rows[8][1], 2), (1040, [3.0] * 6, 77)]
    rows += [rows[5], rows[5], rows[10], rows[11]]
    anchor = F.col("vec_id") % 5 == 0
    got = found(negatives.hard_negatives(make(spark, rows), anchor, tree_rows=tree_rows, block_bytes=block_bytes))
    want = brute(rows, lambda i: i is not None and i % 5 == 0)
    assert len(want) > 500 and got == want


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, [1.0, 0.0], 0) for k in range(20)] + [(k, [0.5, 1.0], 1) for k in range(40, 20, -1)]
    got = found(negatives.hard_negatives(make(spark, rows), F.col("vec_id") == 0, block_bytes=300))
    assert got == brute(rows, lambda i: i == 0) and {r[3] for r in got} == set(range(21, 31))


def test_a_label_with_most_rows(spark):
    rows = [(i, v, 0 if i % 10 else 1) for i, v, _ in vectors(200, 4, 2)]
    got = found(negatives.hard_negatives(make(spark, rows), F.col("vec_id") % 20 == 1, block_bytes=800))
    assert got == brute(rows, lambda i: i % 20 == 1)


def test_large_components_stay_exact(spark):
    big = [(k, [float(np.float32(v * 5e5)) for v in x], c) for k, x, c in vectors(60, 4, 3)]
    got = found(negatives.hard_negatives(make(spark, big), F.col("vec_id") % 6 == 0))
    assert max(abs(r[4]) for r in got) > 1 << 54
    assert got == brute(big, lambda i: i % 6 == 0)


def test_scores_beyond_64_bits_are_set_to_the_limit(spark):
    rows = [(k, [v, v], c) for k, (v, c) in enumerate([(1e30, 0), (1e30, 0), (2.0, 1), (1e20, 1)])]
    got = found(negatives.hard_negatives(make(spark, rows), F.col("vec_id") < 2, low=0, high=100))
    top = (1 << 63) - 1
    assert got == [(a, 1 - a, r, n, top, top) for a in (0, 1) for r, n in ((1, 2), (2, 3))]


def test_no_anchors_and_empty_table(spark):
    rows = make(spark, vectors(30, 3, 4))
    assert found(negatives.hard_negatives(rows, F.lit(False))) == []
    assert found(negatives.hard_negatives(rows.limit(0), F.lit(True))) == []


def _rows(points, ids):
    import pyarrow as pa

    return negatives._Rows(pa.table({"vec": pa.array(points.tolist()), "node": pa.array(ids), "id": pa.array(ids)}), points.shape[1], 1)


def test_tree_is_minimal_and_bounds_spare_scores():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1, 8)) * 300
    points = np.floor(base + rng.normal(size=(40, 8)) * 6)
    order, parent, edge = negatives.spanning_tree(points)
    assert sorted(order) == list(range(40)) and all(p < k for k, p in enumerate(parent))
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    assert edge[1:] == pytest.approx([far[order[k], order[parent[k]]] for k in range(1, 40)])
    # Kruskal's total.
    root, total = list(range(40)), 0.0
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for d, a, b in sorted((far[a, b], a, b) for a in range(40) for b in range(a)):
        if top(a) != top(b):
            root[top(a)] = top(b)
            total += d
    assert edge.sum() == pytest.approx(total)
    cands = _rows(np.floor(rng.normal(size=(5000, 8)) * 200), np.arange(5000))
    window = [(int(np.quantile(cands.q @ points[0], 0.9)), int(np.quantile(cands.q @ points[0], 0.95)))]
    anchors = _rows(points, np.arange(40))
    got, scored = negatives.best_in_windows(cands, anchors, [(order, parent, edge)], 3, lambda k: window, lambda k, at: at % 2 == 0)
    assert scored < 0.4 * 40 * 5000
    for k in range(40):
        s = (cands.q @ points[k]).astype(int)
        want = sorted((-s[i], i) for i in range(0, 5000, 2) if window[0][0] <= s[i] <= window[0][1])[:3]
        assert [(-a, b) for a, b in zip(*got[k][0])] == want
