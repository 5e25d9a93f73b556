import math

import numpy as np
import pytest

from tallyframe.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, cell int, kept int, n int"


def clusters(seed, labels=3, centres=6, copies=8, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for _ in range(centres):
            centre = rng.standard_normal(dim)
            for _ in range(copies):
                rows.append(((centre + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.15, 0.3])).astype(np.float32).tolist(), label))
    return rows


def brute(rows, least=0.98):
    def good(vec, label):
        return label is not None and vec and all(x is not None and math.isfinite(x) for x in vec) and any(vec)

    label = list(range(len(rows)))
    links = [0] * len(rows)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if good(v, g) else None for _, v, g in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if float(unit[i] @ unit[j]) >= least:
                links[i] += 1
                links[j] += 1
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None), default=None)
        out.append((str(vec_id), links[k], low, vec_id is not None and vec_id == low))
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame, **options).collect())


@pytest.mark.parametrize("options", [{}, {"cell_rows": 8}, {"cell_rows": 8, "task_rows": 5}], ids=["one cell", "cuts", "split cells"])
def test_against_brute_force(spark, options):
    rows = [(k, *r) for k, r in enumerate(clusters(1))]
    one = rows[0][1]
    rows += [(500, one, 0), (501, one, 0), (501, one, 0), (502, one, 1), (503, one, None), (None, one, 0), (504, None, 0),
             (505, [], 0), (506, [0.0] * 24, 0), (507, [math.nan] + [1.0] * 23, 0), (508, [None] + [1.0] * 23, 0),
             (509, [math.inf] + [1.0] * 23, 0), (510, one[:12], 0), (511, one[:12], 0), (512, [x * 1e-30 for x in one], 0),
             (513, [-x for x in one], 0), (None, None, None)]
    assert run(spark, rows, **options) == brute(rows)


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_count_is_calibrated():
    need = embeddings.least_count(24, 0.999)
    inside = math.erf(embeddings.WINDOW / math.sqrt(2))
    reach = sum(math.comb(24, k) * inside**k * (1 - inside) ** (24 - k) for k in range(need, 25))
    assert need < 24 and reach >= 0.999
