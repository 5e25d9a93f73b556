import random

import pytest

from tallyframe.llm.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 40)], [(5, 5), (2, 1), (1, 2), (2, 1)],
    [(random.Random(k).randrange(-30, 30), random.Random(100 + k).randrange(-30, 30)) for k in range(25)]],
    ids=["none", "pair", "chain", "star", "loops", "random"])
def test_against_brute_force(spark, edges):
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    rows = connected_components(frame).collect()
    found = {r.node: r.root for r in rows}
    assert len(rows) == len(found)
    assert found == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
