import random
import re

import numpy as np
import pytest
import xxhash

from tallyframe.llm import simhash


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, budget=3):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def near_values(seed, centres=12, copies=6, flips=4):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(copies):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("front", [1 << 18, 2], ids=["wide", "depth first"])
def test_trie_join_links_what_all_pairs_link(seed, front, monkeypatch):
    monkeypatch.setattr(simhash, "_FRONT", front)
    values = near_values(seed)
    found = simhash.trie_join(np.array(values, np.uint64), np.zeros(len(values), np.int64), 64, 3)
    assert found.tolist() == brute_components(values)


def test_dense_group_stays_cheap():
    rng = random.Random(1)
    values = sorted({1 << a | 1 << b for a in range(64) for b in range(64)} | {rng.getrandbits(64) for _ in range(500)})
    found = simhash.trie_join(np.array(values, np.uint64), np.zeros(len(values), np.int64), 64, 3)
    assert found.tolist() == brute_components(values)


@pytest.mark.parametrize("node_rows", [1 << 18, 3], ids=["whole nodes", "split nodes"])
def test_distributed_links(spark, node_rows):
    from tallyframe.llm.components import connected_components

    values = near_values(7, centres=20)
    values += [v ^ 1 << 60 for v in values[:10]]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    roots = {r.node: r.root for r in connected_components(simhash.near_links(fps, node_rows=node_rows)).collect()}
    groups = [roots.get(v, v) for v in signed]
    expected = brute_components(values)
    assert len(set(groups)) == len(set(expected)) == len(set(zip(groups, expected)))


def test_operator_against_brute_force(make_docs, prose, edges):
    rows = edges + [(20 + k, prose(60, k)) for k in range(8)]
    for k in range(8):
        words = prose(400, 100 + k).split()
        rows += [(60 + 5 * k, " ".join(words)), (61 + 5 * k, " ".join(words).upper()), (62 + 5 * k, " ".join(words[:-1] + ["end"]))]
    ids = sorted({i for i, _ in rows if i is not None})
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    expected = sorted((str(i), f"{p:016x}", min((x for (x, _), g in zip(rows, label) if g == own and x is not None), default=None))
                      for (i, _), p, own in zip(rows, prints, label))
    found = simhash.simhash_components(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected and ids
    assert simhash.simhash_components(make_docs(rows).limit(0)).collect() == []


def test_one_row_of_each_component_stays(make_docs, prose, edges):
    rows = edges + [(30, prose(300, 1)), (31, prose(300, 1)), (30, prose(300, 1)), (None, prose(300, 1)), (None, prose(90, 2))]
    docs = make_docs(rows)
    groups = {r.root for r in simhash.simhash_components(docs).collect()}
    kept = simhash.one_per_component(docs).collect()
    assert len(kept) == len(groups) and kept[0].asDict().keys() == set(docs.columns)
    assert [r.doc_id for r in kept if r.text == prose(300, 1)] == [30]
    assert [r.doc_id for r in kept if r.text == prose(90, 2)] == [None]
