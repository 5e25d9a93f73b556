import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import toxicity as T
from tallyframe.llm import words as W

BAD = ["idiot", "moron", "scum", "worthless", "stupid"]


@pytest.fixture(scope="module")
def costs(prose):
    from tallyframe.llm.characters import code_points

    text = " ".join(prose(40, k) + " " + " ".join(BAD) for k in range(40))
    points, at = code_points(*W.string_parts(pa.array([text])))
    kinds = np.insert(T.folded()[points], np.repeat(at[:-1], 2), 0).astype(np.int32)
    code = (kinds[:-2] * T.LETTERS + kinds[1:-1]) * T.LETTERS + kinds[2:]
    return T.letter_costs(np.bincount(code, minlength=T.LETTERS**3))


@pytest.mark.parametrize("observed, restored", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("iiiidiooot", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("s-c-u-m", "scum"),
    ("5tup1d", "stupid"), ("STUPIIID", "stupid"), ("s.t.u.p.i.d", "stupid"), ("2024", "2024")])
def test_decoding(costs, observed, restored):
    assert T.decode(observed, costs) == restored


def test_decoding_is_the_cheapest_path(costs):
    """Against all restorations of short lattices of look-alikes."""
    rng = random.Random(1)
    for _ in range(30):
        observed = "".join(rng.choice("ab1idot0") for _ in range(6)) + "d"
        if any(a == b for a, b in zip(observed, observed[1:])):
            continue
        options = []
        for k, c in enumerate(observed):
            own = [(ord(c) - 96, c, 0.0)] if c.isalpha() else [(ord(x) - 96, x, T.AS_LETTER) for x in T.LOOK_ALIKES[c]]
            follow = any(x.isalpha() for x in observed[k + 1:k + 4])
            options.append(own + ([] if c.isalpha() else [(0, c, T.AS_ITSELF if follow else T.BORDER)]))
        best = {}
        import itertools

        for path in itertools.product(*options):
            state, cost = 0, 0.0
            for letter, _, price in path:
                code = state * T.LETTERS + letter
                cost += price + costs[code]
                state = code % T.LETTERS**2
            best["".join(p[1] for p in path)] = cost + costs[state * T.LETTERS]
        assert best[T.decode(observed, costs)] == pytest.approx(min(best.values()))


def corpus(prose):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        words = prose(rng.randint(20, 60), k).split()
        toxic = k % 6 == 0
        if toxic:
            for bad in rng.sample(BAD, 2):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((k, " ".join(words)))
        if k % 2 == 0 or k < 60:
            labels.append((k, int(toxic)))
    return rows, labels


def test_scores_of_held_out_and_disguised_texts(spark, make_docs, prose, edges):
    rows, labels = corpus(prose)
    hidden = [(1000, prose(30, 5000) + " you m0r0n " + prose(9, 5001)), (1001, prose(30, 5002) + " s t u p i d"),
              (1002, "W0RTHLESS " + prose(30, 5003)), (1003, prose(30, 5004) + " sc-um"), (1004, prose(300, 5005))]
    labels += [(1, 7), (None, 1), (2, None)]
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int").selectExpr("*", "1 AS text", "2 AS quality")
    found = T.score_toxicity(make_docs(rows + hidden + edges), known).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(hidden) + len(edges)
    seen = {d for d, _ in labels}
    wrong = [k for k, _ in rows if k not in seen and by_id[k].predicted != int(k % 6 == 0)]
    assert len(wrong) <= 2
    assert [by_id[k].predicted for k in (1000, 1001, 1002, 1004)] == [1, 1, 1, 0]
    assert ("m0r0n", "moron") in {(p.observed, p.restored) for p in by_id[1000].restored}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert {r.predicted for r in found if r.doc_id in (None, 4, 5)} == {0}
    carried = T.score_toxicity(make_docs(rows[:50]), known, carry=True)
    assert carried.select("row.*").columns == make_docs(rows[:1]).columns and carried.count() == 50


def test_without_labels_and_empty(spark, make_docs, prose):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = make_docs(corpus(prose)[0][:20])
    assert {r.predicted for r in T.score_toxicity(docs, none).collect()} == {0}
    assert T.score_toxicity(docs.limit(0), none).collect() == []


def test_copies_count_once():
    keys = np.array([[1, 2, 3, 4], [9, 2, 8, 7], [5, 6, 10, 11], [12, 13, 10, 14], [20, 21, 22, 23]], np.uint64)
    assert T.copy_groups(keys).tolist() == [0, 0, 2, 2, 4]


@pytest.mark.parametrize("observed", ["sc-um", "stu.pid", "i--d--i--o--t", "iiddiioott", "s·cum", "id​iot", "st€pid", "foo£", "mоr-on"])
def test_signs_inside_a_word_are_seen(observed):
    text = f"this one {observed} here"
    spans = T.disguised(*W.string_parts(pa.array([text])))
    assert [text.encode()[a:b].decode() for a, b in spans] == [observed]


@pytest.mark.parametrize("observed, restored", [("sc-um", "scum"), ("stu.pid", "stupid"), ("i--d--i--o--t", "idiot"),
                                                ("iiddiioott", "idiot"), ("s·cum", "scum"), ("id​iot", "idiot")])
def test_signs_inside_a_word_are_decoded(costs, observed, restored):
    new, _, found = T.restore(*W.string_parts(pa.array([f"this one {observed} here"])), costs, {})
    assert new.tobytes().decode() == f"this one {restored} here" and found == [(0, observed, restored)]
