import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import decontamination as D
from tallyframe.llm import words as W

ITEMS = "item_id bigint, text string"


def plain_distance(item, text):
    """Smallest edit distance of the item to a run of the text, by the textbook table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for word in text:
        new = [0]
        for k, own in enumerate(item, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (own != word)))
        row, best = new, min(best, new[-1])
    return best


def hashes(text):
    return D.plain_words(*W.string_parts(pa.array([text])))[0].tolist()


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + (kind > 0)] = [] if kind == 1 else [f"new{rng.randrange(10**6)}"]
    return words


def test_edit_distance_is_exact():
    rng = random.Random(2)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        assert D.edit_distance(item, text) == plain_distance(item, text)


def test_words_ignore_case_and_marks():
    assert hashes("It's, A test!! $$$") == hashes("it s a TEST")
    assert hashes("été") != hashes("ete")


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25])
def test_recall_of_edited_copies(prose, share):
    rng = random.Random(4)
    items = [prose(rng.randint(8, 60), k).split() for k in range(60)]
    matcher = D.Matcher([hashes(" ".join(i)) for i in items])
    texts, truth = [], []
    for k, item in enumerate(items):
        copy = edited(item, int(len(item) * share), rng)
        texts.append(" ".join([prose(40, 1000 + k), *copy, prose(40, 2000 + k)]))
        truth.append((k, k))
    found = {(r, i) for r, i, _ in matcher.match(*D.plain_words(*W.string_parts(pa.array(texts))))}
    assert len(found & set(truth)) >= 0.95 * len(truth)


def test_operator_against_brute_force(spark, make_docs, prose, edges):
    rng = random.Random(5)
    items = [(k, prose(12 + 3 * k, k).capitalize() + ".") for k in range(10)] + [(10, None), (11, ""), (12, "too short"), (3, prose(21, 3))]
    rows = edges + [(100 + k, prose(60, 50 + k)) for k in range(15)]
    for k in range(10):
        rows.append((200 + k, " ".join([prose(30, 300 + k), *edited((items[k][1] or "").split(), k % 4 * 2, rng), prose(30, 400 + k)])))
    rows += [(300, items[2][1] + " and " + items[2][1] + " " + items[5][1]), (300, items[2][1])]
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id", "2 AS n_edits")
    expected = set()
    for doc, text in rows:
        for item, own in items:
            words = hashes(own or "")
            if len(words) >= 5:
                edits = plain_distance(words, hashes(text or ""))
                if edits <= len(words) // 4:
                    expected.add((doc, item, edits, len(words)))
    found = [(r.doc_id, r.item_id, r.n_edits, r.n_words) for r in D.contaminated(make_docs(rows), bench).collect()]
    assert set(found) == expected and {f[0] for f in found} >= {200 + k for k in range(10)}
    small = D.contaminated(make_docs(rows), bench, block_bytes=200)
    assert {(r.doc_id, r.item_id, r.n_edits, r.n_words) for r in small.collect()} == expected
    kept = D.without_contaminated(make_docs(rows), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if i not in {f[0] for f in found})
    assert D.contaminated(make_docs(rows).limit(0), bench).collect() == []
    assert D.contaminated(make_docs(rows), bench.limit(0)).collect() == []
