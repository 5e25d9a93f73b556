import collections
import re

import pytest

from tallyframe.llm import substrings


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((str(doc), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def passages(prose):
    shared, edge, short = prose(60, 1), prose(35, 2), prose(34, 3)
    return [(1, prose(50, 10) + "\n" + shared + " " + prose(9, 11)), (2, shared + " " + prose(40, 12)),
            (3, prose(20, 13) + " " + " ".join(shared.split()[5:45])), (4, edge), (5, "x " + edge + " y"), (6, short), (7, short + " z"),
            (8, prose(80, 14)), (8, prose(80, 14)), (9, "der " * 200), (10, " ".join(prose(40, 15).split() * 2)),
            (11, edge[:-1] + "Q"), (12, "\t" + edge.replace(" ", "  ") + "\n")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300], ids=["one block", "many blocks"])
def test_against_brute_force(make_docs, prose, edges, block_bytes):
    rows = passages(prose) + edges
    assert found(substrings.dedup_substrings(make_docs(rows), block_bytes=block_bytes)) == brute(rows)


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_other_windows(make_docs, prose, window):
    rows = [(k, prose(30, k % 7, ("a", "b"))) for k in range(20)]
    assert found(substrings.dedup_substrings(make_docs(rows), window=window, block_bytes=200)) == brute(rows, window)


def test_a_passage_in_a_third_of_all_texts(make_docs, prose):
    common = prose(36, 99)
    rows = [(k, prose(20, k) + (" " + common if k % 3 == 0 else "")) for k in range(90)]
    assert found(substrings.dedup_substrings(make_docs(rows), block_bytes=2000)) == brute(rows)


def test_empty_table_and_carried_columns(make_docs, prose):
    docs = make_docs(passages(prose))
    assert substrings.dedup_substrings(docs.limit(0)).collect() == []
    rows = substrings.dedup_substrings(docs, carry=True).collect()
    assert {r.row.source for r in rows} == {"s"} and "text" not in rows[0].row.asDict()
    assert next(r.kept_text for r in rows if r.doc_id == 7) == passages(prose)[6][1]
