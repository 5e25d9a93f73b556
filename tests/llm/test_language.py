import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language as L

EN = "the quick brown fox and the lazy dog with that house over there when they were young and happy "
DE = "der schnelle braune Fuchs und der faule Hund mit dem Haus dort drüben als sie noch jung und glücklich waren "
RU = "быстрая коричневая лиса и ленивая собака у дома там когда они были молоды "


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_viterbi_is_the_best_path(chunk):
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 7, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = np.round(rng.normal(size=(first[-1], 3)) * 3, 3)
        label = L.viterbi(scores, first, 2.0, chunk)
        for a, b in zip(first, first[1:]):
            def value(path):
                return sum(scores[a + k, x] for k, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
            best = max((value(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert value(label[a:b].tolist()) == pytest.approx(best)


def texts():
    rows = [(k, t * (1 + k % 3), lang) for k, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)]
    return rows + [(100, EN * 3 + DE * 3, "en"), (101, "5 + 5 = 10 !!", "en"), (102, "日本語のテキスト", "en"), (103, EN, None), (104, None, "xx")]


def test_held_out_texts_and_spans(make_docs, edges):
    rows = texts()
    docs = make_docs([r for r in rows] + [(i, t, None) for i, t in edges])
    fold = L.fold(docs["doc_id"], 3)
    found = L.identify(docs.filter((fold != 1) & (docs["doc_id"] < 100)), docs).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) + len(edges) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in rows if r[0] < 60 and r[0] >= 8 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(by_id[i].lang_pred == lang for i, _, lang in held)
    mixed = by_id[100]
    assert [s.lang for s in mixed.spans] == ["en", "de"] and abs(mixed.spans[1].first - len(EN) * 3) <= 12
    assert {by_id[k].lang_pred for k in (101, 104)} == {"und"} and by_id[101].score == 0 and by_id[101].spans == []
    assert by_id[102].lang_pred in ("en", "de", "ru")


def test_nothing_learnt_and_empty_table(make_docs):
    docs = make_docs(texts())
    assert {r.lang_pred for r in L.identify(docs.limit(0), docs).collect()} == {"und"}
    assert L.identify(docs, docs.limit(0)).collect() == []


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", L.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
