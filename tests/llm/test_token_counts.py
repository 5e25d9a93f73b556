import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tallyframe.llm import token_counts as T
from tallyframe.llm import words as W

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ranks():
    return T.read_vocabulary(PATH)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "the", "  ", " ", "   ", "\n", "\t", "▁", "é", "日本", "\U0001F600", "ing", " th", "0", ".", "\x00",
             "ÿ", "<s>", "</s>", "<unk>", "<0x0A>", " " * 17, "ﬁ", "́", "　", "q" * 40]
    return ["", " ", "  ", "x" * 3000, " " * 40] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("cells", [T.TABLE_CELLS, 128 * 64], ids=["room", "full"])
def test_counts_are_those_of_the_library(model, ranks, cells):
    texts = odd_texts(1500)
    machine = T.Transducer(ranks, cells=cells)
    assert machine.token_counts(*W.string_parts(pa.array(texts))).tolist() == [len(model.encode(t)) for t in texts]


def test_more_characters_than_the_table_is_wide(model, ranks):
    chars = [p for p in ranks if len(p) == 1][:600]
    texts = [" ".join(chars[k:k + 50]) + "".join(chars[k:k + 30]) for k in range(0, 600, 25)]
    machine = T.Transducer(ranks)
    assert machine.token_counts(*W.string_parts(pa.array(texts))).tolist() == [len(model.encode(t)) for t in texts]
    assert machine.width > 128


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_chunk_maps_compose_to_the_same_counts(ranks, chunk):
    machine = T.Transducer(ranks)
    text = "the quick  brown fox\njumps over é the 日本 lazy dog" * 3
    symbols = machine.classes(np.frombuffer(text.replace(" ", "▁").encode("utf-32-le"), np.uint32)).astype(np.int64)
    symbols = np.insert(symbols, 0, T._BREAK)
    assert machine.counts(symbols, chunk).sum() == machine.counts(symbols, 4096).sum()


def test_operator_with_edge_rows(spark, make_docs, edges, model):
    rows = edges + [(8, "many words " * 3000)]
    found = T.token_counts(make_docs(rows), PATH).collect()
    expected = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found) and any(r.over_limit for r in found)
    assert T.token_counts(make_docs([(1, "a")]).limit(0), PATH).collect() == []
