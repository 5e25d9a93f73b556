import collections
import random
import re

import numpy as np
import pytest

from tallyframe.llm import phrases, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(rows, longest):
    n, f = collections.Counter(), collections.Counter()
    for row in rows:
        lang = row[2] if len(row) > 2 else "en"
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(row[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[k:k + size])) for k in range(len(w) - size + 1))
    return n, f


def brute(rows, least=30, longest=4, top=2000, absorbed=80):
    n, f = counts(rows, longest)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, g), a in often.items():
        for size in range(2, len(g)):
            for s in range(len(g) - size + 1):
                if 100 * a >= absorbed * often[lang, g[s:s + size]]:
                    gone.add((lang, g[s:s + size]))
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if (lang, g) not in gone:
            cut = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out[lang].append((-cut[0], -a, " ".join(g).encode(), cut[2], cut[3]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=60, size=80, vocabulary=12):
    """Texts over few words; some words and passages turn up late, so that they become frequent in later shards."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["É", "éa", "New", "york"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab[:4 + k % len(vocab)]) for _ in range(rng.randint(0, size))]
        for _ in range(k % 5):
            words[len(words) // 2:len(words) // 2] = ["new", "York", "CITY", "hall"] if k % 2 else ["late", "bird", "sings"]
        text = "".join(w + rng.choice([" "] * 8 + [", ", ".\n", "\t ", "; "]) for w in words)
        rows.append((k, text, rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"shards": 4, "block_bytes": 300, "home_words": 50}], ids=["defaults", "small blocks"])
def test_against_brute_force(make_docs, edges, options):
    rows = corpus(1) + edges
    got, want = found(phrases.collocations(make_docs(rows), least=6, **options)), brute(rows, 6)
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("least,longest,top,absorbed", [(1, 3, 50, 100), (40, 2, 7, 80)])
def test_other_parameters(make_docs, least, longest, top, absorbed):
    rows = corpus(2, n=25, size=30)
    got = found(phrases.collocations(make_docs(rows), least=least, longest=longest, top=top, absorbed=absorbed, block_bytes=400))
    assert got == brute(rows, least, longest, top, absorbed)


def test_counts_of_every_frequent_phrase(make_docs):
    rows = corpus(3, n=40)
    totals, tables = phrases.count_phrases(make_docs(rows), least=6, block_bytes=500, home_words=100)
    n, f = counts(rows, 4)
    assert {r.lang: r.n for r in totals.collect()} == n
    for size, table in enumerate(tables, 1):
        want = collections.Counter((lang, a) for (lang, g), a in f.items() if len(g) == size and a >= 6)
        assert collections.Counter((r.lang, r.f) for r in table.collect()) == want


def test_one_language_and_one_text_in_most_rows_and_long_texts(make_docs):
    rows = [(k, "the same old story again, the same old story" if k % 3 else f"other words of {k % 5} here", "en" if k % 9 else "de") for k in range(200)]
    rows += [(1, "one two three four five six " * 9000, "en"), (2, "x" * 200_000 + " y " * 40, "en")]
    assert found(phrases.collocations(make_docs(rows), shards=2, block_bytes=2000)) == brute(rows)


def test_empty_table_and_no_words(make_docs):
    assert found(phrases.collocations(make_docs([(1, "a b")]).limit(0))) == []
    assert found(phrases.collocations(make_docs([(1, None), (2, " .,\n")]))) == []


def test_phrases_start_before_words_end():
    """A phrase starts one scan after the later of its parts, and -1 parts pieces."""
    home, pairs, n, starts, codes = phrases.grown(np.array([0, 1, 2, -1, 1, 0, 1, 3, 0, 1], np.int32), np.array([10, 11, 12, -1]), np.array([0, 2, 1, -1], np.int16), 3)
    assert list(home) == sorted(home)
    assert sorted((*p, c, s) for p, c, s in zip(pairs.tolist(), n.tolist(), starts.tolist())) == [(10, 11, 3, 3), (11, 10, 1, 3), (11, 12, 1, 3)]
    named = [tuple(pairs[c]) if c >= 0 else None for c in codes]
    assert named == [(10, 11), (11, 12), None, (11, 10), (10, 11), None, (10, 11)]


def test_pieces_and_words():
    import pyarrow as pa

    texts = ["Ab  aB\tÀ,x\x0by", None, "", "y:y", "z"]
    distinct, n, codes = phrases.piece_codes(*words.string_parts(pa.array(texts)))
    assert [distinct[c].decode() if c >= 0 else None for c in codes] == ["ab", "ab", "À", None, "x", None, "y", None, "y", None, "y", None, "z"]
    assert n[distinct.index(b"y")] == 3 and n.sum() == 8
