import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import quality as Q
from tallyframe.llm import words as W


def brute_model(codes, order=Q.ORDER, classes=Q.CLASSES):
    """Interpolated modified Kneser-Ney by dictionaries; a function from code to probability."""
    levels = {order: collections.Counter(codes)}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(code % classes**k for code in levels[k + 1])
    discount, total, kinds = {}, {}, {}
    for k, counts in levels.items():
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discount[k] = [0.0] + [min(max(r - (r + 1) * y * n[r + 1] / n[r], 0.1), r - 0.05) if n[r] else 0.5 for r in (1, 2, 3)]
        total[k], kinds[k] = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0, 0])
        for code, c in counts.items():
            total[k][code // classes] += c
            kinds[k][code // classes][min(c, 3)] += 1

    def p(code, k=order):
        if k == 0:
            return 1 / classes
        code %= classes**k
        lower = p(code, k - 1)
        context = code // classes
        if not total[k][context]:
            return lower
        c = levels[k].get(code, 0)
        mass = sum(d * n for d, n in zip(discount[k], kinds[k][context]))
        return (max(c - discount[k][min(c, 3)], 0) if c else 0) / total[k][context] + mass / total[k][context] * lower

    return p


def codes_of(text):
    return Q.gram_codes(*W.string_parts(pa.array([text])), Q.class_table())[0].tolist()


def test_classes():
    table = Q.class_table()
    assert [table[ord(c)] for c in "aáÄB .\n7é"] == [1, 1, Q.VOWEL, Q.CONSONANT, Q.SPACE, Q.LINE + 1, Q.LINE, Q.DIGIT, 5]
    assert table.max() < Q.CLASSES


def test_model_is_kneser_ney(spark, prose):
    texts = [prose(60, k).capitalize() + "." for k in range(6)]
    grams = Q.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"))
    costs = Q.cost_table(Q.kneser_ney(grams))
    p = brute_model([c for t in texts for c in codes_of(t)])
    for code in codes_of(texts[0]) + codes_of("Zq ## 9 unseen words, really?\n"):
        assert math.exp(-costs[code]) == pytest.approx(p(code), rel=1e-4)
    context = codes_of(texts[0])[20] // Q.CLASSES * Q.CLASSES
    assert np.exp(-costs[context:context + Q.CLASSES].astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_noise_and_repetition_go(spark, make_docs, prose, edges):
    rows = [(k, prose(80, k).capitalize() + ".", "en") for k in range(300)]
    rows += [(1000 + k, prose(40, 900 + k).replace(" ", "%%% ") + "$$$", "en") for k in range(10)]
    rows += [(1100 + k, prose(40, 950 + k).upper() + "!!", "en") for k in range(10)] + [(1200, prose(80, 990), None), (1201, prose(80, 991), "xx")]
    trusted = spark.createDataFrame([(k,) for k in range(200)] + [(None,), (3,), (5000,)], "doc_id bigint")
    found = Q.classify_quality(make_docs(rows + [(i, t, "en") for i, t in edges]), trusted).collect()
    assert len(found) == len(rows) + len(edges)
    kept = {r.doc_id: r.kept for r in found}
    assert sum(kept[k] for k in range(200, 300)) >= 93 and not any(kept[1000 + k] or kept[1100 + k] for k in range(10))
    assert not kept[1] and not kept[2] and kept[1200] is not None and kept[1201] is not None
    nothing = Q.classify_quality(make_docs(rows[:5]), trusted.filter("doc_id > 9000")).collect()
    assert [r.kept for r in nothing] == [True] * 5
    assert Q.classify_quality(make_docs(rows).limit(0), trusted).collect() == []


def test_words_and_their_order_count_in_any_script(spark, make_docs):
    rng = random.Random(3)
    rows, swap = [], str.maketrans("абвгдежзиклмнопрст", "тсрпонмлкизжедгвба")
    words = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    after = {w: rng.sample(words, 2) for w in words}

    def text(ordered=True):
        out = [rng.choice(words)]
        while len(out) < 60:
            out.append(rng.choice(after[out[-1]]))
        if not ordered:
            rng.shuffle(out)
        return " ".join(out)

    rows = [(k, text(), "ru") for k in range(300)] + [(1000 + k, text().translate(swap), "ru") for k in range(10)]
    rows += [(1100 + k, text(False), "ru") for k in range(10)]
    trusted = spark.createDataFrame([(k,) for k in range(200)], "doc_id bigint")
    kept = {r.doc_id: r.kept for r in Q.classify_quality(make_docs(rows), trusted).collect()}
    assert sum(kept[k] for k in range(200, 300)) >= 90
    assert not any(kept[1000 + k] or kept[1100 + k] for k in range(10))


def test_pair_costs_are_kneser_ney():
    got = Q.word_pairs(["Ab cd Ab cd.", "", "漢字 x"], np.array([1, 1, 2]), np.ones(Q.CLASSES**Q.ORDER, np.float32), Q.class_table(),
                       np.zeros(0x110000, np.float32))
    assert np.bincount(got["text"], got["n"]).tolist() == [5, 0, 3]
    assert sorted(got["n"].tolist()) == [1, 1, 1, 1, 1, 1, 2]


def test_rare_language_has_limits_near_its_own_level(spark, make_docs, prose):
    rng = random.Random(8)
    rows = [(k, prose(60, k), "en") for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρσ") for _ in range(rng.randint(2, 9))) for _ in range(60)), "el")
             for k in range(60)]
    for few in (0, 5, 20):
        trusted = spark.createDataFrame([(k,) for k in range(200)] + [(1000 + k,) for k in range(few)], "doc_id bigint")
        found = Q.classify_quality(make_docs(rows), trusted).collect()
        assert sum(r.kept for r in found if r.doc_id >= 1020) >= 20


def test_word_spans_are_the_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab éÑ_1 \n\n\t!?漢字ั่ກ့က　😀\x00-") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, ""]
    words, codes, sizes = Q.coded_words(*W.string_parts(pa.array(texts, pa.string())), Q.kind_table())
    found = [Q._WORD.findall(t or "") for t in texts]
    assert sizes.tolist() == [len(f) for f in found]
    assert [words[c].decode() for c in codes] == [w for f in found for w in f]


def brute_perplexities(rows, known, costs, within):
    """Of (doc_id, lang, text, half): Kneser-Ney over word pairs by dictionaries."""
    def discount(counts):
        n = collections.Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(r - (r + 1) * y * n[r + 1] / n[r], 0.1), r - 0.05) if n[1] and n[r] else 0.5 for r in (1, 2, 3)]

    def level(counts):
        d, total = discount(counts.values()), sum(counts.values())
        return {w: (n - d[min(n, 3)]) / total for w, n in counts.items()}, sum(d[min(n, 3)] for n in counts.values()) / total

    sides, models, every = collections.defaultdict(collections.Counter), {}, collections.defaultdict(collections.Counter)
    for i, lang, text, half in rows:
        words = Q._WORD.findall(text or "")
        if i in known:
            sides[half, lang].update(zip([None, *words], words))
    for side, pairs in sides.items():
        d, total, mass, words = discount(pairs.values()), collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            total[a] += n
            mass[a] += d[min(n, 3)]
            words[b] += 1
        every[side[0]].update(words)
        models[side] = {p: (n - d[min(n, 3)]) / total[p[0]] for p, n in pairs.items()}, {a: mass[a] / total[a] for a in total}, *level(words)
    below = {half: level(c) for half, c in every.items()}
    out = []
    for i, _, text, half in rows:
        words = Q._WORD.findall(text or "")
        s2, r2, s1, r1 = models.get((1 - half, _), ({}, {}, {}, 1.0))
        s0, r0 = below[1 - half]
        pairs, uses, total = collections.Counter(zip([None, *words], words)), collections.Counter([None, *words[:-1]]), 0.0
        for (a, b), n in pairs.items():
            spelling = math.exp(-Q.spelling_costs([b], costs, Q.class_table(), within)[0])
            p = s2.get((a, b), 0) + r2.get(a, 1) * (s1.get(b, 0) + r1 * (s0.get(b, 0) + r0 * spelling))
            total -= math.log(p) + (n - 1) * math.log((1 - Q.CACHE) * p + Q.CACHE * (n - 1) / uses[a])
        out.append((i, math.exp(total / len(text)) if words else None))
    return out


def test_perplexities_are_those_of_dictionaries(spark, make_docs, prose, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "BLOCK_BYTES", 2000)  # several blocks of a language in a task
    rows = [(k, prose(60, k % 50) + " !! " * (k % 4) + "A漢字", (None, "en", "el")[k % 3]) for k in range(90)]
    rows += [(200, prose(30, 3, ("zu", "wy")), "rare"), (201, None, "en"), (202, " \n", "en"), (203, " ", None)]
    docs = make_docs(rows).select("doc_id", "lang", "text")
    trusted = spark.createDataFrame([(k,) for k in range(0, 90, 2)] + [(200,)], "doc_id bigint")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    texts = docs.join(trusted, "doc_id")
    costs = Q.cost_table(Q.kneser_ney(Q.count_grams(texts)))
    within = Q.character_costs(texts)
    known = {r.doc_id for r in trusted.collect()}
    expected = dict(brute_perplexities([tuple(r) for r in docs.withColumn("half", half).collect()], known, costs, within))
    expected = {i: p and pytest.approx(p, rel=1e-9) for i, p in expected.items()}
    assert {r.doc_id: r.perplexity for r in Q.perplexities(docs, trusted).collect()} == expected


def test_pairs_are_sent_per_block_not_per_text(spark, make_docs, prose):
    from pyspark.sql import functions as F

    docs = make_docs([(k, prose(60, k % 5), "en") for k in range(100)], 1).select(
        "doc_id", "lang", F.lit(1).cast("bigint").alias("key"), F.lit(0).alias("half"), (F.col("doc_id") < 50).alias("known"), "text")
    blocks = Q.lay_out(docs).collect()
    assert len(blocks) == 1
    rows = [r for k in range(Q.ROUNDS) for r in Q.sent_pairs(blocks[0].asDict(), k, 2)]
    assert len(rows) <= 2 * Q.ROUNDS
    known = np.concatenate([Q.P._whole(r["known"], np.int64) for r in rows])
    different = {p for s in range(5) for p in zip([None, *prose(60, s).split()], prose(60, s).split())}
    assert len(known) == len(different) and known.sum() == 50 * 60
