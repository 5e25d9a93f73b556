import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import secrets

FORMS = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
         ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def brute_base(text):
    spans = []
    for order, (kind, pattern) in enumerate(FORMS):
        for m in pattern.finditer(text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= secrets.LEAST_LENGTH[kind]:
                spans.append((m.start(), order, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def chance(symbols, n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(symbols) for _ in range(n))


HEX, UPPER = "0123456789abcdef", string.ascii_uppercase + string.digits
MIXED = string.ascii_letters + string.digits + "+/"


def texts(prose):
    return [
        (1, f'say token = "{chance(HEX, 40, 1)}" and é\U0001f600 PassWord:hunter22 end'), (2, "key AKIA" + chance(UPPER, 16, 2) + "."),
        (3, "AKIA" + chance(UPPER, 15, 3) + " AKIAAKIA" + chance(UPPER, 14, 3)), (4, "passwd=abcde secret=a.b.c=d api_key:'x' apikey= \"123456"),
        (5, "password=token :abcdef token=secret=abcdef"), (6, chance(HEX, 23, 4) + "g" + chance(HEX, 24, 5) + "-" + chance(HEX, 64, 6)),
        (7, "token" + " " * 300 + "= value_1"), (8, prose(400, 1) + " " + chance(MIXED, 40, 7) + " " + prose(300, 2)),
        (9, "4785380592391139 and MAX_BUFFER_LENGTH_BYTES then aaaaaaaaaaaaaaaaaaaa"), (10, chance(HEX, 24, 8) * 3000),
        (11, " ".join(chance(HEX, 26, k) for k in range(1500)) + " \U0001f600 token: " + chance(MIXED, 30, 9)), (12, "ſecret=abcdefg toKen=abcdefg"),
        (13, prose(200, 3) + ' {"secret" : "' + chance(MIXED, 32, 10) + '"}'), (14, "é" * 50 + chance(UPPER, 30, 11) + "é")]


@pytest.fixture(scope="module")
def model(make_docs, prose):
    return secrets.train(secrets.labelled_strings(make_docs([(k, prose(300, k) + f" token={chance(HEX, 40, k)} 0612345678 the max length of bytes in a buffer") for k in range(40)])))


def test_base_spans_against_brute_force(make_docs, prose, edges, model):
    rows = texts(prose) + edges
    found = secrets.scan_secrets(make_docs(rows), model).select(
        "doc_id", "n_assign", "n_access", "n_hex", secrets.joined(F.col("base")).alias("base")).collect()
    want = sorted((str(i), *[sum(s.startswith(k) for s in brute_base(t)) for k, _ in FORMS], ",".join(brute_base(t))) for i, t in rows)
    assert sorted((str(r.doc_id), *r[1:]) for r in found) == want


def test_random_runs_and_only_those(make_docs, prose, model):
    rows = {r.doc_id: [s.hit for s in r.found if s.kind == "random"] for r in secrets.scan_secrets(make_docs(texts(prose)), model).collect()}
    assert rows.pop(8) == [chance(MIXED, 40, 7)]
    # One character too short for the hex form, and one letter more.
    assert rows.pop(6) == [chance(HEX, 23, 4) + "g"]
    assert rows.pop(14) == [chance(UPPER, 30, 11)]
    # Too few characters for the access form, but random all the same.
    assert rows.pop(3) == ["AKIA" + chance(UPPER, 15, 3)]
    assert not any(rows.values()), rows


def test_found_spans_hold_their_text(make_docs, prose, model):
    given = dict(texts(prose))
    for r in secrets.scan_secrets(make_docs(texts(prose)), model).collect():
        assert all(given[r.doc_id][s.start:s.end] == s.hit for s in r.found)
        assert [s for s in r.found if s.kind != "random"] == r.base


def test_ratio_is_the_sum_over_character_pairs(spark, model):
    words = ["Kq7Zp0XvB2mL9sT4", "reticulation_of_words", "a", "", "abécd"]
    n = len(secrets.KEY_CHARACTERS)

    def brute(word):
        at = [secrets.KEY_CHARACTERS.find(c) for c in word]
        return max(sum(t[a * n + b] for a, b in zip(at, at[1:]) if a >= 0 and b >= 0) for t in model.ratios) / 1000

    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.ratio(F.col("w"), model).alias("r"))
    assert {r.w: r.r for r in frame.collect()} == pytest.approx({w: brute(w) for w in words})


def test_held_out_strings(spark, prose, model):
    """Of strings that no fit has seen, nearly all random ones pass and no ordinary one does."""
    rows = [(chance(s, 24, 1000 + k), 1) for k in range(200) for s in (UPPER, MIXED)]
    rows += [(w, 0) for w in "".join(prose(6000, 77)).split() if len(w) >= 4]
    rows += [(f"{a}_{b}_{c}", 0) for a, b, c in zip(*[prose(300, 80 + k).split() for k in range(3)])]
    frame = spark.createDataFrame(rows, "w string, label int").select("label", (secrets.ratio(F.col("w"), model) >= secrets.LEAST_RATIO).alias("hit"))
    counts = {(r.label, r.hit): r["count"] for r in frame.groupBy("label", "hit").count().collect()}
    assert counts.get((0, True), 0) == 0 and counts[1, True] >= 390


def test_no_samples_and_empty_table(make_docs, spark):
    model = secrets.train(spark.createDataFrame([], "text string, label int"))
    assert secrets.scan_secrets(make_docs([(1, "x")]).limit(0), model).collect() == []
    assert secrets.scan_secrets(make_docs([(1, None)]), model).select("n_assign", "n_random").first() == (0, 0)
    trained = secrets.train(spark.createDataFrame([(None, 1), ("abc", None), ("abc", 2)], "text string, label int"))
    assert trained == model


def test_running_sums(spark):
    frame = spark.createDataFrame([([],), ([5],), (list(range(1, 1400)),)], "x array<bigint>")
    got = [r[0] for r in frame.select(secrets.running_sums(F.col("x"))).collect()]
    assert got[:2] == [[], [5]] and got[2] == [k * (k + 1) // 2 for k in range(1, 1400)]


def test_query_columns(make_docs, model):
    text = "token=abcdef12 AKIA" + chance(UPPER, 16, 5)
    found = secrets.scan_secrets(make_docs([(1, text)]), model)
    row = found.select(F.sha2(secrets.joined(F.col("base")), 256).alias("h"), secrets.joined(F.col("found")).alias("s")).first()
    assert row.s == "assign:0:14,access:15:35" and row.h == hashlib.sha256(row.s.encode()).hexdigest()
