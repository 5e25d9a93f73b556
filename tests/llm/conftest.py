import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, lang[, source]]) tuples, with columns whose names clash with the operators' own."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"][len(r) - 2:]), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, DOCS).selectExpr(
            "*", "1 AS score", "'x' AS blk", "2 AS size", "3 AS fp", "4 AS node", "5 AS `row`", "6 AS label", "7 AS h")
        return frame.repartition(partitions)
    return make


@pytest.fixture(scope="session")
def prose():
    """n words of made-up prose, the same for a seed."""
    def make(n, seed, syllables=("ba", "re", "ti", "lo", "mu", "ken", "dor", "is", "ap", "vel")):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    return make


#: Texts every operator must take: (id, text).
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "word of no id"), (None, None), (5, "é中\U0001f600 \x00 x"),
         (6, "a" * 70_000), (7, "!!! ??? 12 34")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
