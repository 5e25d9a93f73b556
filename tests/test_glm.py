import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import glm


def phi(x):
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x):
    return math.erfc(-x / math.sqrt(2)) / 2


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        a, b = 1000 + rng.gauss(0, 2), rng.gauss(0, 1) if k % 20 else None
        count = sum(rng.random() < 0.02 * math.exp(0.4 * (a - 1000) / 2) for _ in range(60))
        hit = 0.3 * (a - 1000) + (b or 0) + rng.gauss(0, 1) > 0.5
        rows.append((a, b, count, hit, float(k), a * 2 - 5))
    return spark.createDataFrame(rows, "a double, b double, k int, hit boolean, far double, copy double").repartition(4)


def dense(df, terms, y):
    rows = df.select(*terms, F.col(y).cast("double").alias("_y")).na.drop().collect()
    return np.array([[1.0, *r[:-1]] for r in rows]), np.array([r[-1] for r in rows])


def test_normal_tail(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.4999, 2.5, 3.3, 6.0, 12.0, 36.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").selectExpr("x", f"{glm.normal_tail('x')} AS m").collect()
    for r in got:
        assert r.m * phi(r.x) == pytest.approx(math.erfc(r.x / math.sqrt(2)) / 2, rel=1e-12)


def test_poisson_against_dense_newton(table):
    specs = [("k", ["a"]), ("k", ["a", "b"]), ("k", ["b"])]
    for fit, (_, terms) in zip(glm.poisson_many(table, specs), specs):
        x, y = dense(table, terms, "k")
        mean = x.mean(axis=0)
        mean[0] = 0
        z = x - mean
        beta = np.append(math.log(y.mean()), np.zeros(len(terms)))
        for _ in range(60):
            mu = np.exp(z @ beta)
            beta = beta + np.linalg.solve(z.T @ (z * mu[:, None]), z.T @ (y - mu))
        info = x.T @ (x * mu[:, None])
        assert fit.converged and fit.n == len(y)
        assert fit.coef == pytest.approx(np.append(beta[0] - beta[1:] @ mean[1:], beta[1:]), rel=1e-7)
        assert fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-5)


def test_dependent_terms_and_no_counts(table):
    fit, none, empty = glm.poisson_many(table.withColumn("none", F.lit(0)).withColumn("gap", F.lit(None).cast("double")), [
        ("k", ["a", "copy"]), ("none", ["a"]), ("k", ["gap"])])
    assert math.isnan(fit.coef[2]) and fit.coef[1] == pytest.approx(glm.poisson_many(table, [("k", ["a"])])[0].coef[1])
    assert not none.converged and empty.n == 0 and np.isnan(empty.coef).all()
    assert [r.estimate for r in glm.glm_table(table, [empty]).collect()] == [None, None]


def test_probit_against_dense_scoring(table):
    for terms in (["a"], ["a", "b"]):
        fit = glm.probit_many(table, [("hit", terms)])[0]
        x, y = dense(table, terms, "hit")
        mean = np.append(0, x.mean(axis=0)[1:])
        z, beta = x - mean, np.zeros(len(terms) + 1)
        for _ in range(200):
            eta = z @ beta
            p, d = np.array([cdf(e) for e in eta]), np.array([phi(e) for e in eta])
            w = d * d / (p * (1 - p))
            beta = beta + np.linalg.solve(z.T @ (z * w[:, None]), z.T @ (w * (y - p) / d))
        assert fit.converged and not fit.separated
        assert fit.coef == pytest.approx(np.append(beta[0] - beta[1:] @ mean[1:], beta[1:]), rel=1e-6)
        assert fit.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ (x * w[:, None])))), rel=1e-4)


def penalised(x, y, beta):
    eta = x @ beta
    value = sum(math.log(max(cdf(e) if t else cdf(-e), 1e-300)) for e, t in zip(eta, y))
    w = np.array([phi(e) ** 2 / max(cdf(e) * cdf(-e), 1e-300) for e in eta])
    return value + 0.5 * np.linalg.slogdet(x.T @ (x * w[:, None]))[1]


@pytest.mark.parametrize("outcome", ["far > 200", "far = 239", "far >= 0", "far > 100 AND far < 239 OR far = 100"],
                         ids=["parted", "one positive", "one outcome", "not parted"])
def test_separated_fits_are_finite_and_best(table, outcome):
    rows = table.withColumn("y", F.expr(f"({outcome})"))
    fit = glm.probit_many(rows, [("y", ["far"])])[0]
    assert fit.separated == (outcome != "far > 100 AND far < 239 OR far = 100")
    assert fit.converged and np.isfinite(fit.coef).all() and np.isfinite(fit.errors).all()
    if fit.separated:
        x, y = dense(rows, ["far"], "y")
        best = penalised(x, y, fit.coef)
        for step in ((1e-3, 0), (-1e-3, 0), (0, 1e-5), (0, -1e-5)):
            assert penalised(x, y, fit.coef + step) < best + 1e-12


def test_several_fits_are_the_single_ones(table):
    rows = table.withColumn("y", F.expr("far > 200"))
    together = glm.probit_many(rows, [("hit", ["a"]), ("y", ["far"]), ("hit", ["a", "b"])])
    alone = [glm.probit_many(rows, [s])[0] for s in (("hit", ["a"]), ("y", ["far"]), ("hit", ["a", "b"]))]
    assert all(np.allclose(a.coef, b.coef) and a.separated == b.separated for a, b in zip(together, alone))
