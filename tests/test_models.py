import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.stats import betainc, solve_normal, t_quantile, t_two_sided
from tallyframe.operators import models
from tallyframe.operators.models import Model, crossed


def test_t_distribution():
    assert float(t_two_sided(2.0, 10)) == pytest.approx(0.07338803477074)
    assert float(t_two_sided(12.7062047362, 1)) == pytest.approx(0.05)
    assert t_quantile(0.975, 8) == pytest.approx(2.3060041352)
    assert float(betainc(2.0, 3.0, 0.4)) == pytest.approx(0.5248)


def test_solve_normal_drops_dependent_columns():
    a = np.array([[2.0, 4.0, 1.0], [4.0, 8.0, 2.0], [1.0, 2.0, 3.0]])
    x, inverse, kept = solve_normal(a, np.array([3.0, 6.0, 4.0]))
    assert list(kept) == [True, False, True] and math.isnan(x[1])
    assert x[0] * 2 + x[2] == pytest.approx(3)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        g = f"g{i % 12 if i % 3 else 0}"
        a, b = rng.gauss(1000, 3), rng.gauss(0, 2)
        u = (hash_like(g) % 7) / 3
        y = 2 + 0.5 * a - 1.5 * b + 0.25 * (a - 1000) * b + u + rng.gauss(0, 0.3)
        rows.append((g, a, None if i % 25 == 0 else b, y, float(rng.randint(0, 6)), 1.0 if b + rng.gauss(0, 1) > 0 else 0.0))
    return spark.createDataFrame(rows, "g string, a double, b double, y double, k double, hit double").repartition(5)


def hash_like(text):
    return sum(ord(c) * (i + 3) for i, c in enumerate(text))


def dense(table, terms, response="y"):
    rows = [r for r in table.collect() if all(r[t] is not None for t in ("a", "b"))]
    x = np.array([[1.0] + [math.prod(r[n] for n in ((t,) if isinstance(t, str) else t)) for t in terms] for r in rows])
    return x, np.array([r[response] for r in rows]), [r.g for r in rows]


def test_ols_against_dense_least_squares(table):
    terms = crossed("a", "b")
    fit = models.ols(table, "y", terms)
    x, y, _ = dense(table, terms)
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert fit.n == len(y)
    assert np.allclose(fit.coef, beta, rtol=1e-5)
    assert fit.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    sigma2 = rss[0] / (len(y) - 4)
    assert np.allclose(fit.errors[1:], np.sqrt(sigma2 * np.diag(np.linalg.inv(x.T @ x)))[1:], rtol=1e-4)


def test_many_models_share_a_pass(table, spark):
    specs = [Model("y", ("a",)), Model("y", ("b",)), Model("y", ("g",)), Model("a", ("b", "g")), Model("y", ("a", "a2"))]
    wide = table.withColumn("a2", 2 * F.col("a"))
    fits = models.ols_many(wide, specs)
    slope = wide.agg(F.regr_slope("y", "a")).first()[0]
    assert fits[0].coef[1] == pytest.approx(slope) and fits[0].n == 300
    assert fits[1].n == wide.filter("b is not null").count()
    assert len(fits[2].names) == wide.select("g").distinct().count() - 1
    assert math.isnan(fits[4].coef[2]) and fits[4].coef[1] == pytest.approx(slope)
    rows = models.coefficient_table(spark, fits).collect()
    assert [r.estimate for r in rows if r.term == "a2"] == [None]
    single = models.ols(wide, "a", ("b", "g"))
    assert np.allclose(single.coef, fits[3].coef)


def test_interaction_equals_one_line_per_group(table):
    full = models.ols(table, "y", ("b", "g", ("b", "g")))
    lines = {r.g: (r.slope, r.icpt) for r in table.groupBy("g").agg(
        F.regr_slope("y", "b").alias("slope"), F.regr_intercept("y", "b").alias("icpt")).collect()}
    for r in table.filter("b is not null").select("g", "b", full.fitted().alias("f")).limit(40).collect():
        assert r.f == pytest.approx(lines[r.g][1] + lines[r.g][0] * r.b, rel=1e-9)


def test_band_residuals_and_partial_regression(table):
    fit = models.ols(table, "y", ["b"])
    band = models.predict_interval(table, fit).orderBy("b").collect()
    assert len(band) == 10
    x, y, _ = dense(table, ["b"])
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    at = np.array([1.0, band[0].b])
    half = t_quantile(0.975, len(y) - 2) * math.sqrt(rss[0] / (len(y) - 2) * at @ np.linalg.inv(x.T @ x) @ at)
    assert band[0].upper - band[0].prediction == pytest.approx(half)
    left = models.residuals(table, fit, "e").agg(F.sum("e"), F.count("e")).first()
    assert left[0] == pytest.approx(0, abs=1e-6) and left[1] == len(y)
    known = table.filter("b is not null")
    partial = models.partial_regression(known, "y", "a", ["b"])
    assert partial.coef[1] == pytest.approx(models.ols(known, "y", ["a", "b"]).coef[1])


def deviance(x, y, groups, tau):
    member = np.array([[float(a == b) for b in groups] for a in groups])
    v = np.eye(len(y)) + tau * member
    inverse = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ inverse @ x, x.T @ inverse @ y)
    e = y - x @ beta
    return len(y) * math.log(e @ inverse @ e / len(y)) + np.linalg.slogdet(v)[1], beta


@pytest.mark.parametrize("local_sizes", [50_000, 1])
def test_random_intercept_against_dense_likelihood(table, monkeypatch, local_sizes):
    monkeypatch.setattr(models, "LOCAL_SIZES", local_sizes)
    if local_sizes == 1:
        monkeypatch.setattr(models._Profile, "minimise", lambda self: 3.7)
    terms = ("a", "b")
    fit = models.random_intercept_lm(table, Model("y", terms, "g"))
    x, y, groups = dense(table, terms)
    value, beta = deviance(x, y, groups, fit.tau)
    assert np.allclose(fit.coef, beta, rtol=1e-6)
    assert fit.loglik == pytest.approx(-0.5 * (value + len(y) * math.log(2 * math.pi) + len(y)))
    if local_sizes > 1:
        assert all(value <= deviance(x, y, groups, fit.tau * s)[0] + 1e-9 for s in (0.9, 0.99, 1.01, 1.1))
    assert fit.groups == len(set(groups))


def test_random_intercept_at_the_boundary(spark):
    rows = [(f"g{i // 2}", float((i // 2) ** 2), 2.0 * (i // 2) ** 2 + (-1) ** i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, a double, y double")
    fit = models.random_intercept_lm(df, Model("y", ("a",), "g"))
    assert fit.tau == 0 and np.allclose(fit.coef, models.ols(df, "y", ["a"]).coef)
    empty = models.random_intercept_lm(df, Model("y", (), "g"))
    assert len(empty.coef) == 1 and empty.tau > 1


def test_what_is_no_number_is_missing(table):
    odd = table.withColumn("b", F.when(F.col("a") > 1003, float("nan")).when(F.col("a") < 997, float("inf")).otherwise(F.col("b")))
    gaps = table.withColumn("b", F.when(F.col("a").between(997, 1003), F.col("b")))
    one, two = (models.ols(t, "y", ("a", "b")) for t in (odd, gaps))
    assert one.n == two.n < 288 and np.allclose(one.coef, two.coef)


def test_a_factor_of_many_levels_is_absorbed(table, monkeypatch):
    listed = models.ols_many(table, [Model("y", ("a", "g")), Model("y", ("a",))])
    monkeypatch.setattr(models, "MAX_LEVELS", 3)
    absorbed = models.ols_many(table, [Model("y", ("a", "g")), Model("y", ("a",))])
    assert absorbed[0].names == ["a"] and math.isnan(absorbed[0].coef[0]) and absorbed[0].df == listed[0].df
    assert absorbed[0].coef[1] == pytest.approx(listed[0].coef[1]) and absorbed[0].errors[1] == pytest.approx(listed[0].errors[1])
    assert absorbed[0].r2 == pytest.approx(listed[0].r2) and absorbed[1].coef[1] == pytest.approx(listed[1].coef[1])


def test_several_wide_factors_and_products_are_absorbed(table, monkeypatch):
    rows = table.withColumn("h", F.concat(F.lit("h"), (F.col("a") * 7).cast("int") % 6)).withColumn("u", F.sin(F.col("a") * 3))
    specs = [Model("y", ("a", "g", "h")), Model("y", ("u", "g", "h", ("g", "h"))), Model("y", ("a", "u", "g", ("g", "a"))), Model("y", ("u", ("g", "a"), "b"))]
    listed = models.ols_many(rows, specs)
    monkeypatch.setattr(models, "MAX_LEVELS", 3)
    for full, fit in zip(listed, models.ols_many(rows, specs)):
        names = [n for n in fit.names if not math.isnan(fit.coef[1 + fit.names.index(n)])]
        assert set(fit.names) <= set(full.names) and names
        for name in names:
            if fit.model is specs[2] and name == "a":
                continue
            at, of = 1 + fit.names.index(name), 1 + full.names.index(name)
            assert fit.coef[at] == pytest.approx(full.coef[of], rel=1e-6, abs=1e-9)
            if full.df == fit.df:
                assert fit.errors[at] == pytest.approx(full.errors[of], rel=1e-6)
        assert fit.r2 == pytest.approx(full.r2) and fit.n == full.n
    assert models.ols(rows, "y", ("a", "g", "h")).df == listed[0].df


def test_five_thousand_levels(spark):
    rows = spark.range(100_000).selectExpr("concat('g', id % 5000) AS g", "concat('h', pmod(xxhash64(id), 5000)) AS h", "cast(id % 97 AS double) AS x").selectExpr(
        "g", "h", "x", "3 * x + length(g) + 2 * length(h) AS y")
    fit = models.ols(rows, "y", ("x", "g"))
    assert fit.coef[1] == pytest.approx(3, rel=1e-2) and fit.n == 100_000
    both = models.ols(rows, "y", ("x", "g", "h"))
    assert both.coef[1] == pytest.approx(3) and both.r2 == pytest.approx(1)


def test_search_on_the_cluster_finds_the_same_ratio(table, monkeypatch):
    model = Model("y", ("a", "b"), "g")
    here = models.random_intercept_lm(table, model)
    monkeypatch.setattr(models, "LOCAL_SIZES", 0)
    there = models.random_intercept_lm(table, model)
    assert there.tau == pytest.approx(here.tau, rel=1e-6) and np.allclose(there.coef, here.coef) and np.allclose(there.errors, here.errors)


def test_models_of_several_classes_share_the_sums(table):
    rows = table.withColumn("h", F.col("a").cast("int") % 7).withColumn("odd", F.when(F.col("a") < 1001, F.col("a")))
    specs = [Model("y", ("a",), "g"), Model("y", ("a", "b"), "g"), Model("y", ("a", ("a", "b")), "h"), Model("k", ("odd",), "g"), Model("y", (), "h")]
    for fit, model in zip(models.random_intercept_many(rows, specs), specs):
        alone = models.random_intercept_lm(rows, model)
        assert fit.n == alone.n and fit.groups == alone.groups
        assert np.allclose(fit.coef, alone.coef, rtol=1e-6) and fit.loglik == pytest.approx(alone.loglik)
    nothing = models.random_intercept_lm(rows.filter("a < 0"), specs[0])
    assert nothing.n == 0 and np.isnan(nothing.coef).all()
    full = models.random_intercept_lm(rows.filter("b IS NOT NULL").limit(3), Model("y", ("a", "b"), "g"))
    assert full.n == 3 and np.isnan(full.coef).all()
