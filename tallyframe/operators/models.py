"""Regressions fitted from sums that Spark aggregates.

A fit needs the number of rows, the column means and the centred cross-products
of the design.  Two aggregates with map-side combine serve any number of
models: the first takes the mean of every column, the second sums the products
of the columns less that mean, once per pair and set of rows however many
models share it.  Only these sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.stats import solve_normal, t_quantile, t_two_sided
from tallyframe.operators.skew import sized_join
from tallyframe.session import cut_lineage, drop_stage

Term = str | tuple[str, ...]

MAX_LEVELS = 1000       # a factor with more levels is absorbed, not listed
BATCH_SUMS = 200        # aggregate expressions per job
EXACT = 1e-12           # a residual share below this is rounding: an exact fit
ABSORBED = 1e-11        # blocks take turns until the columns move less than this, in standard deviations
LOCAL_SIZES = 50_000    # rows of sums by group size that the driver holds; more are summed again on the cluster for each ratio
RATIOS, RATIO_POINTS, RATIO_HALVINGS = (1e-6, 1e6), 49, 80


@dataclass(frozen=True)
class Model:
    """Response, terms and an optional grouping column for a random intercept.

    A term is a column name or a tuple of names, which is their product.
    Text columns are factors: one column per level after the first by sort.
    """

    response: str
    terms: tuple[Term, ...] = ()
    group: str | None = None

    @property
    def label(self) -> str:
        right = " + ".join(t if isinstance(t, str) else ":".join(t) for t in self.terms) or "1"
        return f"{self.response} ~ {right}" + (f" + (1|{self.group})" if self.group else "")


def crossed(*names: str) -> tuple[Term, ...]:
    """Main effects and all products of the names."""
    products = [c for size in range(2, len(names) + 1) for c in combinations(names, size)]
    return (*names, *products)


@dataclass
class Fit:
    model: Model
    names: list[str]            # design columns, without the intercept
    columns: list[Column]
    n: int
    means: np.ndarray
    coef: np.ndarray            # intercept first
    errors: np.ndarray
    r2: float
    sigma2: float
    inverse: np.ndarray         # of the centred cross-products
    df: int

    def fitted(self) -> Column:
        """The fitted value as a column expression; NULL where a term is NULL."""
        value = F.lit(float(self.coef[0]))
        for beta, column in zip(self.coef[1:], self.columns):
            # A dropped column adds nothing, but its NULLs still count.
            value = value + column * F.lit(0.0 if math.isnan(beta) else float(beta))
        return value


# --- design ------------------------------------------------------------------

def _number(column: Column) -> Column:
    """As a double; what is not a finite number is missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _factor_levels(df: DataFrame, names: Sequence[str]) -> tuple[dict[str, list[str]], set[str]]:
    """Sorted levels of each factor, and the names of those with too many to list."""
    levels, many = {}, set()
    for name in names:
        rows = df.select(name).filter(F.col(name).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
        levels[name] = sorted(r[0] for r in rows)
        if len(rows) > MAX_LEVELS:
            many.add(name)
    return levels, many


def _design(model: Model, levels: dict[str, list[str]]) -> list[tuple[str, Column]]:
    def one(name: str) -> list[tuple[str, Column]]:
        if name in levels:
            return [(f"{name}={v}", (F.col(name) == v).cast("double")) for v in levels[name][1:]]
        return [(name, _number(F.col(name)))]

    out = []
    for term in model.terms:
        parts = [one(t) for t in ((term,) if isinstance(term, str) else term)]
        made = parts[0]
        for part in parts[1:]:
            made = [(f"{a}:{b}", x * y) for a, x in made for b, y in part]
        out += made
    return out


def _term_names(model: Model) -> set[str]:
    return {n for t in model.terms for n in ((t,) if isinstance(t, str) else t)}


def _factors(df: DataFrame, models: Sequence[Model]) -> list[str]:
    used = {n for m in models for n in _term_names(m)}
    return sorted(n for n in used if isinstance(df.schema[n].dataType, T.StringType))


# --- least squares -----------------------------------------------------------

def ols_many(df: DataFrame, models: Sequence[Model]) -> list[Fit]:
    """Fit several models in two passes; rows with a NULL leave only their model.

    NaN and infinity count as missing.  Factors of more than MAX_LEVELS levels, and products with
    one, are absorbed (see :func:`_absorbed`).
    """
    levels, many = _factor_levels(df, _factors(df, models))
    wide_models = [m for m in models if many & {t for t in _term_names(m)}]
    if wide_models:
        listed = iter(ols_many(df, [m for m in models if m not in wide_models]) if len(wide_models) < len(models) else [])
        return [_absorbed(df, m, levels, many) if m in wide_models else next(listed) for m in models]
    designs = [_design(m, levels) for m in models]
    # Every distinct column once; (name, column) with the response of each model last.
    variables = [[*d, (f"{m.response}", _number(F.col(m.response)))] for m, d in zip(models, designs)]
    index: dict[str, int] = {}
    columns: list[Column] = []
    for name, column in (v for vs in variables for v in vs):
        if name not in index:
            index[name] = len(columns)
            columns.append(column)
    wide = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    # The sums are written as SQL text: hundreds of them, one call to build.
    first = wide.selectExpr(*[f"avg(c{i}) AS a{i}" for i in range(len(columns))],
                            *[f"count_if(c{i} IS NULL) AS u{i}" for i in range(len(columns))]).first()
    centre = [first[f"a{i}"] or 0.0 for i in range(len(columns))]
    gaps = {i for i in range(len(columns)) if first[f"u{i}"]}
    wide = wide.selectExpr(*[f"c{i} - {centre[i]!r}D AS c{i}" for i in range(len(columns))])

    # Models whose columns with gaps are the same read the same rows.
    used = [[index[name] for name, _ in vs] for vs in variables]
    masks = [tuple(sorted(gaps & set(ids))) for ids in used]
    sums: dict[tuple, str] = {}
    for mask, ids in zip(masks, used):
        known = " AND ".join(f"c{i} IS NOT NULL" for i in mask)

        def total(value: str, known=known) -> str:
            return f"sum({value})" + (f" FILTER (WHERE {known})" if known else "")

        sums.setdefault((mask,), total("1"))
        for k, i in enumerate(ids):
            sums.setdefault((mask, i), total(f"c{i}"))
            for j in ids[k:]:
                sums.setdefault((mask, *sorted((i, j))), total(f"c{i} * c{j}"))
    keys = list(sums)
    values: dict[tuple, float] = {}
    for at in range(0, len(keys), BATCH_SUMS):
        part = keys[at:at + BATCH_SUMS]
        row = wide.selectExpr(*[f"{sums[key]} AS s{i}" for i, key in enumerate(part)]).first()
        values |= {key: row[i] for i, key in enumerate(part)}

    fits = []
    for model, design, ids, mask in zip(models, designs, used, masks):
        n = int(values[(mask,)] or 0)
        if not n:
            fits.append(_no_fit(model, design))
            continue
        shift = np.array([values[(mask, i)] for i in ids]) / n
        cross = np.array([[values[(mask, *sorted((i, j)))] for j in ids] for i in ids])
        cross -= n * np.outer(shift, shift)
        fits.append(_solve(model, design, n, np.array([centre[i] for i in ids]) + shift, cross))
    return fits


def _absorbed(df: DataFrame, model: Model, levels: dict[str, list[str]], many: set[str]) -> Fit:
    """A model with terms of very many columns: factors with many levels, and products that hold one.

    Each such term is a *block*: the levels of its factors together are a key, the product of its numbers a
    weight.  What a block explains is taken out of all other columns on the cluster, key by key, and blocks of
    different keys take turns until nothing moves any more; this is the projection on what none of them explains.  Other
    coefficients, their errors and r2 are those of the model with every level listed; the blocks' own coefficients, and
    the intercept where a block has a mean for each key, are left empty.  The degrees of freedom count the columns of all blocks less one for each
    further factor, or, with two factors and no product, for each part of the levels that no row connects.
    """
    terms = [(t,) if isinstance(t, str) else t for t in model.terms]
    wide = [t for t in terms if many & set(t)]
    rest = Model(model.response, tuple(t for t, named in zip(model.terms, terms) if named not in wide))
    design = _design(rest, levels)
    factors = sorted({n for t in wide for n in t if n in levels})
    first = df.agg(*[F.min(n).alias(f"f{k}") for k, n in enumerate(factors)]).first()
    # With all its parts, a product of factors is a mean for each combination of levels, which holds the parts.
    whole = [t for t in wide if set(t) <= set(levels) and all(
        set(c) in [set(x) for x in terms] for size in range(1, len(t)) for c in combinations(t, size))]
    wide = [t for t in wide if not any(set(t) < set(w) for w in whole)]
    keys, weights = [], []
    for term in wide:
        weight = F.lit(1.0)
        for name in term:
            if name not in levels:
                weight = weight * _number(F.col(name))
            elif term not in whole:
                # A product has no column for a factor's first level.
                weight = weight * (F.col(name) != first[f"f{factors.index(name)}"]).cast("double")
        keys.append([f"g{factors.index(n)}" for n in term if n in levels])
        weights.append(weight)
    # Without a mean for each key, the intercept is a column like any other.
    own = not whole
    names = [f"z{i}" for i in range(own + len(design) + 1)]
    values = [*[F.lit(1.0)] * own, *[c for _, c in design], _number(F.col(model.response))]
    rows = df.select(*[F.col(n).alias(f"g{k}") for k, n in enumerate(factors)], *[w.alias(f"w{b}") for b, w in enumerate(weights)],
                     *[c.alias(n) for n, c in zip(names, values)]).na.drop()
    rows = cut_lineage(rows.withColumn("y", F.col(names[-1])))
    row = rows.agg(F.count("*").alias("n"), F.var_pop("y").alias("y"), *[F.avg(F.col(n) ** 2).alias(n) for n in names]).first()
    if not row["n"]:
        return _no_fit(model, design)
    n, spread, scale = row["n"], row["y"], np.array([row[name] or 1.0 for name in names])
    # Blocks of one key are made independent of each other first and then need no turns.
    for b, key in enumerate(keys):
        for earlier in range(b):
            if keys[earlier] == key:
                rows = _without_block(rows, key, f"w{earlier}", [f"w{b}"]).drop(f"old_w{b}")
    moved = math.inf
    while moved > ABSORBED**2:
        before, now = rows, rows
        for b, key in enumerate(keys):
            now = _without_block(now, key, f"w{b}", names)
        gone = [(F.col(name) - F.col(f"old_{name}")) ** 2 / F.lit(float(size)) for name, size in zip(names, scale)]
        now = cut_lineage(now.withColumn("moved", sum(gone[1:], gone[0])))
        last, moved = moved, (now.agg(F.avg("moved")).first()[0] or 0.0)
        rows = now.drop("moved", *[f"old_{name}" for name in names])
        drop_stage(before)
        if all(key == keys[0] for key in keys) or moved >= last:
            break
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = rows.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in pairs]).first()
    cross = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = row[f"s_{i}_{j}"]
    p = len(names) - 1
    # What is left of a column that the blocks explain is rounding.
    flat = np.diag(cross) <= 1e-14 * n * scale
    flat[p] = False
    cross = np.where(flat[:, None] | flat[None, :], 0.0, cross)
    beta, inverse, kept = solve_normal(cross[:p, :p], cross[:p, p])
    rss = max(cross[p, p] - np.where(kept, beta, 0.0) @ cross[:p, p], 0.0)
    if rss <= EXACT * n * spread:
        rss = 0.0
    df_left = n - int(kept.sum()) - _block_rank(rows, keys, [t in whole for t in wide])
    sigma2 = rss / df_left if df_left > 0 else math.nan
    errors = np.sqrt(sigma2 * np.where(kept, np.diag(inverse), np.nan))
    empty = np.array([] if own else [np.nan])
    return Fit(model=model, names=[d[0] for d in design], columns=[d[1] for d in design], n=n, means=np.zeros(len(design) + 1),
               coef=np.concatenate([empty, beta]), errors=np.concatenate([empty, errors]),
               r2=1 - rss / (spread * n) if spread > 0 else math.nan, sigma2=sigma2, inverse=inverse[own:, own:], df=df_left)


def _without_block(rows: DataFrame, key: list[str], weight: str, names: list[str]) -> DataFrame:
    """The columns less their projection on one block; ``old_`` columns keep what they were before the first block."""
    kept = [c for c in rows.columns if c.startswith("old_")] or [F.col(n).alias(f"old_{n}") for n in names]
    others = [c for c in rows.columns if c not in names and not c.startswith("old_")]
    sums = [F.sum(F.col(weight) * F.col(n)).alias(f"t_{n}") for n in names] + [F.sum(F.col(weight) ** 2).alias("t_w")]
    joined = sized_join(rows, rows.groupBy(*key).agg(*sums), key)
    share = lambda n: F.when(F.col("t_w") > 0, F.col(weight) * F.col(f"t_{n}") / F.col("t_w")).otherwise(0.0)
    return joined.select(*others, *kept, *[(F.col(n) - share(n)).alias(n) for n in names])


def _block_rank(rows: DataFrame, keys: list[list[str]], plain: list[bool]) -> int:
    """Columns of all blocks that do not follow from others (see :func:`_absorbed`)."""
    squares = [rows.groupBy(*key).agg(F.sum(F.col(f"w{b}") ** 2).alias("s")) for b, key in enumerate(keys)]
    # Beside an earlier block of its key, a weight that is the same in a whole key has nothing of its own left.
    sizes = [s.filter("s > 1e-9").count() for s in squares]
    if not (len(keys) == 2 and all(plain) and len(keys[0]) == len(keys[1]) == 1):
        return sum(sizes) - max(0, sum(plain) - 1)
    # Parts of the levels that rows connect: each level takes the smallest label among those it meets.
    (a,), (b,) = keys
    edges = cut_lineage(rows.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().withColumn("label", F.col("a")))
    mark = None
    while True:
        row = edges.agg(F.count_distinct("label"), F.sum(F.xxhash64("label").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark, before = tuple(row), edges
        for side in ("a", "b"):
            least = edges.groupBy(side).agg(F.min("label").alias("low"))
            edges = sized_join(edges, least, [side]).select("a", "b", F.col("low").alias("label"))
        edges = cut_lineage(edges)
        drop_stage(before)
    return sum(sizes) - mark[0]


def ols(df: DataFrame, response: str, terms: Sequence[Term]) -> Fit:
    return ols_many(df, [Model(response, tuple(terms))])[0]


def _no_fit(model: Model, design: list[tuple[str, Column]]) -> Fit:
    p = len(design)
    nothing = np.full(p + 1, np.nan)
    return Fit(model, [d[0] for d in design], [d[1] for d in design], 0, nothing, nothing, nothing,
               math.nan, math.nan, np.zeros((p, p)), 0)


def _solve(model: Model, design: list[tuple[str, Column]], n: int, means: np.ndarray, cross: np.ndarray) -> Fit:
    """A fit from centred cross-products with the response last."""
    p = len(design)
    # What is left of a constant column after centring is rounding.
    flat = np.diag(cross) <= 1e-24 * n * means**2
    cross = np.where(flat[:, None] | flat[None, :], 0.0, cross)
    beta, inverse, kept = solve_normal(cross[:p, :p], cross[:p, p])
    used = np.where(kept, beta, 0.0)
    rss = cross[p, p] - used @ cross[:p, p]
    if rss <= EXACT * cross[p, p]:
        rss = 0.0
    df = n - int(kept.sum()) - 1
    sigma2 = rss / df if df > 0 else math.nan
    variance = np.concatenate([[1 / n + means[:p] @ inverse @ means[:p]], np.where(kept, np.diag(inverse), np.nan)])
    return Fit(
        model=model, names=[d[0] for d in design], columns=[d[1] for d in design], n=n, means=means,
        coef=np.concatenate([[means[p] - used @ means[:p]], beta]),
        errors=np.sqrt(sigma2 * variance),
        r2=1 - rss / cross[p, p] if cross[p, p] > 0 else math.nan,
        sigma2=sigma2, inverse=inverse, df=df)


COEFFICIENT_SCHEMA = (
    "model string, term string, estimate double, std_error double, t double, p_value double, "
    "r2 double, n bigint")


def _null(x: float) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def coefficient_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per model and term; terms that were dropped have NULLs."""
    rows = []
    for fit in fits:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = fit.coef / fit.errors
        for name, b, e, tv in zip(["(Intercept)", *fit.names], fit.coef, fit.errors, t):
            p = float(t_two_sided(tv, fit.df)) if math.isfinite(tv) and fit.df > 0 else None
            rows.append((fit.model.label, name, _null(b), _null(e), _null(tv), p, _null(fit.r2), fit.n))
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def r2_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    return spark.createDataFrame(
        [(f.model.label, _null(f.r2), f.n) for f in fits], "model string, r2 double, n bigint")


def residuals(df: DataFrame, fit: Fit, out: str) -> DataFrame:
    """Response minus fitted value."""
    return df.withColumn(out, F.col(fit.model.response) - fit.fitted())


def predict_interval(df: DataFrame, fit: Fit, points: int = 10, level: float = 0.95, along: str | None = None) -> DataFrame:
    """Prediction and confidence band of the mean on a grid over the range of one term.

    ``along`` is that term, by default the first; other terms stay at their means.  The
    width is t * sqrt(s2 (1/n + x' (X'X)^-1 x)) with x centred.
    """
    name = along or fit.names[0]
    at = fit.names.index(name)
    ends = df.agg(F.struct(F.min(name).cast("double").alias("lo"), F.max(name).cast("double").alias("hi"))).scalar()
    grid = df.sparkSession.range(points).select(ends.alias("e"), F.col("id").alias("step")).select(
        (F.col("e.lo") + (F.col("e.hi") - F.col("e.lo")) * F.col("step") / (points - 1)).alias(name))
    t = t_quantile(0.5 + level / 2, fit.df)
    beta = np.nan_to_num(fit.coef[1:])
    others = float(fit.coef[0] + sum(b * m for k, (b, m) in enumerate(zip(beta, fit.means)) if k != at))
    centred = F.col(name) - F.lit(float(fit.means[at]))
    width = t * F.sqrt(fit.sigma2 * (1 / fit.n + centred * centred * float(fit.inverse[at, at])))
    prediction = F.lit(others) + float(beta[at]) * F.col(name)
    return grid.select(
        name, prediction.alias("prediction"), (prediction - width).alias("lower"), (prediction + width).alias("upper"))


def partial_regression(df: DataFrame, y1: str, y2: str, controls: Sequence[Term]) -> Fit:
    """Regress both on the controls, then the residuals of y1 on those of y2."""
    first, second = ols_many(df, [Model(y1, tuple(controls)), Model(y2, tuple(controls))])
    rows = residuals(residuals(df, first, f"{y1}_residual"), second, f"{y2}_residual")
    return ols(rows, f"{y1}_residual", [f"{y2}_residual"])


# --- random intercept ----------------------------------------------------------

@dataclass
class MixedFit:
    model: Model
    names: list[str]
    coef: np.ndarray
    errors: np.ndarray
    sigma2: float
    tau: float                  # group variance over residual variance
    loglik: float
    n: int
    groups: int


class _Profile:
    """Profile likelihood of the variance ratio from sums per group size.

    Within-group cross-products do not depend on the ratio.  Between groups the
    weight of a group depends on its size only, so all groups of one size act
    through their number, mean and scatter.  At most sqrt(2N) sizes exist.  ``rows`` holds them, or ``table`` where
    there are more than the driver should hold.
    """

    def __init__(self, picked: Sequence[int], names: Sequence[str], rows: np.ndarray | None, table: DataFrame | None = None):
        self.width, self.table, self.rows = len(picked), table, rows
        self.at = [names.index(f"mean_{a}") for a in picked]
        self.pairs = [(a, b) for a in range(self.width) for b in range(a, self.width)]
        spot = lambda kind: [names.index(f"{kind}_{min(picked[a], picked[b])}_{max(picked[a], picked[b])}") for a, b in self.pairs]
        between, within = spot("between"), spot("within")
        if rows is not None:
            self.size, self.count = rows[:, 0], rows[:, 1]
            self.means, self.scatter = rows[:, self.at], rows[:, between]
            self.n, self.groups = int(self.size @ self.count), int(self.count.sum())
            self.within = self._square(rows[:, within].sum(axis=0))
            return
        self.names = [[names[k] for k in cols] for cols in (self.at, between)]
        total = table.agg(F.coalesce(F.sum(F.col("size") * F.col("groups")), F.lit(0)).alias("n"),
                          F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"), *[F.sum(names[k]).alias(f"w{k}") for k in within]).first()
        self.n, self.groups = int(total["n"]), int(total["groups"])
        self.within = self._square([total[f"w{k}"] or 0.0 for k in within])

    def _square(self, values: Sequence[float]) -> np.ndarray:
        out = np.zeros((self.width, self.width))
        for (a, b), v in zip(self.pairs, values):
            out[a, b] = out[b, a] = v
        return out

    def sums(self, tau: float):
        """Cross-products, weight, weighted mean, log-determinant and its slope, and what the slope of the residual sum needs."""
        if self.rows is None:
            return self._spark_sums(tau)
        share = self.size / (1 + self.size * tau)
        total = float(share @ self.count)
        mean = (share * self.count) @ self.means / total
        gap = self.means - mean
        squares = lambda weight: self._square(weight @ self.scatter) + (gap * (weight * self.count)[:, None]).T @ gap
        return (self.within + squares(share), total, mean, float(self.count @ np.log1p(self.size * tau)), float(self.count @ share), squares(share**2))

    def _spark_sums(self, tau: float):
        share = f"(size / (1 + size * {float(tau)!r}D))"
        mean_of, between_of = self.names
        moments = [f"sum(pow({share}, {power}) * groups * {m}) AS m{power}_{a}" for power in (1, 2) for a, m in enumerate(mean_of)]
        squares = [f"sum(pow({share}, {power}) * ({c} + groups * {mean_of[a]} * {mean_of[b]})) AS s{power}_{a}_{b}"
                   for power in (1, 2) for (a, b), c in zip(self.pairs, between_of)]
        row = self.table.selectExpr(f"sum(groups * {share}) AS w1", f"sum(groups * {share} * {share}) AS w2",
                                    f"sum(groups * log1p(size * {float(tau)!r}D)) AS logdet", *moments, *squares).first()
        at = [np.array([row[f"m{power}_{a}"] for a in range(self.width)]) for power in (1, 2)]
        mean = at[0] / row["w1"]
        first, second = (self._square([row[f"s{power}_{a}_{b}"] for a, b in self.pairs]) for power in (1, 2))
        crossed_means = np.outer(at[1], mean)
        second = second - crossed_means - crossed_means.T + row["w2"] * np.outer(mean, mean)
        return self.within + first - row["w1"] * np.outer(mean, mean), row["w1"], mean, row["logdet"], row["w1"], second

    def solved(self, tau: float):
        """(deviance, its slope in the ratio, coefficients, inverse, kept, residual sum, weight, mean, log-determinant)."""
        cross, weight, mean, logdet, trace, slope = self.sums(tau)
        p = self.width - 1
        beta, inverse, kept = solve_normal(cross[:p, :p], cross[:p, p])
        direction = np.append(-np.where(kept, beta, 0.0), 1.0)
        rss = max(cross[p, p] - np.where(kept, beta, 0.0) @ cross[:p, p], 1e-300)
        # At the minimum over the coefficients only the weights move: their slope is minus their square.
        change = -self.n * (direction @ slope @ direction) / rss + trace
        return self.n * math.log(rss / self.n) + logdet, change, beta, inverse, kept, rss, weight, mean, logdet

    def minimise(self) -> float:
        """Ratio of lowest deviance: the best of 0 and a grid of ratios, then halving on the sign of the slope around it."""
        grid = [0.0, *np.exp(np.linspace(math.log(RATIOS[0]), math.log(RATIOS[1]), RATIO_POINTS))]
        at = int(np.argmin([self.solved(t)[0] for t in grid]))
        if at == 0 and self.solved(0.0)[1] >= 0:
            return 0.0
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)]
        for _ in range(RATIO_HALVINGS):
            middle = (low + high) / 2
            low, high = (middle, high) if self.solved(middle)[1] < 0 else (low, middle)
        return (low + high) / 2


def random_intercept_lm(df: DataFrame, model: Model) -> MixedFit:
    """Linear model with one random intercept, by maximum likelihood."""
    return random_intercept_many(df, [model])[0]


def random_intercept_many(df: DataFrame, models: Sequence[Model]) -> list[MixedFit]:
    """Linear models with one random intercept each, by maximum likelihood, from two passes for all of them.

    The first pass takes the means of all columns and finds those with gaps.  In the second, a row counts once for
    each *class* of models (group column and columns with gaps) whose values it has; products of all columns are summed per
    class and group, and then per class and group size.  Every model takes its part of these sums.
    Rows with a missing value or group leave only their models; NaN and infinity count as missing.  A model with no
    more rows than coefficients has no estimates.
    """
    levels, many = _factor_levels(df, _factors(df, models))
    if many:
        raise ValueError(f"{', '.join(sorted(many))}: more than {MAX_LEVELS} levels; use it as the group")
    designs = [_design(m, levels) for m in models]
    variables = [[*d, (m.response, _number(F.col(m.response)))] for m, d in zip(models, designs)]
    index: dict[str, int] = {}
    columns: list[Column] = []
    for name, column in (v for vs in variables for v in vs):
        if name not in index:
            index[name] = len(columns)
            columns.append(column)
    group_names = sorted({m.group for m in models})
    wide = df.select(*[F.col(g).cast("string").alias(f"g{k}") for k, g in enumerate(group_names)], *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    first = wide.selectExpr(*[f"avg(c{i}) AS a{i}" for i in range(len(columns))],
                            *[f"count_if(c{i} IS NULL) AS u{i}" for i in range(len(columns))]).first()
    centre = np.array([first[f"a{i}"] or 0.0 for i in range(len(columns))])
    gaps = {i for i in range(len(columns)) if first[f"u{i}"]}
    picked = [[index[name] for name, _ in vs] for vs in variables]
    classes = list(dict.fromkeys((group_names.index(m.group), tuple(sorted(gaps & set(ids)))) for m, ids in zip(models, picked)))
    of = [classes.index((group_names.index(m.group), tuple(sorted(gaps & set(ids))))) for m, ids in zip(models, picked)]
    known = [" AND ".join([f"g{g} IS NOT NULL", *[f"c{i} IS NOT NULL" for i in mask]]) for g, mask in classes]
    entry = [f"CASE WHEN {test} THEN named_struct('k', {k}, 'g', g{g}) END" for k, ((g, _), test) in enumerate(zip(classes, known))]
    rows = wide.selectExpr(f"explode(filter(array({', '.join(entry)}), x -> x IS NOT NULL)) AS of",
                           *[f"c{i} - {float(centre[i])!r}D AS c{i}" for i in range(len(columns))])
    pairs = sorted({(min(a, b), max(a, b)) for ids in picked for a in ids for b in ids})
    used = sorted({i for ids in picked for i in ids})
    per_group = rows.groupBy("of.k", "of.g").agg(*map(F.expr, [
        "count(*) AS size", *[f"sum(c{i}) AS c{i}" for i in used], *[f"sum(c{a} * c{b}) AS w_{a}_{b}" for a, b in pairs]]))
    per_size = per_group.groupBy("k", "size").agg(*map(F.expr, [
        "count(*) AS groups", *[f"avg(c{i} / size) AS mean_{i}" for i in used],
        *[f"sum(w_{a}_{b} - c{a} * c{b} / size) AS within_{a}_{b}" for a, b in pairs],
        *[f"sum(c{a} * c{b} / size / size) AS square_{a}_{b}" for a, b in pairs]]))
    # Scatter of the group means around the mean of the groups of their size.
    names = ["size", "groups", *[f"mean_{i}" for i in used], *[f"within_{a}_{b}" for a, b in pairs], *[f"between_{a}_{b}" for a, b in pairs]]
    per_size = per_size.selectExpr("k", *names[:2 + len(used) + len(pairs)], *[
        f"square_{a}_{b} - groups * mean_{a} * mean_{b} AS between_{a}_{b}" for a, b in pairs])
    local = per_size.limit(LOCAL_SIZES + 1).collect()
    by_class: dict[int, np.ndarray] = {}
    table = None
    if len(local) > LOCAL_SIZES:
        table = cut_lineage(per_size)
    else:
        for k in range(len(classes)):
            held = [[math.nan if v is None else float(v) for v in r[1:]] for r in local if r["k"] == k]
            by_class[k] = np.array(held).reshape(len(held), len(names))
    out = []
    for model, design, ids, k in zip(models, designs, picked, of):
        profile = _Profile(ids, names, by_class.get(k), None if table is None else table.filter(F.col("k") == k))
        out.append(_mixed_fit(model, design, profile, centre[ids]))
    return out


def _mixed_fit(model: Model, design: list[tuple[str, Column]], profile: _Profile, centre: np.ndarray) -> MixedFit:
    n, p = profile.n, len(design)
    names = [d[0] for d in design]
    if n <= p + 1:
        # As many coefficients as rows: nothing is left to tell the variances from.
        nothing = np.full(p + 1, np.nan)
        return MixedFit(model, names, nothing, nothing, math.nan, math.nan, math.nan, n, profile.groups)
    tau = profile.minimise()
    deviance, _, beta, inverse, kept, rss, weight, mean, _ = profile.solved(tau)
    sigma2 = rss / n
    mean = mean + centre
    variance = np.concatenate([[1 / weight + mean[:p] @ inverse @ mean[:p]], np.where(kept, np.diag(inverse), np.nan)])
    return MixedFit(
        model=model, names=names, coef=np.concatenate([[mean[p] - np.where(kept, beta, 0.0) @ mean[:p]], beta]),
        errors=np.sqrt(sigma2 * variance), sigma2=sigma2, tau=tau,
        loglik=-0.5 * (deviance + n * math.log(2 * math.pi) + n), n=n, groups=profile.groups)


def mixed_table(spark: SparkSession, fits: Sequence[MixedFit]) -> DataFrame:
    """One row per model and term, with the variances of the model."""
    rows = []
    for fit in fits:
        for name, b, e in zip(["(Intercept)", *fit.names], fit.coef, fit.errors):
            z = b / e if e else math.nan
            p = math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else None
            rows.append((fit.model.label, name, _null(b), _null(e), _null(z), p, _null(fit.sigma2),
                         _null(fit.tau * fit.sigma2), _null(fit.loglik), fit.n, fit.groups))
    return spark.createDataFrame(
        rows, "model string, term string, estimate double, std_error double, z double, p_value double, "
              "residual_variance double, group_variance double, loglik double, n bigint, groups bigint")
