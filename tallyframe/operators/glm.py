"""Generalised linear models by Newton steps on sums that Spark aggregates.

One aggregate per step serves every model that is still on its way: a row adds its score and its information to
the sums of each model it has all values for.  Only those sums reach the driver, which solves p x p systems.  Columns
are centred and scaled first; estimates and errors are given for the columns as they are.

The probit model looks for separation: where some combination of the terms parts the two outcomes, the
likelihood has no maximum, and the likelihood times the square root of the information's determinant is
maximised instead.  Its score needs, beyond the hat diagonals, sums of products of three columns, so it is one aggregate, too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.stats import solve_normal
from tallyframe.operators.models import _number, _null

STEPS = 60              # most steps of a fit
TOLERANCE = 1e-10       # relative change of the deviance that ends it
SERIES = 45             # terms of the normal tail, exact to the last digits on either side of TAIL_FROM
TAIL_FROM = 2.5
FAR = 37.0              # beyond, the normal density is zero in double precision
BATCH_SUMS = 200

TABLE = ("model string, term string, estimate double, std_error double, z double, p_value double, n bigint, "
         "converged boolean, separated boolean")


@dataclass
class GlmFit:
    response: str
    terms: tuple[str, ...]
    n: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0))     # intercept first
    errors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    deviance: float = math.nan
    converged: bool = False
    separated: bool = False

    @property
    def label(self) -> str:
        return f"{self.response} ~ {' + '.join(self.terms)}"


def normal_tail(x: str) -> str:
    """SQL for the upper tail of the normal distribution at x >= 0, over its density: a series near 0, a continued fraction beyond."""
    series = "1.0D"
    for k in range(SERIES, 0, -1):
        series = f"(1.0D + {x} * {x} / {2 * k + 1}.0D * {series})"
    tail = f"({x} + {SERIES}.0D)"
    for k in range(SERIES, 0, -1):
        tail = f"({x} + {k}.0D / {tail})"
    return (f"CASE WHEN {x} < {TAIL_FROM}D THEN 0.5D / (0.3989422804014327D * exp(-{x} * {x} / 2)) - {x} * {series} "
            f"ELSE 1.0D / {tail} END")


def _eta(beta: np.ndarray, columns: Sequence[str]) -> str:
    return " + ".join(f"({float(b)!r}D) * {c}" for b, c in zip(beta, columns))


class _Fitting:
    """One model on its way: centred and scaled columns, the step it stands at and what it has found."""

    def __init__(self, fit: GlmFit, columns: Sequence[str], response: str, known: str):
        self.fit, self.columns, self.response, self.known = fit, ["1.0D", *columns], response, known
        self.size = len(self.columns)
        self.beta = np.zeros(self.size)
        self.last: np.ndarray | None = None     # where the best value so far was found
        self.best = math.inf
        self.step = self.score = np.zeros(self.size)
        self.inverse = np.eye(self.size)
        self.penalised = False
        self.still = 0
        self.done = False
        self.kept: np.ndarray | None = None
        self.info = np.zeros((self.size, self.size))

    def pairs(self, width: int) -> list[tuple[int, ...]]:
        return list(combinations_with_replacement(range(self.size), width))

    def spread(self, sums: dict[tuple[int, ...], float]) -> np.ndarray:
        width = len(next(iter(sums)))
        out = np.zeros((self.size,) * width)
        for spot in np.ndindex(*out.shape):
            out[spot] = sums[tuple(sorted(spot))]
        return out

    def moved(self, value: float, score: np.ndarray, info: np.ndarray) -> None:
        """Take the Newton step from here, or halve the last one if it has not helped."""
        if not value <= self.best + 1e-9 * (abs(self.best) if math.isfinite(self.best) else 0):
            self.step = self.step / 2
            self.beta = self.last + self.step
            self.done = bool(np.abs(self.step).max() < 1e-12)
            return
        close = math.isfinite(self.best) and abs(self.best - value) <= TOLERANCE * (abs(value) + 0.1)
        if self.kept is None:
            # At the start all rows weigh the same, so this finds the terms that others determine.
            self.kept = solve_normal(info, score, 1e-10)[2]
        self.info = np.where(np.outer(self.kept, self.kept), info, np.eye(self.size))
        score = np.where(self.kept, score, 0.0)
        if self.penalised and self.last is not None:
            # The information says little about the penalty's curvature; what the scores of two places differ by says more.
            gone, bent = self.beta - self.last, self.score - score
            if gone @ bent > 0:
                side = np.eye(self.size) - np.outer(gone, bent) / (gone @ bent)
                self.inverse = side @ self.inverse @ side.T + np.outer(gone, gone) / (gone @ bent)
        else:
            self.inverse = np.linalg.inv(self.info)
        self.step, self.score = np.where(self.kept, self.inverse @ score, 0.0), score
        # One step more after the value stands still: the estimates are a square root less sharp than it is.
        # Terms that nearly copy each other never stand quite still.
        self.still = self.still + 1 if close else 0
        self.fit.converged = close and (float(np.abs(self.step).max()) < 1e-7 or self.still == 3)
        self.done = self.fit.converged
        self.best, self.last = value, self.beta
        self.beta = self.beta + self.step


def _prepared(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]]) -> tuple[DataFrame, list[_Fitting], np.ndarray, np.ndarray, dict[str, int]]:
    index: dict[str, int] = {}
    for response, terms in specs:
        for name in (*terms, response):
            index.setdefault(name, len(index))
    wide = df.select(*[_number(F.col(name)).alias(f"c{i}") for name, i in index.items()])
    row = wide.selectExpr(*[f"avg(c{i}) AS a{i}" for i in index.values()], *[f"stddev_pop(c{i}) AS d{i}" for i in index.values()]).first()
    centre = np.array([row[f"a{i}"] or 0.0 for i in index.values()])
    scale = np.array([row[f"d{i}"] or 1.0 for i in index.values()])
    responses = {index[response] for response, _ in specs}
    wide = wide.selectExpr(*[f"(c{i} - {float(centre[i])!r}D) / {float(scale[i])!r}D AS c{i}" for i in index.values()], *[f"c{i} AS y{i}" for i in responses])
    fits = []
    for response, terms in specs:
        ids = [index[t] for t in terms]
        known = " AND ".join(f"c{i} IS NOT NULL" for i in sorted({*ids, index[response]}))
        fits.append(_Fitting(GlmFit(response, tuple(terms)), [f"c{i}" for i in ids], f"y{index[response]}", known))
    return wide, fits, centre, scale, index


def _summed(wide: DataFrame, sums: dict[tuple, str]) -> dict[tuple, float]:
    """All sums, a few hundred in a job."""
    keys, out = list(sums), {}
    for at in range(0, len(keys), BATCH_SUMS):
        row = wide.selectExpr(*[f"{sums[key]} AS s{i}" for i, key in enumerate(keys[at:at + BATCH_SUMS])]).first()
        out |= {key: row[i] for i, key in enumerate(keys[at:at + BATCH_SUMS])}
    return out


def _finish(fitting: _Fitting, centre: np.ndarray, scale: np.ndarray, index: dict[str, int]) -> GlmFit:
    """Estimates and errors of the columns as they were given."""
    fit, p = fitting.fit, fitting.size - 1
    if not fit.n or fitting.last is None:
        fit.coef = fit.errors = np.full(p + 1, np.nan)
        return fit
    ids = [index[t] for t in fit.terms]
    beta = fitting.beta if fit.converged else fitting.last
    kept = fitting.kept
    inverse = np.where(np.outer(kept, kept), np.linalg.inv(fitting.info), 0.0)
    back = np.eye(fitting.size)
    back[0, 1:] = -centre[ids] / scale[ids]
    back[np.arange(1, p + 1), np.arange(1, p + 1)] = 1 / scale[ids]
    fit.coef = np.where(kept, back @ np.where(kept, beta, 0.0), np.nan)
    fit.errors = np.where(kept, np.sqrt(np.diag(back @ inverse @ back.T)), np.nan)
    return fit


# --- Poisson -------------------------------------------------------------------

def poisson_many(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]]) -> list[GlmFit]:
    """Log-linear Poisson models (response, terms), all in one aggregate per step.

    Rows with a missing or negative response or a missing term leave their model; NaN and infinity count as
    missing.  Terms that others determine are dropped and have no estimate.  A model whose responses are all zero does not converge.
    """
    wide, fits, centre, scale, index = _prepared(df, specs)
    for f in fits:
        f.known += f" AND {f.response} >= 0"
    first = _summed(wide, {(k, what): f"{fn} FILTER (WHERE {f.known})" for k, f in enumerate(fits)
                           for what, fn in (("n", "count(*)"), ("mean", f"avg({f.response})"))})
    for k, f in enumerate(fits):
        f.fit.n = int(first[k, "n"])
        f.done = not first[k, "mean"]
        f.beta[0] = math.log(first[k, "mean"]) if first[k, "mean"] else 0.0
    for _ in range(STEPS):
        live = [(k, f) for k, f in enumerate(fits) if not f.done]
        if not live:
            break
        sums: dict[tuple, str] = {}
        means = wide.selectExpr("*", *[f"least({_eta(f.beta, f.columns)}, 700.0D) AS e{k}" for k, f in live])
        for k, f in live:
            over = f" FILTER (WHERE {f.known})"
            y = f.response
            sums[k, "value"] = f"sum(exp(e{k}) - {y} * e{k}){over}"
            for a in range(f.size):
                sums[k, a] = f"sum(({y} - exp(e{k})) * {f.columns[a]}){over}"
            for a, b in f.pairs(2):
                sums[k, a, b] = f"sum(exp(e{k}) * {f.columns[a]} * {f.columns[b]}){over}"
        found = _summed(means, sums)
        for k, f in live:
            f.moved(found[k, "value"], np.array([found[k, a] for a in range(f.size)]), f.spread({s: found[(k, *s)] for s in f.pairs(2)}))
            f.fit.deviance = f.best
    return [_finish(f, centre, scale, index) for f in fits]


# --- probit --------------------------------------------------------------------

def probit_many(df: DataFrame, specs: Sequence[tuple[str, Sequence[str]]]) -> list[GlmFit]:
    """Probit models (response of 0 and 1 or of a boolean, terms), all in one aggregate per step.

    A fit is *separated* when the values of a term for one outcome all lie on one side of those for the other (touching or not),
    when some step's linear predictor has the right sign for every row, or when the likelihood has not settled after all
    steps; then the penalised likelihood is maximised, whose estimates are finite.  Rows with a missing term or a response
    other than 0 and 1 leave their model; one outcome only is separated, too.
    """
    wide, fits, centre, scale, index = _prepared(df, specs)
    for f in fits:
        f.known += f" AND {f.response} IN (0.0D, 1.0D)"
    first = _summed(wide, {(k, c, y, fn): f"{fn}({c}) FILTER (WHERE {f.known} AND {f.response} = {y})"
                           for k, f in enumerate(fits) for c in f.columns for y in (0, 1) for fn in ("count", "min", "max")})
    for k, f in enumerate(fits):
        sizes = [int(first[k, "1.0D", y, "count"]) for y in (0, 1)]
        f.fit.n = sum(sizes)
        # Separated for sure: the steps of the plain likelihood are spared.
        f.done = not f.fit.n or 0 in sizes or any(
            first[k, c, a, "max"] <= first[k, c, 1 - a, "min"] and first[k, c, a, "min"] < first[k, c, 1 - a, "max"]
            for c in f.columns[1:] for a in (0, 1))
    for penalised in (False, True):
        for _ in range(STEPS):
            live = [(k, f) for k, f in enumerate(fits) if not f.done]
            if not live:
                break
            _probit_step(wide, live)
        for f in fits:
            if f.fit.n and not penalised and not f.fit.converged:
                f.fit.separated = f.penalised = True
                f.beta, f.last, f.best, f.kept, f.done = np.zeros(f.size), None, math.inf, None, False
    return [_finish(f, centre, scale, index) for f in fits]


def _probit_step(wide: DataFrame, live: list[tuple[int, _Fitting]]) -> None:
    rows = wide.selectExpr("*", *[f"greatest(least({_eta(f.beta, f.columns)}, {FAR}D), -{FAR}D) AS e{k}" for k, f in live])
    rows = rows.selectExpr("*", *[f"abs(e{k}) AS z{k}" for k, _ in live])
    # The tail over the density, and the density.
    rows = rows.selectExpr("*", *[f"{normal_tail(f'z{k}')} AS m{k}" for k, _ in live],
                           *[f"0.3989422804014327D * exp(-z{k} * z{k} / 2) AS d{k}" for k, _ in live])
    rows = rows.selectExpr("*", *[e for k, f in live for e in (
        f"CASE WHEN ({f.response} = 1) = (e{k} >= 0) THEN 1 - m{k} * d{k} ELSE m{k} * d{k} END AS p{k}",
        f"d{k} / (m{k} * (1 - m{k} * d{k})) AS w{k}")])
    sums: dict[tuple, str] = {}
    for k, f in live:
        over = f" FILTER (WHERE {f.known})"
        sign = f"(2 * {f.response} - 1)"
        score = f"({sign} * CASE WHEN {sign} * e{k} >= 0 THEN d{k} / p{k} ELSE 1 / m{k} END)"
        sums[k, "value"] = f"-sum(ln(p{k})){over}"
        sums[k, "least"] = f"min({sign} * e{k}){over}"
        # Slope of the weight: w (density over lower tail and over upper tail, less twice the predictor).
        slope = f"w{k} * sign(e{k}) * (1 / m{k} - d{k} / (1 - m{k} * d{k}) - 2 * z{k})"
        for a in range(f.size):
            sums[k, a] = f"sum({score} * {f.columns[a]}){over}"
        for a, b in f.pairs(2):
            sums[k, a, b] = f"sum(w{k} * {f.columns[a]} * {f.columns[b]}){over}"
        if f.penalised:
            for a, b, c in f.pairs(3):
                sums[k, a, b, c] = f"sum({slope} * {f.columns[a]} * {f.columns[b]} * {f.columns[c]}){over}"
    found = _summed(rows, sums)
    for k, f in live:
        score = np.array([found[k, a] for a in range(f.size)])
        info = f.spread({s: found[(k, *s)] for s in f.pairs(2)})
        value = found[k, "value"]
        if f.penalised:
            _, inverse, kept = solve_normal(info, score, 1e-10)
            third = f.spread({s: found[(k, *s)] for s in f.pairs(3)})
            score = score + 0.5 * np.einsum("jk,jkr->r", inverse, third)
            value -= 0.5 * np.linalg.slogdet(info[np.ix_(kept, kept)])[1]
        elif found[k, "least"] > 0:
            f.done = True
            continue
        f.moved(value, score, info)
        f.fit.deviance = 2 * f.best


# --- tables --------------------------------------------------------------------

def glm_table(df: DataFrame, fits: Sequence[GlmFit]) -> DataFrame:
    """One row per model and term; dropped terms have NULLs."""
    rows = []
    for fit in fits:
        for name, b, e in zip(["(Intercept)", *fit.terms], fit.coef, fit.errors):
            z = b / e if e else math.nan
            p = math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else None
            rows.append((fit.label, name, _null(b), _null(e), _null(z), p, fit.n, fit.converged, fit.separated))
    return df.sparkSession.createDataFrame(rows, TABLE)


def poisson_glm(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    return glm_table(df, poisson_many(df, [(response, terms)]))


def probit_glm(df: DataFrame, response: str, terms: Sequence[str]) -> DataFrame:
    return glm_table(df, probit_many(df, [(response, terms)]))
