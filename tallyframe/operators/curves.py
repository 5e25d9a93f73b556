"""Exponential decline of frequency with rank (net specialisation)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.composition import COUNT, GROUP, ranked_spectrum
from tallyframe.session import spread

def power_sums(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over j = 0..m-1 of q^j and j q^j, for arrays of (q, m).

    Built from the binary digits of m by joining two runs, so a block of equal
    counts costs log2(m) steps; every summand is positive, nothing cancels.
    """
    q = np.asarray(q, dtype=float)
    left = np.asarray(m, dtype=np.int64).copy()
    s0 = s1 = np.zeros_like(q)
    done, done_power = np.zeros_like(q), np.ones_like(q)
    r0, r1 = np.ones_like(q), np.zeros_like(q)
    length, power = 1.0, q.copy()
    while left.any():
        take = (left & 1).astype(bool)
        # Append the run (r0, r1) of this length behind what is done.
        s1 = np.where(take, s1 + done_power * (r1 + done * r0), s1)
        s0 = np.where(take, s0 + done_power * r0, s0)
        done = np.where(take, done + length, done)
        done_power = np.where(take, done_power * power, done_power)
        r1 = r1 + power * (r1 + length * r0)
        r0 = r0 + power * r0
        length, power = length * 2, power * power
        left >>= 1
    return s0, s1


class _Blocks:
    """Spectrum blocks of many groups side by side; sums are per group."""

    def __init__(self, first: np.ndarray, size: np.ndarray, f: np.ndarray, starts: np.ndarray):
        self.first, self.size, self.f, self.starts = first, size, f, starts
        self.lengths = np.diff(np.append(starts, len(first)))

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def moments(self, b: np.ndarray) -> dict[str, np.ndarray]:
        """Sums of e and re over exp(2br), and of f-weighted ones over exp(br); r counts from 0."""
        rate = np.repeat(b, self.lengths)
        out = {}
        for tag, factor, weight in (("", 2.0, 1.0), ("f", 1.0, self.f)):
            s0, s1 = power_sums(np.exp(factor * rate), self.size)
            lead = np.exp(factor * rate * self.first) * weight
            out[f"{tag}0"] = self.total(lead * s0)
            out[f"{tag}1"] = self.total(lead * (s1 + self.first * s0))
        return out


def fit_exponentials(blocks: _Blocks, grid: int = 48, halvings: int = 70):
    """Least squares of f = a exp(b rank), all groups at once: (a, b, residual sum of squares, converged).

    For a given b the best a is known, and what is left to explain grows with b as
    long as the mean rank under weights f exp(br) is above the one under exp(2br).
    Frequencies fall with rank, so b lies between 0 and a bound from the first two of
    them.  A grid finds the best stretch, halving finds b in it; the number of steps
    is fixed and every group with two positive frequencies has a result.
    """
    second = np.where(blocks.size[blocks.starts] > 1, blocks.f[blocks.starts],
                      blocks.f[np.minimum(blocks.starts + 1, len(blocks.f) - 1)])
    found = second > 0
    low = np.log(np.where(found, second / blocks.f[blocks.starts], 1.0)) - 1

    def explained(m):
        return m["f0"] ** 2 / m["0"]

    def above(m):
        return m["f1"] * m["0"] > m["f0"] * m["1"]

    points = np.append(np.geomspace(1.0, 1e-9, grid - 1), 0.0)
    gain = np.array([explained(blocks.moments(low * t)) for t in points])
    best = gain.argmax(axis=0)
    left, right = low * points[np.maximum(best - 1, 0)], low * points[np.minimum(best + 1, grid - 1)]
    for _ in range(halvings):
        b = (left + right) / 2
        go_right = above(blocks.moments(b))
        left, right = np.where(go_right, b, left), np.where(go_right, right, b)
    b = (left + right) / 2
    b = np.where(explained(blocks.moments(b)) >= gain.max(axis=0) * (1 - 1e-15), b, low * points[best])
    b = np.where(np.minimum.reduceat(blocks.f, blocks.starts) == blocks.f[blocks.starts], 0.0, b)
    m = blocks.moments(b)
    a = m["f0"] / m["0"] * np.exp(-b)
    rss = blocks.total(blocks.size * blocks.f**2) - explained(m)
    return a, b, np.maximum(rss, 0.0), found


def _whole_groups(batches: Iterator[pd.DataFrame], group: str) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group is cut between two of them."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        open_from = (batch[group] == batch[group].iloc[-1]).to_numpy().argmax()
        if open_from:
            yield batch.iloc[:open_from].reset_index(drop=True)
        rest = batch.iloc[open_from:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def exp_fit(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    """Net specialisation, intercept and r2 per group of more than two items.

    The fit reads the spectrum (at most sqrt(2N) rows per group).  A group with
    two items or fewer has NULLs, as has one with a single positive count, whose
    best curve is infinitely steep; ``converged`` is true for all others.
    """
    fitted = exp_fit_from(ranked_spectrum(items, group, count), group, count)
    return items.select(group).distinct().join(fitted, group, "left")


def exp_fit_from(blocks: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    """The fits of the groups that have one, from a ranked spectrum."""
    blocks = blocks.select(group, count, "n_items", "items_before", "n", "total").filter(
        (F.col("n") > 2) & (F.col("total") > 0))
    fields = T.StructType([
        T.StructField(group, blocks.schema[group].dataType),
        T.StructField("specialization", T.DoubleType()), T.StructField("y_intercept", T.DoubleType()),
        T.StructField("rsquare", T.DoubleType()), T.StructField("converged", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, group):
            starts = np.flatnonzero((frame[group] != frame[group].shift()).to_numpy())
            size = frame["n_items"].to_numpy(np.int64)
            f = (frame[count] / frame["total"]).to_numpy(float)
            a, b, rss, ok = fit_exponentials(
                _Blocks(frame["items_before"].to_numpy(float), size, f, starts))
            mean = np.add.reduceat(size * f, starts) / np.add.reduceat(size, starts)
            around = f - np.repeat(mean, np.diff(np.append(starts, len(f))))
            tss = np.add.reduceat(size * around**2, starts)
            with np.errstate(all="ignore"):
                rsquare = np.where(ok & (tss > 0), 1 - rss / tss, np.nan)
            out = pd.DataFrame({
                group: frame[group].iloc[starts].to_numpy(),
                "specialization": np.where(ok, b, np.nan), "y_intercept": np.where(ok, a, np.nan),
                "rsquare": rsquare})
            yield out.assign(converged=ok)

    fitted = spread(blocks, group).sortWithinPartitions(group, F.desc(count)).mapInPandas(run, fields)
    return fitted.select(group, *[
        F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("specialization", "y_intercept", "rsquare")
    ], "converged")


def exp_curve(fits: DataFrame, group: str = GROUP, last: float = 30.0, step: float = 0.1) -> DataFrame:
    """The fitted curve of each group on x = 1, 1 + step, ..., last."""
    points = round((last - 1) / step)
    grid = fits.filter(F.col("specialization").isNotNull()).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.lit(points))))
    x = 1 + F.col("at") * step
    return grid.select(group, x.alias("x"), (F.col("y_intercept") * F.exp(F.col("specialization") * x)).alias("y"))
