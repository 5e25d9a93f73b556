"""Density allometry: fits per order, predictions and rank regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import as_col, safe_log10
from tallyframe.functions.stats import t_p_value
from tallyframe.operators.composition import GROUP, MASS
from tallyframe.operators.scan import HOT_ROWS, grouped_median
from tallyframe.operators.skew import sized_join


def log_observations(obs: DataFrame, mass: str = "BodyMass", density: str = "Density_km") -> DataFrame:
    """Observations with a mass, both sides on the log10 scale."""
    return obs.withColumns({
        "LogMass": safe_log10(mass), "LogDensity": safe_log10(density),
    }).filter("LogMass is not null and LogDensity is not null")


def allometry_simple(obs: DataFrame, response: str = "LogDensity", term: str = "LogMass") -> DataFrame:
    """One line through all observations."""
    return obs.agg(
        F.regr_slope(response, term).alias("slope"),
        F.regr_intercept(response, term).alias("intercept"),
        F.regr_r2(response, term).alias("r2"),
        F.regr_count(response, term).alias("n"))


def allometry_by_order(obs: DataFrame, level: str = "Order", response: str = "LogDensity",
                       term: str = "LogMass") -> DataFrame:
    """One line per level: the same fit as the full interaction with the level."""
    return obs.groupBy(level).agg(
        F.regr_slope(response, term).alias("slope"),
        F.regr_intercept(response, term).alias("intercept"),
        F.regr_count(response, term).alias("n"))


def allometry_r2(obs: DataFrame, level: str = "Order", response: str = "LogDensity",
                 term: str = "LogMass") -> DataFrame:
    """r2 of the interaction model: 1 - sum of the RSS per level / total SS.

    A level with one distinct mass has no slope; its mean takes the fit's place.
    """
    n, syy = F.col("n"), F.col("syy")
    explained = F.coalesce(F.col("sxy") * F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0)), F.lit(0.0))
    per_level = obs.groupBy(level).agg(
        F.count("*").alias("n"), F.avg(response).alias("mean"),
        F.regr_syy(response, term).alias("syy"), F.regr_sxx(response, term).alias("sxx"),
        F.regr_sxy(response, term).alias("sxy"))
    rss = F.sum(syy - explained)
    grand = F.sum(n * F.col("mean")) / F.sum(n)
    between = F.sum(n * F.col("mean") * F.col("mean")) - F.sum(n) * grand * grand
    return per_level.agg((1 - rss / (F.sum(syy) + between)).alias("r2"))


def predict_density(items: DataFrame, coefficients: DataFrame, item_level: str = "PreyOrder",
                    level: str = "Order", mass: str = MASS, base: str = "e") -> DataFrame:
    """Density of each item from the line of its order.

    The fit is on log10 but the reference goes back with exp: ``base='e'``.
    ``base='10'`` undoes the log10.  Items of an order without a line drop out.
    """
    if base not in ("e", "10"):
        raise ValueError("base must be 'e' or '10'")
    lines = coefficients.filter("slope is not null").select(
        F.col(level).alias(item_level), F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    log_density = F.col("_intercept") + F.col("_slope") * F.col("LogMass")
    density = F.exp("LogDensity") if base == "e" else F.pow(F.lit(10.0), F.col("LogDensity"))
    return (
        sized_join(items.withColumn("LogMass", safe_log10(mass)), lines, [item_level])
        .withColumn("LogDensity", log_density).withColumn("Density", density)
        .drop("_slope", "_intercept")
    )


def long_draws(draws: DataFrame, levels: Sequence[int], draw: str = "draw") -> DataFrame:
    """Wide posterior draws to (draw, k, intercept, slope)."""
    return draws.select(draw, F.explode(F.array(*[
        F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"Intercept{k}").alias("intercept"),
                 F.col(f"orders{k}").alias("slope")) for k in levels
    ])).alias("d")).select(draw, "d.*")


def median_by_level(draws: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median slope and intercept per level."""
    slope = grouped_median(draws, ["k"], "slope", "slope", hot_rows)
    intercept = grouped_median(draws, ["k"], "intercept", "intercept", hot_rows)
    return slope.join(intercept, "k")


def posterior_density(items: DataFrame, draws: DataFrame, keys: Sequence[str], code: str = "group_idx",
                      log_mass: str = "LogMass") -> DataFrame:
    """exp(intercept + slope * LogMass) per item and draw, in long form."""
    return sized_join(items.select(*keys, F.col(code).alias("k"), log_mass), draws, ["k"]).select(
        *keys, "draw", F.exp(F.col("intercept") + F.col("slope") * F.col(log_mass)).alias("density"))


CHUNK_DRAWS = 4096


def posterior_summary(items: DataFrame, draws: DataFrame, keys: Sequence[str], code: str = "group_idx",
                      log_mass: str = "LogMass", chunk_draws: int = CHUNK_DRAWS) -> DataFrame:
    """Per item the draws' density: draws, mean, sd, log_mean, log_sd, least, most; nothing is made per item and draw.

    Draws are packed in chunks of about ``chunk_draws`` per level.  Every different mass of a level meets every chunk
    once and sums over it; the sums are taken around the level's mean line, so they keep their digits, and add up exactly
    over chunks.  Items with the same level and mass share a result.  Draws with a missing line are left out; an item without a
    mass, or of a level without draws, has no draws and NULLs; sd needs two draws.
    """
    known = draws.select("k", "intercept", "slope").na.drop()
    middle = known.groupBy("k").agg(F.avg("intercept").alias("i0"), F.avg("slope").alias("s0"), F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("intercept", "slope"), F.ceil(F.col("n") / chunk_draws))
    packed = sized_join(known, middle, ["k"]).groupBy("k", "i0", "s0", chunk.alias("chunk")).agg(
        F.collect_list(F.struct("intercept", "slope")).alias("lines"))
    items = items.select(*keys, F.col(code).cast("bigint").alias("k"), F.col(log_mass).alias("x"))
    rows = sized_join(items.select("k", "x").na.drop().distinct(), packed, ["k"])
    l0 = F.col("i0") + F.col("s0") * F.col("x")
    rows = rows.select("k", "x", l0.alias("l0"), F.exp(l0).alias("v0"),
                       F.transform("lines", lambda line: line["intercept"] + line["slope"] * F.col("x")).alias("logs"))
    total = lambda values, of: F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))
    parts = rows.select(
        "k", "x", "l0", "v0", F.size("logs").alias("n"), F.array_min("logs").alias("low"), F.array_max("logs").alias("high"),
        total("logs", lambda v: v - F.col("l0")).alias("l1"), total("logs", lambda v: (v - F.col("l0")) ** 2).alias("l2"),
        total("logs", lambda v: F.exp(v) - F.col("v0")).alias("v1"), total("logs", lambda v: (F.exp(v) - F.col("v0")) ** 2).alias("v2"))
    sums = parts.groupBy("k", "x", "l0", "v0").agg(
        F.sum("n").alias("draws"), *[F.sum(c).alias(c) for c in ("l1", "l2", "v1", "v2")], F.min("low").alias("low"), F.max("high").alias("high"))
    spread = lambda c: F.when(F.col("draws") > 1, F.sqrt(F.greatest(
        F.lit(0.0), F.col(f"{c}2") - F.col(f"{c}1") ** 2 / F.col("draws")) / (F.col("draws") - 1)))
    summary = sums.select("k", "x", "draws", (F.col("v0") + F.col("v1") / F.col("draws")).alias("mean"), spread("v").alias("sd"),
                          (F.col("l0") + F.col("l1") / F.col("draws")).alias("log_mean"), spread("l").alias("log_sd"),
                          F.exp("low").alias("least"), F.exp("high").alias("most"))
    return sized_join(items, summary, ["k", "x"], "left").select(
        *keys, F.coalesce("draws", F.lit(0)).alias("draws"), "mean", "sd", "log_mean", "log_sd", "least", "most")


def posterior_point(items: DataFrame, medians: DataFrame, keys: Sequence[str], code: str = "group_idx",
                    log_mass: str = "LogMass") -> DataFrame:
    """The point estimate from the median slope and intercept of each level."""
    return sized_join(items.select(*keys, F.col(code).alias("k"), log_mass), medians, ["k"]).select(
        *keys, F.exp(F.col("intercept") + F.col("slope") * F.col(log_mass)).alias("density"))


def slope_p_value(r: Column | str, n: Column | str) -> Column:
    """p-value of a simple regression slope from its correlation and size."""
    r, n = as_col(r), as_col(n)
    t = F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    return t_p_value(t, n - 2)


def rank_regression(ranked: DataFrame, group: str = GROUP, response: str = "CountRank",
                    term: str = "DensRank") -> DataFrame:
    """Slope of the rank line per group with its p-value.

    Both ranks are permutations of 1..n, so the slope is their correlation.
    """
    fit = ranked.groupBy(group).agg(
        F.regr_slope(response, term).alias("dens_slopes"),
        F.regr_intercept(response, term).alias("intercept"),
        F.count("*").alias("n"))
    return fit.withColumn("pval_dens", slope_p_value(F.round("dens_slopes", 12), "n"))


def rank_line(ranked: DataFrame, fit: DataFrame, group: str = GROUP, term: str = "DensRank") -> DataFrame:
    """The fitted line at every rank.

    The ranks of a group are exactly 1..n, so its own rows are the grid.
    """
    return sized_join(ranked.select(group, term), fit, [group]).select(
        group, term, (F.col("intercept") + F.col("dens_slopes") * F.col(term)).alias("fitted"))


