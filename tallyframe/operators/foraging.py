"""Optimal-foraging tests per prey and per diet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import as_col, functional_response, safe_ln, unit_scale
from tallyframe.operators.composition import COUNT, GROUP, ITEM, MASS, with_totals
from tallyframe.operators.lookup import cross_candidates

CANDIDATE_H = (0.01, 0.02, 0.04, 0.08, 0.16)


def attack_rate(sum_r: Column | str, prey_per_pellet: Column | str, h: Column | float) -> Column:
    """-p / (p * sum_R * (h - 1)), kept only where p is known.

    p cancels, so the mean the reference puts in for a missing p never matters.
    """
    p, total = as_col(prey_per_pellet), as_col(sum_r)
    return F.when(p.isNotNull(), F.try_divide(F.lit(1.0), total * (1 - as_col(h))))


def diet_totals(items: DataFrame, meta: DataFrame, group: str = GROUP, count: str = COUNT,
                mass: str = MASS, prey_per_pellet: str = "PreyPerPellet") -> DataFrame:
    """Per diet: summed count, mean mass, number of prey, and p of the diet."""
    totals = items.groupBy(group).agg(
        F.sum(count).alias("diet_count"),
        F.count("*").alias("diet_prey"),
        (F.sum(F.col(count) * F.col(mass)) / F.nullif(F.sum(count), F.lit(0))).alias("diet_mass"))
    return totals.join(meta.select(group, F.col(prey_per_pellet).alias("diet_p")), group)


def intake_rate(totals: DataFrame, group: str = GROUP, meals: int = 1) -> DataFrame:
    """Mean prey mass times prey per pellet; NULL where p is unknown."""
    return totals.select(group, (meals * F.col("diet_mass") * F.col("diet_p")).alias("NE_intake"))


def discounted_intake(items: DataFrame, totals: DataFrame, group: str = GROUP, count: str = COUNT,
                      mass: str = MASS, meals: int = 1) -> DataFrame:
    """Intake of the diet without the contribution of the item, per item."""
    own = F.try_divide(F.col(count).cast("double"), F.col("diet_count")) * F.col(mass)
    return with_totals(items, totals, group).withColumn(
        "ne_disc", meals * (F.col("diet_mass") - own) * F.col("diet_p"))


def tested_rows(items: DataFrame, totals: DataFrame, group: str = GROUP, count: str = COUNT,
                mass: str = MASS, meals: int = 1, more_than: int = 20) -> DataFrame:
    """Rows that enter the test: enough prey, several prey types, p known."""
    enough = totals.filter(
        (F.col("diet_count") > more_than) & (F.col("diet_prey") > 1) & F.col("diet_p").isNotNull())
    return discounted_intake(items, enough, group, count, mass, meals)


def foraging_test(items: DataFrame, totals: DataFrame, hs: Sequence[float] = CANDIDATE_H,
                  group: str = GROUP, item: str = ITEM, count: str = COUNT, mass: str = MASS,
                  meals: int = 1, more_than: int = 20) -> DataFrame:
    """(diet, prey, h): return of the prey, discounted intake, difference, pass."""
    rows = tested_rows(items, totals, group, count, mass, meals, more_than).select(
        group, item, mass, "ne_disc")
    prey = F.col(mass) / F.col("cand_h")
    return cross_candidates(rows, hs).select(
        group, item, "cand_h", prey.alias("ne_prey"), "ne_disc",
        (prey - F.col("ne_disc")).alias("diff"),
        (prey > F.col("ne_disc")).alias("passes"))


def suboptimal_count(tests: DataFrame, group: str = GROUP) -> DataFrame:
    """Number of prey whose return lies below the discounted intake, per diet and h."""
    return tests.groupBy(group, "cand_h").agg(F.count_if(F.col("diff") < 0).alias("NumPos"))


def proportion_meeting_rule(items: DataFrame, totals: DataFrame, hs: Sequence[float] = CANDIDATE_H,
                            group: str = GROUP, count: str = COUNT, mass: str = MASS, meals: int = 1,
                            more_than: int = 20) -> DataFrame:
    """Passes over tests per candidate handling time.

    One conditional sum per candidate over the rows, then one row per
    candidate: the rows are not multiplied.
    """
    rows = tested_rows(items, totals, group, count, mass, meals, more_than)
    sums = rows.agg(F.count("*").alias("tests"), *[
        F.count_if(F.col(mass) / h > F.col("ne_disc")).alias(f"pass_{i}") for i, h in enumerate(hs)])
    pairs = F.array(*[
        F.struct(F.lit(float(h)).alias("cand_h"), F.col(f"pass_{i}").alias("passes"))
        for i, h in enumerate(hs)])
    return sums.select("tests", F.explode(pairs).alias("p")).select(
        "p.cand_h", F.try_divide(F.col("p.passes"), F.col("tests")).alias("prop_meeting_rule"))


def net_energy_points(tests: DataFrame, group: str = GROUP, item: str = ITEM) -> DataFrame:
    """The points behind the net-energy figure, logs NULL where undefined."""
    return tests.select(
        group, item, "cand_h", "ne_disc",
        safe_ln("ne_prey").alias("ln_prey"), safe_ln("ne_disc").alias("ln_disc"))


def response_curve(diets: DataFrame, group: str = GROUP, a: str = "baow_a", sum_r: str = "sum_R",
                   h: float = 0.02, points: int = 10) -> DataFrame:
    """Functional response of each diet on a grid from 0 to the largest sum_R."""
    used = diets.filter(F.col(a).isNotNull() & (F.col(sum_r) != 0))
    top = used.agg(F.max(sum_r)).scalar()
    grid = used.select(group, a, top.alias("_top"), F.explode(
        F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
    x = F.col("_top") * F.col("step") / (points - 1)
    return grid.select(group, "step", x.alias("x"), functional_response(x, a, h).alias("rate"))


def clearance_comparison(diets: DataFrame, published: DataFrame, predator_mass: float = 6e5,
                         a: str = "baow_a", factor: float = 1e5) -> DataFrame:
    """Own attack rates next to published ones, as labelled points."""
    own = diets.filter(F.col(a) != 0).select(
        F.lit("diets").alias("source"), F.lit(predator_mass).alias("mass"), unit_scale(a, factor).alias("rate"))
    other = published.select(
        F.lit("published").alias("source"), F.col("PredatorMass").alias("mass"), F.col("Fitted_a").alias("rate"))
    return own.unionByName(other)


def mean_clearance(diets: DataFrame, a: str = "baow_a", factor: float = 1e5) -> DataFrame:
    """Mean of the known attack rates on the published scale."""
    return diets.filter(F.col(a) != 0).agg(unit_scale(F.avg(a), factor).alias("mean_a"))
