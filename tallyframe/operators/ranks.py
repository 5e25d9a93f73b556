"""Rank-abundance curves, running shares and rank triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.composition import COUNT, GROUP, ITEM, MASS, group_share
from tallyframe.operators.scan import HOT_ROWS, Scan, ordered_scan


def rank_abundance(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank 1..n by descending count with frequency and running count; rows without a group are left out.

    Rank, running count and total come from one reading and one sort.
    """
    scan = Scan([f"-{count}", item], rank="rank", running={"running_count": count})
    ranked = ordered_scan(items, [group], [scan], hot_rows, totals={"_total": count}, named_only=True)
    total = F.col("_total")
    return ranked.withColumns({
        "frequency": F.try_divide(F.col(count).cast("double"), total),
        "cumulative": F.try_divide(F.col("running_count").cast("double"), total),
    }).drop("_total")


def cumulative_share(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                     by: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running share of the group total, in rank order or in name order; rows without a group are left out."""
    order = [f"-{count}", item] if by == "rank" else [item]
    summed = ordered_scan(items, [group], [Scan(order, running={"_running": count})], hot_rows,
                          totals={"_total": count}, named_only=True)
    return summed.withColumn(
        "cumulative", F.try_divide(F.col("_running").cast("double"), F.col("_total"))
    ).drop("_running", "_total")


def first_crossing(cumulative: DataFrame, u: float | Column, group: str = GROUP, item: str = ITEM,
                   share: str = "cumulative") -> DataFrame:
    """First item whose cumulative share exceeds ``u``."""
    threshold = u if isinstance(u, Column) else F.lit(float(u))
    # Equal shares only occur behind zero counts, which are never drawn.
    return cumulative.filter(F.col(share) > threshold).groupBy(group).agg(
        F.min_by(item, F.struct(share, item)).alias("crossing_item"),
        F.min(share).alias("crossing_share"))


def rank_triplet(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                 mass: str = MASS, density: str = "Density", hot_rows: int = HOT_ROWS) -> DataFrame:
    """DensRank, CountRank and MassRank, ascending and unique within the group.

    Each sort keeps the order of the one before it on ties, so equal counts go
    by density and equal masses by count.  Densities are compared by their logarithm
    to nine decimals, so that ranks do not hang on the last bits, however small the
    densities are.
    """
    level = F.when(F.col(density) > 0, F.round(F.log(density), 9)).when(F.col(density).isNotNull(), F.lit(float("-inf")))
    return ordered_scan(items.withColumn("_level", level), [group], [
        Scan(["_level", item], rank="DensRank"),
        Scan([count, "_level", item], rank="CountRank"),
        Scan([mass, count, "_level", item], rank="MassRank"),
    ], hot_rows).drop("_level")


def diet_shares(items: DataFrame, group: str = GROUP, count: str = COUNT,
                density: str = "Density") -> DataFrame:
    """Frequency and relative density of each item."""
    return group_share(items, {"Frequencies": count, "Rel_density": density}, group)


def frequency_gap(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                  mass: str = MASS, density: str = "Density") -> DataFrame:
    """Observed minus expected share of each item, with its mass."""
    return diet_shares(items, group, count, density).select(
        group, item, mass, (F.col("Frequencies") - F.col("Rel_density")).alias("gap"))
