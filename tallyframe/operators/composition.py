"""Per-group metrics of a composition table.

Most metrics are plain sums.  Those that look at the order of the counts
(sp50, Gini, the rank curve, rarefaction) read the *abundance spectrum*: one
row per (group, distinct count) with the number of items that have this count.
k distinct positive counts add up to at least k(k+1)/2, so a group of N
individuals has at most sqrt(2N) spectrum rows however many items it has.  The
spectrum is built with map-side combine and is small enough for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import x_ln_x
from tallyframe.operators.scan import Scan, group_totals, ordered_scan
from tallyframe.operators.skew import sized_join
from tallyframe.session import cut_lineage

GROUP, ITEM, COUNT, MASS = "DataSet", "PreyScientificName", "CountInt", "PreyMass"


# --- building blocks -------------------------------------------------------

def spectrum(items: DataFrame, group: str = GROUP, count: str = COUNT, *aggs: Column) -> DataFrame:
    """(group, count) -> number of items with that count, plus further sums.

    Items of unknown count form a block of their own with a NULL count.
    """
    return items.groupBy(group, count).agg(F.count("*").alias("n_items"), *aggs)


def ranked_spectrum(items: DataFrame, group: str = GROUP, count: str = COUNT, *aggs: Column) -> DataFrame:
    """The spectrum with what lies before each block in descending count order.

    ``items_before``/``count_before`` exclude the block; ``n``/``total`` are
    the sums over the known counts of the group, ``unknown`` the number of items
    whose count is not known.
    """
    every = Window.partitionBy(group)
    before = every.orderBy(F.desc_nulls_last(count)).rowsBetween(Window.unboundedPreceding, -1)
    block = F.col(count) * F.col("n_items")
    known = F.col(count).isNotNull()
    ranked = spectrum(items, group, count, *aggs).withColumns({
        "items_before": F.coalesce(F.sum("n_items").over(before), F.lit(0)),
        "count_before": F.coalesce(F.sum(block).over(before), F.lit(0)),
        "n": F.sum(F.when(known, F.col("n_items")).otherwise(0)).over(every),
        "unknown": F.sum(F.when(known, 0).otherwise(F.col("n_items"))).over(every),
        "total": F.sum(block).over(every),
    })
    return ranked.filter(known)


def with_totals(items: DataFrame, totals: DataFrame, group: str = GROUP) -> DataFrame:
    """Join per-group sums back to the rows."""
    return sized_join(items, totals, [group])


# --- simple aggregates ------------------------------------------------------

def group_sum(items: DataFrame, keys: Sequence[str], count: str = COUNT, out: str = "TotalSum") -> DataFrame:
    return items.groupBy(*keys).agg(F.sum(count).alias(out))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out or f"{value}_mean"))


def group_count_valid(df: DataFrame, keys: Sequence[str], value: str, out: str = "num_records") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias(out))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of distinct values of each column.

    One column at a time is counted from its distinct pairs (name, value), so
    the work is a hash aggregate and not one large expand per row.
    """
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")).select("p.*").filter("value is not null").distinct()
    return pairs.groupBy().agg(*[
        F.count_if(F.col("name") == c).alias(f"n_{c}") for c in columns])


def share_of_total(items: DataFrame, key: str, count: str = COUNT) -> DataFrame:
    """Category totals and their share of the grand total."""
    sums = items.groupBy(key).agg(F.sum(count).alias("TotalSum"))
    grand = sums.agg(F.sum("TotalSum")).scalar()
    return sums.withColumn("share", F.col("TotalSum") / grand)


def global_summary(meta: DataFrame, num_obs: str = "Num_obs", limit: int = 20) -> DataFrame:
    """Row count, largest id, extremes of the observations, diets over the limit."""
    return meta.agg(
        F.count("*").alias("rows"),
        F.max(GROUP).alias("max_id"),
        F.min(num_obs).alias("min_obs"),
        F.max(num_obs).alias("max_obs"),
        F.sum(num_obs).alias("total_obs"),
        F.count_if(F.col(num_obs) > limit).alias("over_limit"),
    )


def _share(condition: Column, count: str = COUNT) -> Column:
    part = F.sum(F.when(condition, F.col(count)).otherwise(0))
    return F.try_divide(part.cast("double"), F.sum(count))


def class_fractions(items: DataFrame, classes: dict[str, str], group: str = GROUP,
                    column: str = "PreyClass", count: str = COUNT) -> DataFrame:
    """Share of each diet in the given classes; ``classes`` maps output -> class."""
    return items.groupBy(group).agg(*[
        _share(F.col(column) == value, count).alias(out) for out, value in classes.items()])


def bird_fraction(items: DataFrame, meta: DataFrame, group: str = GROUP, count: str = COUNT,
                  value: str = "Aves", out: str = "FreqBirds") -> DataFrame:
    """Share of one class for every diet of the meta table, 0 when it has none."""
    shares = class_fractions(items, {out: value}, group, count=count)
    return meta.select(group).join(shares, group, "left").select(
        group, F.coalesce(out, F.lit(0.0)).alias(out))


def unidentified_fraction(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                          labels: dict[str, str] | None = None) -> DataFrame:
    """Share of rows named exactly like a class; 0 when there are none."""
    labels = labels or {"funidBird": "Aves", "funidMamm": "Mammalia"}
    return items.groupBy(group).agg(*[
        F.coalesce(_share(F.col(item) == name, count), F.lit(0.0)).alias(out)
        for out, name in labels.items()])


def frequencies(items: DataFrame, group: str = GROUP, count: str = COUNT,
                out: str = "Frequencies") -> DataFrame:
    """Item count over the total of its group; rows without a group are left out."""
    return group_totals(items, [group], {"_total": count}).withColumn(
        out, F.try_divide(F.col(count).cast("double"), F.col("_total"))).drop("_total")


def group_share(items: DataFrame, columns: dict[str, str], group: str = GROUP) -> DataFrame:
    """Each value over the group sum of its column; ``columns`` maps output -> column.  Rows without a group are left out."""
    sums = {f"_sum_{out}": c for out, c in columns.items()}
    shares = {out: F.try_divide(F.col(c).cast("double"), F.col(f"_sum_{out}"))
              for out, c in columns.items()}
    return group_totals(items, [group], sums).withColumns(shares).drop(*sums)


def richness(items: DataFrame, group: str = GROUP) -> DataFrame:
    """Number of item rows."""
    return items.groupBy(group).agg(F.count("*").alias("richness"))


def prey_total(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    return items.groupBy(group).agg(F.sum(count).alias("numb_prey"))


def entropy_of(count: str = COUNT) -> Column:
    """Shannon entropy as one aggregate: ln N - sum(c ln c) / N, 0 counts add 0."""
    total = F.sum(count).cast("double")
    return F.when(total > 0, F.ln(total) - F.sum(x_ln_x(F.col(count).cast("double"))) / total)


def shannon_entropy(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    return items.groupBy(group).agg(entropy_of(count).alias("entropy"))


def top_frequency(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    return items.groupBy(group).agg(
        F.try_divide(F.max(count).cast("double"), F.sum(count)).alias("top_frequency"))


def top_item_sums(item: str = ITEM, mass: str = MASS, level: str = "IDLevel") -> list[Column]:
    """What a spectrum must carry for ``top_items_from``."""
    return [F.sum(mass).alias("mass_sum"), F.count(mass).alias("mass_n"), F.min_by(level, item).alias("level")]


def top_items_from(blocks: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    top = blocks.groupBy(group).agg(
        F.max_by(F.struct("mass_sum", "mass_n", "level"), count).alias("top"))
    return top.select(
        group,
        F.try_divide("top.mass_sum", "top.mass_n").alias("top_item_mass"),
        F.col("top.level").alias("top_item_id_level"),
    )


def top_items(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
              mass: str = MASS, level: str = "IDLevel") -> DataFrame:
    """Mean known mass over all items tied at the top, and the id level of the
    first of them by name."""
    return top_items_from(spectrum(items, group, count, *top_item_sums(item, mass, level)), group, count)


def mass_range(items: DataFrame, group: str = GROUP, mass: str = MASS) -> DataFrame:
    return items.groupBy(group).agg(
        F.min(mass).alias("min_mass"), F.max(mass).alias("max_mass"),
        (F.max(mass) - F.min(mass)).alias("mass_range"))


def lognormal_params(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    """Mean and sample sd of ln(frequency) for groups of more than two items."""
    ln_count = F.when(F.col(count) > 0, F.ln(F.col(count).cast("double")))
    enough = F.count("*") > 2
    return items.groupBy(group).agg(
        F.when(enough, F.avg(ln_count) - F.ln(F.nullif(F.sum(count), F.lit(0)).cast("double"))).alias("ln_mean"),
        F.when(enough, F.stddev_samp(ln_count)).alias("ln_sd"))


def weighted_mean_mass(items: DataFrame, group: str = GROUP, count: str = COUNT, mass: str = MASS) -> DataFrame:
    """Mean mass weighted by count, over the items whose mass is known."""
    counted = F.when(F.col(mass).isNotNull(), F.col(count))
    return items.groupBy(group).agg(
        F.try_divide(F.sum(F.col(count) * F.col(mass)), F.sum(counted)).alias("mean_mass"))


def total_density(items: DataFrame, group: str = GROUP, density: str = "Density") -> DataFrame:
    return items.groupBy(group).agg(F.sum(density).alias("sum_R"))


def count_positive_share(df: DataFrame, column: str) -> DataFrame:
    """Fraction of the non-null values that are above zero."""
    return df.filter(F.col(column).isNotNull()).agg(
        F.avg(F.when(F.col(column) > 0, 1.0).otherwise(0.0)).alias("share_positive"))


def handling_time_lower_bound(meta: DataFrame, prey_per_pellet: str = "PreyPerPellet") -> DataFrame:
    return meta.agg((1 / F.avg(prey_per_pellet) / 3).alias("h_lower_bound"))


# --- metrics over the spectrum ----------------------------------------------

def sp50(items: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    """Rank at which the cumulative frequency reaches one half.

    Inside a block of equal counts the cumulative share is a straight line, so
    the crossing follows from the block alone.  1 when the first item holds
    half or when there are two items or fewer.
    """
    return sp50_from(ranked_spectrum(items, group, count), group, count)


def sp50_from(blocks: DataFrame, group: str = GROUP, count: str = COUNT) -> DataFrame:
    crosses = (2 * F.col("count_before") <= F.col("total")) & (
        2 * (F.col("count_before") + F.col(count) * F.col("n_items")) > F.col("total"))
    rank = F.col("items_before") + (F.col("total") / 2 - F.col("count_before")) / F.col(count)
    return blocks.groupBy(group).agg(
        F.when(F.max("n") <= 2, 1.0)
        .when(2 * F.max(count) >= F.max("total"), 1.0)
        .otherwise(F.max(F.when(crosses, rank))).alias("sp50"))


def gini(items: DataFrame, group: str = GROUP, count: str = COUNT, population: str = "rank") -> DataFrame:
    """Gini coefficient by the trapezoids of a Lorenz curve.

    ``population='rank'`` weights each item by its rank in descending order of
    counts, ``'one'`` counts every item once.  Items of equal count lie on one
    straight piece of the curve, so one trapezoid per block is exact.  The
    function used by the reference is not shipped with it; this is the usual
    population-weighted form, and equality cannot be checked.
    """
    return gini_from(ranked_spectrum(items, group, count), group, count, population)


def gini_from(blocks: DataFrame, group: str = GROUP, count: str = COUNT, population: str = "rank") -> DataFrame:
    if population not in ("rank", "one"):
        raise ValueError("population must be 'rank' or 'one'")
    n = F.col("n_items").cast("double")
    weight = n * F.col("items_before") + n * (n + 1) / 2 if population == "rank" else n
    blocks = blocks.select(group, count, weight.alias("weight"),
                           (weight * F.col(count)).alias("value"))
    upto = Window.partitionBy(group).orderBy(count).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    curve = blocks.select(group, "weight", "value", F.sum("value").over(upto).alias("height"))
    area = F.sum((2 * F.col("height") - F.col("value")) * F.col("weight"))
    return curve.groupBy(group).agg(
        (1 - F.try_divide(area, F.sum("value") * F.sum("weight"))).alias("gini"))


def size_selectivity(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                     mass: str = MASS, min_items: int = 6) -> DataFrame:
    """Deviation of the observed shares from shares inverse to mass.

    Over the items with a mass, and only for groups with at least
    ``min_items`` of them.
    """
    known = items.filter(F.col(mass).isNotNull())
    totals = known.groupBy(group).agg(
        F.sum(1 / F.col(mass)).alias("_inv"), F.sum(count).alias("_total"),
        F.count("*").alias("_n")).filter(F.col("_n") >= min_items)
    excess = 1 / F.col(mass) / F.col("_inv") - F.try_divide(F.col(count).cast("double"), F.col("_total"))
    rows = with_totals(known, totals, group).withColumn("_excess", excess)
    # Largest excess first, equal ones by name: min over (-excess, name).
    result = rows.groupBy(group).agg(
        F.sum(F.abs("_excess")).alias("summed_deviance"),
        F.min_by(mass, F.struct(-F.round("_excess", 12), F.col(item))).alias("max_overselected_size"))
    return items.select(group).distinct().join(result, group, "left")


# --- the largest, smallest and commonest item -------------------------------

def extreme_item_frequency(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                           mass: str = MASS) -> DataFrame:
    """Observed frequency of the largest and of the smallest item, first by name on ties."""
    total = F.sum(count)
    share = lambda c: F.try_divide(c.cast("double"), total)
    massed = F.when(F.col(mass).isNotNull(), F.struct(F.col(mass), F.col(item)))
    largest = F.when(F.col(mass).isNotNull(), F.struct((-F.col(mass)).alias("m"), F.col(item)))
    return items.groupBy(group).agg(
        share(F.min_by(count, largest)).alias("obs_largest_prey_freq"),
        share(F.min_by(count, massed)).alias("obs_smallest_prey_freq"))


def predicted_largest_frequency(items: DataFrame, group: str = GROUP, item: str = ITEM,
                                mass: str = MASS, density: str = "Density") -> DataFrame:
    """Expected share of the largest item among lighter ones by density alone.

    The smallest item gets the same number in the reference.
    """
    by_mass = items.filter(F.col(mass).isNotNull()).groupBy(group, mass).agg(
        F.sum(density).alias("density"), F.min_by(density, item).alias("own"))
    top = by_mass.groupBy(group).agg(
        F.sum("density").alias("all"),
        F.max_by(F.struct("density", "own"), mass).alias("top"))
    phi = F.try_divide(F.col("all") - F.col("top.density"), F.col("top.own"))
    return top.select(group, (1 / (1 + phi)).alias("pred_largest_prey_freq"))


def extreme_masses(items: DataFrame, group: str = GROUP, mass: str = MASS) -> DataFrame:
    return items.groupBy(group).agg(
        F.max(mass).alias("largest_prey_mass"), F.min(mass).alias("smallest_prey_mass"))


def mass_of_most_common(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                        mass: str = MASS, density: str = "Density") -> DataFrame:
    """Mass of the item with the highest count rank (count, then density, then name)."""
    return items.groupBy(group).agg(
        F.max_by(mass, F.struct(count, density, item)).alias("mass_of_most_common"))


def top_item_flags(items: DataFrame, group: str = GROUP, count: str = COUNT, mass: str = MASS,
                   density: str = "Density") -> DataFrame:
    """Are the most common items exactly the biggest ones, the densest ones?

    Two tied sets are equal when every row of the first has the top value of
    the second and both have the same size; that needs sums per distinct
    count, mass and density, and no join back to the rows.
    """
    by_count = items.groupBy(group, count).agg(
        F.count("*").alias("n"),
        F.min(mass).alias("lo_mass"), F.min(density).alias("lo_density"),
        F.count(mass).alias("n_mass"), F.count(density).alias("n_density"))
    commonest = by_count.groupBy(group).agg(F.max_by(F.struct(
        "n", "lo_mass", "lo_density", "n_mass", "n_density"), count).alias("c"))

    def top(column: str, out: str) -> DataFrame:
        sizes = items.filter(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
        return sizes.groupBy(group).agg(F.max(column).alias(out), F.max_by("n", column).alias(f"n_{out}"))

    joined = commonest.join(top(mass, "top_mass"), group, "left").join(
        top(density, "top_density"), group, "left")

    def same(kind: str) -> Column:
        return F.coalesce(
            (F.col(f"c.lo_{kind}") == F.col(f"top_{kind}"))
            & (F.col(f"c.n_{kind}") == F.col("c.n"))
            & (F.col("c.n") == F.col(f"n_top_{kind}")), F.lit(False)).cast("int")

    return joined.select(
        group, same("mass").alias("IsTopPreyBiggest"), same("density").alias("IsTopPreyMostDense"))


# --- presence ---------------------------------------------------------------

def diets_per_category(items: DataFrame, category: str, group: str = GROUP) -> DataFrame:
    """In how many groups does each category occur."""
    return items.filter(F.col(category).isNotNull()).select(group, category).distinct().groupBy(
        category).agg(F.count("*").alias("Diets"))


def presence_matrix(items: DataFrame, category: str, values: Sequence[str], group: str = GROUP) -> DataFrame:
    """One 0/1 column per category value, as many columns as values given."""
    return items.groupBy(group).agg(*[
        F.max(F.when(F.col(category) == v, 1).otherwise(0)).alias(str(v)) for v in values])


# --- correlation -------------------------------------------------------------

def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """Correlation of two columns over rows where both are known."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    if method == "spearman":
        both = cut_lineage(both)
        both = sized_join(both, _average_ranks(both, a, "_ra"), [a])
        both = sized_join(both, _average_ranks(both, b, "_rb"), [b])
        return both.agg(F.corr("_ra", "_rb").alias("correlation"))
    return both.agg(F.corr(a, b).alias("correlation"))


def _average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct value -> mean rank of its rows."""
    sizes = df.groupBy(column).agg(F.count("*").alias("_n"))
    upto = ordered_scan(sizes, [], [Scan([column], running={"_upto": "_n"})])
    return upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """Equal-width bins over min..max, empty ones too; the maximum falls into the last bin.

    Equal values all fall into bin 0; a column without values has no bins.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    placed = values.select("x", ends.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = placed.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ends.alias("e")).filter("e.lo is not null")
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("e.lo") + F.col("bin") * width).alias("left"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
