"""The end products: one table per diet or per item, put together from operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import normalise_name, safe_ln
from tallyframe.operators import composition as comp
from tallyframe.operators import foraging, lookup, names
from tallyframe.operators.composition import COUNT, GROUP, ITEM, MASS
from tallyframe.operators.curves import exp_fit_from
from tallyframe.operators.density import predict_density, slope_p_value
from tallyframe.operators.ranks import rank_triplet
from tallyframe.operators.rarefy import rarefied_metrics, rarefied_metrics_from
from tallyframe.operators.redistribute import redistribute_genus
from tallyframe.operators.skew import sized_join
from tallyframe.session import cut_lineage, measured_stage

CARRION = "Artiodactyla"
NO_DENSITY = "Afrosoricida"
HANDLING_TIME = 0.02


def diet_spectrum_core(items: DataFrame) -> DataFrame:
    """All per-diet metrics that are sums over items or over the spectrum."""
    class_share = {"fBirds": "Aves", "fMamms": "Mammalia", "fIns": "Insecta"}
    total = F.sum(COUNT)

    def share(condition):
        return F.try_divide(F.sum(F.when(condition, F.col(COUNT)).otherwise(0)).cast("double"), total)

    sums = items.groupBy(GROUP).agg(
        F.count("*").alias("NumPreyTypes"),
        comp.entropy_of(COUNT).alias("SE"),
        F.try_divide(F.max(COUNT).cast("double"), total).alias("MF"),
        F.min(MASS).alias("min_mass"), F.max(MASS).alias("max_mass"),
        *[share(F.col("PreyClass") == c).alias(out) for out, c in class_share.items()],
        *[F.coalesce(share(F.col(ITEM) == label), F.lit(0.0)).alias(out)
          for out, label in (("funidBird", "Aves"), ("funidMamm", "Mammalia"))],
    )
    # Few rows per diet, read by six metrics.
    blocks = cut_lineage(comp.ranked_spectrum(items, GROUP, COUNT, *comp.top_item_sums()))
    return lookup.attach_meta(
        sums,
        comp.sp50_from(blocks),
        comp.gini_from(blocks).withColumnRenamed("gini", "Gini"),
        comp.top_items_from(blocks).select(
            GROUP, safe_ln("top_item_mass").alias("MMF"), F.col("top_item_id_level").alias("ID_MF")),
        comp.size_selectivity(items).select(
            GROUP, F.col("max_overselected_size").alias("MOS"), F.col("summed_deviance").alias("SD")),
        rarefied_metrics_from(blocks.filter("unknown = 0"), 100, 100).select(
            GROUP, F.col("rare_richness").alias("rare_NT"), F.col("rare_top_frequency").alias("rare_MF"),
            F.col("rare_entropy").alias("rare_SE")),
        exp_fit_from(blocks).select(
            GROUP, (-F.col("specialization")).alias("NetSpec"), F.col("y_intercept").alias("yInt")),
    ).withColumns({
        "MSP": safe_ln("min_mass"), "MLP": safe_ln("max_mass"),
        "MassRange": F.col("max_mass") - F.col("min_mass"),
    }).drop("min_mass", "max_mass")


SPECTRUM_COLUMNS = [
    "DataSet", "Order", "Family", "Genus", "Species", "Lat", "Long", "NumObs", "NumPreyTypes", "rare_NT",
    "NetSpec", "yInt", "MF", "rare_MF", "sp50", "Gini", "SE", "rare_SE", "Mass", "ID_MF", "MMF", "MSP",
    "MLP", "MassRange", "RichBirds", "RichMamms", "RichStrigB", "RichStrigNB", "RichAccB", "RichAccNB",
    "NumHabs", "RangeSize", "fBirds", "fMamms", "fIns", "funidBird", "funidMamm", "MOS", "SD", "Season",
    "Temp", "Seasonality", "AnnPrecip", "PrecipSeason", "Biome", "EqSplit", "FairProp",
]
RICHNESS_COLUMNS = SPECTRUM_COLUMNS[24:30]


def diet_spectrum_table(tables: Mapping[str, DataFrame], layers: list[str], flags: list[str]) -> DataFrame:
    """One row per diet of the meta table, 47 columns.

    ``tables``: items (with PreyMass), meta (DataSet, Order, Family, Genus,
    Species, Lat, Long, NumObs, raptor_mass, Season and the flag columns),
    cell_map, layers, climate, biome, ranges (species, RangeSize) and
    distinctiveness (species, EqSplit, FairProp).  ``layers`` names the six
    richness layers in the order of the output columns.
    """
    items = cut_lineage(names.exclude_values(tables["items"], "PreyOrder", [CARRION]))
    meta = names.count_flags(tables["meta"], flags).withColumn("Mass", safe_ln("raptor_mass"))
    meta = lookup.lookup(meta, tables["ranges"], "Species", "species", {"RangeSize": "RangeSize"})
    meta = lookup.lookup(meta, tables["distinctiveness"], "Species", "species",
                         {"EqSplit": "EqSplit", "FairProp": "FairProp"})
    rich = lookup.cell_richness(tables["cell_map"], tables["layers"], layers)
    rich = rich.withColumnsRenamed(dict(zip(layers, RICHNESS_COLUMNS)))
    return lookup.attach_meta(
        meta, diet_spectrum_core(items), rich, tables["climate"],
        tables["biome"].select(GROUP, F.col("biome").alias("Biome")),
    ).select(*SPECTRUM_COLUMNS)


def diet_meta_table(items: DataFrame, meta: DataFrame, rich: DataFrame, predator: str,
                    reps: int = 200, m: int = 100, fill: float | None = 0.0) -> DataFrame:
    """Meta of the diets of one predator with rarefied metrics and richness.

    ``rich`` has one row per diet with LocalRichness, RERichness and
    RaptorRichness.  Diets without a value get ``fill``.
    """
    wanted = names.contains_filter(meta, "RaptorScientificName", predator)
    used = sized_join(items, wanted.select(GROUP), [GROUP])
    rare = rarefied_metrics(used, m, reps).select(
        GROUP, F.col("rare_entropy").alias("ShannEnt_rare"), F.col("rare_richness").alias("DietRichness_rare"))
    table = lookup.attach_meta(wanted.select(
        GROUP, "RaptorScientificName", "Continent", "Num_obs", "PreyPerPellet", "ecozone"), rare, rich)
    added = [c for c in table.columns if c not in meta.columns]
    return table if fill is None else table.na.fill(fill, added)


def diet_items_table(items: DataFrame, trait: DataFrame, meta: DataFrame, predator: str) -> DataFrame:
    """Item rows of one predator with prey mass and family."""
    wanted = names.contains_filter(meta.select(GROUP, "RaptorScientificName"), "RaptorScientificName", predator)
    rows = lookup.prey_mass(sized_join(items, wanted, [GROUP]), trait)
    rows = lookup.lookup(rows, trait, ITEM, "SciName", {"Family": "PreyFamily"})
    return rows.select(GROUP, "RaptorScientificName", "IDLevel", "PreyClass", "PreyOrder", ITEM, COUNT,
                       MASS, "PreyFamily")


def foraging_items(items: DataFrame, coefficients: DataFrame, prey_class: str = "Mammalia") -> DataFrame:
    """Items that enter the foraging analysis: identified, of the class, with a
    mass, genus rows shared out, density predicted.

    The filtered rows are staged, because the genus step reads them several times.
    """
    rows = names.keep_id_levels(items)
    rows = names.contains_filter(rows, "PreyClass", prey_class)
    rows = rows.filter(F.col(MASS) != 0)
    rows = names.exclude_values(rows, "PreyOrder", [NO_DENSITY])
    return predict_density(redistribute_genus(cut_lineage(rows)), coefficients)


def diet_foraging_metrics(prey: DataFrame, meta: DataFrame, h: float = HANDLING_TIME,
                          more_than: int = 20) -> DataFrame:
    """Per diet with enough prey: rank slope, totals, attack rate, intake, test count.

    The same values as the single operators, in two grouped passes: totals and
    extremes of a diet first, then everything that compares a row with them.
    """
    item_share = F.col(COUNT) / F.col("numb_prey")
    totals = prey.groupBy(GROUP).agg(
        F.sum(COUNT).alias("numb_prey"), F.count("*").alias("numb_prey_spp"),
        F.sum("Density").alias("sum_R"), F.max("Density").alias("_top_density"), F.max(COUNT).alias("_top_count"),
        F.min(MASS).alias("smallest_prey_mass"), F.max(MASS).alias("largest_prey_mass"),
        (F.sum(F.col(COUNT) * F.col(MASS)) / F.nullif(F.sum(COUNT), F.lit(0))).alias("_mass"),
    ).filter(F.col("numb_prey") > more_than).join(meta.select(GROUP, "PreyPerPellet"), GROUP)
    p = F.col("PreyPerPellet")
    tested = (F.col("numb_prey_spp") > 1) & p.isNotNull()
    discounted = (F.col("_mass") - item_share * F.col(MASS)) * p
    biggest = F.col(MASS) == F.col("largest_prey_mass")
    common = F.col(COUNT) == F.col("_top_count")
    densest = F.col("Density") == F.col("_top_density")
    rows = comp.with_totals(rank_triplet(prey), totals)
    per_diet = rows.groupBy(*totals.columns).agg(
        F.regr_slope("CountRank", "DensRank").alias("dens_slopes"),
        F.max_by(MASS, "CountRank").alias("mass_of_most_common_dropones"),
        F.min_by(item_share, F.struct((-F.col(MASS)).alias("m"), F.col(ITEM))).alias("obs_largest_prey_freq"),
        F.min_by(item_share, F.struct(MASS, ITEM)).alias("obs_smallest_prey_freq"),
        F.sum(F.when(~biggest, F.col("Density")).otherwise(0.0)).alias("_lighter"),
        F.min_by("Density", F.when(biggest, F.col(ITEM))).alias("_heaviest"),
        F.bool_and(common == biggest).cast("int").alias("IsTopPreyBiggest"),
        F.bool_and(common == densest).cast("int").alias("IsTopPreyMostDense"),
        F.count_if(F.col(MASS) / h - discounted < 0).alias("_below"))
    return per_diet.select(
        GROUP, "numb_prey", "numb_prey_spp", "sum_R", "smallest_prey_mass", "largest_prey_mass",
        "mass_of_most_common_dropones",
        (F.col("largest_prey_mass") - F.col("smallest_prey_mass")).alias("mass_range"),
        foraging.attack_rate("sum_R", p, h).alias("baow_a"),
        "dens_slopes", slope_p_value(F.round("dens_slopes", 12), "numb_prey_spp").alias("pval_dens"),
        "obs_largest_prey_freq", "obs_smallest_prey_freq",
        (1 / (1 + F.col("_lighter") / F.nullif(F.col("_heaviest"), F.lit(0.0)))).alias("pred_largest_prey_freq"),
        "IsTopPreyBiggest", "IsTopPreyMostDense",
        (F.col("_mass") * p).alias("NE_intake"),
        F.when(tested, F.col("_below")).alias("NumPos"))


def foraging_table(meta: DataFrame, prey: DataFrame, all_items: DataFrame, h: float = HANDLING_TIME,
                   min_obs: int = 20, fill: float | None = None) -> DataFrame:
    """Meta rows with enough observations and prey, with every foraging metric.

    ``all_items`` are the items before the class filter (for the bird share).
    ``fill`` replaces the NULL of baow_a and NumPos where p is unknown.
    """
    staged = measured_stage(prey)
    table = lookup.attach_meta(
        meta, diet_foraging_metrics(staged, meta, h), comp.bird_fraction(all_items, meta))
    table = names.thresholds(table, above={"Num_obs": min_obs, "numb_prey": 0})
    return table if fill is None else table.na.fill(fill, ["baow_a", "NumPos"])


def handling_time_sweep(prey: DataFrame, meta: DataFrame, hs=foraging.CANDIDATE_H) -> DataFrame:
    """Share of prey that meets the rule, per candidate handling time."""
    staged = measured_stage(prey)
    return foraging.proportion_meeting_rule(staged, foraging.diet_totals(staged, meta), hs)


def phylo_ready_table(diets: DataFrame, traits: DataFrame, diet_renames: Mapping[str, str],
                      trait_renames: Mapping[str, str]) -> DataFrame:
    """Diets (Species, rare_NT, rare_SE, Biome) merged with traits (Species1, Mass)
    by cleaned and renamed species name."""
    left = names.remap_names(diets.withColumn("sp", normalise_name("Species")), "sp", diet_renames)
    right = names.remap_names(traits.withColumn("sp", normalise_name("Species1")), "sp", trait_renames)
    return lookup.natural_merge(
        left.select("sp", "rare_NT", "rare_SE", "Biome"), right.select("sp", "Mass"))
