"""Every operator as a query over the star-schema tables.

Each function takes (spark, sf_dir) and returns a DataFrame.  Results are
rounded to six decimals so that two engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import columns as col
from tallyframe.operators import composition as comp
from tallyframe.operators import curves, density, foraging, glm, lookup, models, names, ranks, rarefy, redistribute
from tallyframe.operators.composition import COUNT, GROUP, ITEM, MASS
from tallyframe.plans import model_list, tables
from tallyframe.session import cut_lineage, stage_path
from tallyframe.sources import files, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DIGITS = 6


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def tidy(df: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """Doubles rounded (no negative zero; not at all for None), whole numbers as BIGINT, flags as BOOLEAN."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = c if digits is None else F.round(c, digits) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


# --- shared inputs -----------------------------------------------------------

def enriched(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    return lookup.prey_mass(star.diet_items(spark, d) if items is None else items, star.trait_mass(spark, d))


def log_obs(spark: SparkSession, d: str) -> DataFrame:
    return density.log_observations(star.density_obs(spark, d))


def prey(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """The items of the foraging analysis, staged because most queries read them twice; ``items`` are those of all diets, where they are staged."""
    return cut_lineage(tables.foraging_items(enriched(spark, d, items), density.allometry_by_order(log_obs(spark, d))))


def richness_columns(spark: SparkSession, d: str) -> DataFrame:
    rich = lookup.cell_richness(star.cell_map(spark, d), star.richness_layers(spark, d),
                                ["ALL", "SUPPLIERS", "MACHINERY"])
    return rich.withColumnsRenamed(
        {"ALL": "LocalRichness", "SUPPLIERS": "RERichness", "MACHINERY": "RaptorRichness"})


def model_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per diet with every column the model list names."""
    items = cut_lineage(star.diet_items(spark, d))
    meta = cut_lineage(star.diet_meta(spark, d))
    # At this handling time some prey fail the test, so NumPos varies.
    table = tables.foraging_table(meta, prey(spark, d, items), items, h=0.16)
    rare = rarefy.rarefied_metrics(items).select(
        GROUP, F.col("rare_entropy").alias("ShannEnt_rare"), F.col("rare_richness").alias("DietRichness_rare"))
    full = lookup.attach_meta(table, rare, richness_columns(spark, d)).withColumns({
        "l_re": col.safe_log10("RERichness"), "l_ns": col.safe_log10("numb_prey_spp"),
        "log_LocalRichness": col.safe_ln("LocalRichness"), "log_sum_R": col.safe_ln("sum_R"),
        "log_numb_prey_spp": col.safe_ln("numb_prey_spp"), "log_NE_intake": col.safe_ln("NE_intake"),
    })
    return cut_lineage(tidy(full, None))


def totals(spark: SparkSession, d: str, items: DataFrame) -> DataFrame:
    return foraging.diet_totals(items, star.diet_meta(spark, d))


# --- sources and sinks ---------------------------------------------------------

@query
def read_table(spark, d):
    path = files.write_table(star.table(spark, d, "part"), stage_path(spark, "part"), "csv")
    schema = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    return files.read_table(spark, path, schema)


@query
def read_richness_layers(spark, d):
    layers = cut_lineage(star.richness_layers(spark, d))
    paths = {
        name: files.write_table(
            layers.filter(F.col("layer") == name).select("POLYFID", "species"), stage_path(spark, "layer"), "csv")
        for name in star.LAYERS
    }
    return files.read_richness_layers(spark, paths).select("layer", "POLYFID", "species")


@query
def read_sheet_export(spark, d):
    sheet = star.diet_meta(spark, d).select(
        F.col("DataSet").alias("Data set"), F.col("ecozone").alias("Zone"),
        F.coalesce(F.col("PreyPerPellet").cast("string"), F.lit("NA")).alias("Prey per pellet"))
    path = files.write_table(sheet, stage_path(spark, "sheet"), "csv")
    return files.read_sheet_export(
        spark, path, "`Data set` BIGINT, Zone STRING, `Prey per pellet` DOUBLE",
        {"Data set": "DataSet", "Prey per pellet": "PreyPerPellet"})


@query
def parse_na(spark, d):
    text = F.when(F.col(COUNT) % 10 == 0, "NA").when(F.col(COUNT) % 11 != 0, F.col(COUNT).cast("string"))
    raw = star.diet_items(spark, d).select(GROUP, ITEM, text.alias("Count"))
    return files.parse_na(raw, "Count", "CountInt")


@query
def write_table(spark, d):
    path = files.write_table(star.diet_items(spark, d), stage_path(spark, "items"), "csv")
    schema = ("DataSet BIGINT, IDLevel STRING, PreyClass STRING, PreyOrder STRING, "
              "PreyScientificName STRING, CountInt BIGINT")
    return files.read_table(spark, path, schema)


@query
def reload_stage(spark, d):
    path = files.write_table(star.diet_meta(spark, d), stage_path(spark, "meta"))
    return files.reload_stage(spark, path)


# --- projections, filters, scalar expressions ------------------------------------

@query
def select_rename(spark, d):
    return files.select_as(star.diet_items(spark, d), {GROUP: "diet", ITEM: "prey", COUNT: "n"})


@query
def drop_missing(spark, d):
    return names.drop_missing(star.diet_meta(spark, d).select(GROUP, "PreyPerPellet"), "PreyPerPellet")


@query
def exclude_values(spark, d):
    rows = names.exclude_values(star.diet_items(spark, d), "PreyOrder", ["O4"])
    return names.exclude_values(rows, GROUP, [5])


@query
def keep_id_levels(spark, d):
    return names.keep_id_levels(star.diet_items(spark, d), ["Genus"])


@query
def contains_filter(spark, d):
    return names.contains_filter(star.diet_meta(spark, d), "RaptorScientificName", "NATION_1")


@query
def threshold_filters(spark, d):
    rows = star.diet_meta(spark, d).withColumn("remainder", F.col("Num_obs") % 3)
    return names.thresholds(rows, above={"Num_obs": 20, GROUP: 3}, nonzero=["remainder"])


@query
def log_transforms(spark, d):
    return star.table(spark, d, "part").select(
        "p_partkey", col.safe_log10(F.col("p_size") - 10).alias("log10_size"),
        col.safe_ln("p_retailprice").alias("ln_price"), F.exp(F.col("p_size") / 50).alias("exp_size"),
        (-F.col("p_size")).alias("negated"), F.abs(F.col("p_size") - 25).alias("distance"))


@query
def normalise_name(spark, d):
    return star.table(spark, d, "part").select("p_partkey", col.normalise_name("p_name").alias("name"))


@query
def genus_label(spark, d):
    return star.parts(spark, d).select("p_partkey", col.genus_label("Genus").alias("label"))


@query
def genus_of(spark, d):
    return star.diet_items(spark, d).select(GROUP, ITEM, col.genus_of(ITEM).alias("genus"))


RENAMES = {"anvil blue": "bolt blue", "bolt blue": "bolt small", "gear sp": "gizmo sp", "rod hot": "rod cold"}


@query
def remap_names(spark, d):
    return comp.group_sum(names.remap_names(star.diet_items(spark, d), ITEM, RENAMES), [GROUP, ITEM])


@query
def level_codes(spark, d):
    rows = star.diet_items(spark, d).select(GROUP, "PreyClass", "PreyOrder", ITEM)
    coded = names.code_columns(rows, {"order_code": "PreyOrder", "item_code": ITEM})
    return names.level_codes(coded, "PreyClass", ["Insecta", "Aves"], out="class_code")


@query
def count_flags(spark, d):
    return names.count_flags(star.flag_table(spark, d), star.FLAGS)


@query
def functional_response(spark, d):
    rows = star.diet_meta(spark, d)
    return rows.select(GROUP, col.functional_response("Num_obs", F.col("PreyPerPellet") / 1000, 0.02).alias("rate"))


@query
def unit_scale(spark, d):
    return star.diet_meta(spark, d).select(GROUP, col.unit_scale(F.col("PreyPerPellet") / 7e5).alias("rate"))


# --- joins and look-ups ----------------------------------------------------------

@query
def lookup_first(spark, d):
    rows = star.diet_items(spark, d).select(GROUP, ITEM)
    return lookup.lookup(rows, star.trait_records(spark, d), ITEM, "SciName",
                         {"BodyMassValue": "PreyMass"}, "first", "p_partkey")


@query
def lookup_mean(spark, d):
    rows = star.diet_items(spark, d).select(GROUP, ITEM)
    return lookup.lookup(rows, star.trait_records(spark, d), ITEM, "SciName", {"BodyMassValue": "PreyMass"}, "mean")


@query
def lookup_unique(spark, d):
    rows = star.diet_items(spark, d).select(GROUP, ITEM)
    return lookup.lookup(rows, star.trait_mass(spark, d), ITEM, "SciName", {"BodyMassValue": "PreyMass"})


@query
def lookup_chain(spark, d):
    return enriched(spark, d).select(GROUP, ITEM, MASS)


@query
def family_lookup(spark, d):
    rows = star.diet_items(spark, d).select(GROUP, ITEM)
    return lookup.lookup(rows, star.trait_mass(spark, d), ITEM, "SciName", {"Family": "PreyFamily"})


def predator_traits(spark, d):
    """Two scores and a range per nation, which plays the predator species."""
    customers = star.table(spark, d, "customer").groupBy("c_nationkey").agg(
        F.count("*").cast("double").alias("RangeSize"), F.avg("c_acctbal").alias("EqSplit"),
        F.max("c_acctbal").alias("FairProp"))
    return customers.join(star.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("species"), "RangeSize", "EqSplit", "FairProp")


@query
def raptor_traits(spark, d):
    rows = star.diet_meta(spark, d).select(GROUP, F.col("Continent").alias("Species"))
    traits = predator_traits(spark, d)
    rows = lookup.lookup(rows, traits, "Species", "species", {"RangeSize": "RangeSize"})
    return lookup.lookup(rows, traits, "Species", "species", {"EqSplit": "EqSplit", "FairProp": "FairProp"})


@query
def cell_richness(spark, d):
    return lookup.cell_richness(star.cell_map(spark, d), star.richness_layers(spark, d), star.LAYERS)


@query
def cell_richness_filled(spark, d):
    return lookup.cell_richness(star.cell_map(spark, d), star.richness_layers(spark, d), star.SEGMENTS, fill=0)


@query
def attach_meta(spark, d):
    items = star.diet_items(spark, d)
    return lookup.attach_meta(
        star.diet_meta(spark, d), comp.shannon_entropy(items), comp.richness(items), star.climate(spark, d))


@query
def natural_merge(spark, d):
    a = star.diet_items(spark, d).select(GROUP, "PreyOrder", COUNT)
    orders = log_obs(spark, d).groupBy(F.col("Order").alias("PreyOrder")).agg(F.max("BodyMass").alias("top_mass"))
    return lookup.natural_merge(a, orders)


def _caught(spark, d):
    return star.diet_items(spark, d).select(F.col(ITEM).alias("name"))


@query
def names_not_in(spark, d):
    return lookup.names_not_in(_caught(spark, d), star.parts(spark, d).select(F.col("SciName").alias("name")), "name")


@query
def names_in(spark, d):
    return lookup.names_in(_caught(spark, d), star.parts(spark, d).select(F.col("SciName").alias("name")), "name")


@query
def genus_matches(spark, d):
    return redistribute.genus_matches(cut_lineage(star.diet_items(spark, d)))


@query
def cross_candidates(spark, d):
    return lookup.cross_candidates(star.diet_items(spark, d).select(GROUP, ITEM), foraging.CANDIDATE_H)


# --- aggregations -----------------------------------------------------------------

@query
def by_diet(spark, d):
    return star.diet_items(spark, d).groupBy(GROUP).agg(
        F.count("*").alias("items"), F.sum(COUNT).alias("prey"), F.max(COUNT).alias("top"))


@query
def group_sum(spark, d):
    items = cut_lineage(star.diet_items(spark, d))
    parts = [
        comp.group_sum(items, [key]).select(F.lit(key).alias("by"), F.col(key).alias("key"), "TotalSum")
        for key in ("PreyClass", "PreyOrder")
    ]
    return parts[0].unionByName(parts[1])


@query
def group_mean(spark, d):
    return comp.group_mean(star.trait_records(spark, d), ["SciName"], "BodyMassValue")


@query
def group_count_valid(spark, d):
    return comp.group_count_valid(star.diet_meta(spark, d), ["ecozone"], "PreyPerPellet")


@query
def distinct_values(spark, d):
    return comp.distinct_values(star.diet_items(spark, d), ITEM)


@query
def distinct_counts(spark, d):
    return comp.distinct_counts(star.diet_items(spark, d), [GROUP, "PreyClass", "PreyOrder", ITEM])


@query
def share_of_total(spark, d):
    return comp.share_of_total(star.diet_items(spark, d), "PreyClass")


@query
def global_summary(spark, d):
    return comp.global_summary(star.diet_meta(spark, d))


@query
def class_fractions(spark, d):
    return comp.class_fractions(star.diet_items(spark, d), {"fMamms": "Mammalia", "fBirds": "Aves", "fIns": "Insecta"})


@query
def bird_fraction(spark, d):
    return comp.bird_fraction(star.diet_items(spark, d), star.diet_meta(spark, d))


@query
def unidentified_fraction(spark, d):
    return comp.unidentified_fraction(star.diet_items(spark, d), labels={"funidBird": "rod sp", "funidMamm": "gear sp"})


@query
def frequencies(spark, d):
    return comp.frequencies(star.diet_items(spark, d)).select(GROUP, ITEM, COUNT, "Frequencies")


@query
def top_frequency(spark, d):
    return comp.top_frequency(star.diet_items(spark, d))


@query
def top_items(spark, d):
    return comp.top_items(enriched(spark, d))


@query
def richness(spark, d):
    return comp.richness(star.diet_items(spark, d))


@query
def prey_total(spark, d):
    return comp.prey_total(star.diet_items(spark, d))


@query
def shannon_entropy(spark, d):
    return comp.shannon_entropy(star.diet_items(spark, d))


@query
def gini_rank_population(spark, d):
    return comp.gini(star.diet_items(spark, d))


@query
def gini_unit_population(spark, d):
    return comp.gini(star.diet_items(spark, d), population="one")


@query
def mass_range(spark, d):
    return comp.mass_range(enriched(spark, d))


@query
def lognormal_params(spark, d):
    return comp.lognormal_params(star.diet_items(spark, d))


@query
def size_selectivity(spark, d):
    return comp.size_selectivity(cut_lineage(enriched(spark, d)))


@query
def weighted_mean_mass(spark, d):
    return comp.weighted_mean_mass(enriched(spark, d))


@query
def total_density(spark, d):
    return comp.total_density(prey(spark, d))


@query
def extreme_item_frequency(spark, d):
    return comp.extreme_item_frequency(prey(spark, d))


@query
def predicted_largest_frequency(spark, d):
    return comp.predicted_largest_frequency(prey(spark, d))


@query
def extreme_masses(spark, d):
    return comp.extreme_masses(prey(spark, d))


@query
def mass_of_most_common(spark, d):
    return comp.mass_of_most_common(prey(spark, d))


@query
def top_item_flags(spark, d):
    return comp.top_item_flags(prey(spark, d))


@query
def presence_matrix(spark, d):
    return comp.presence_matrix(star.diet_items(spark, d), "PreyOrder", ["O1", "O2", "O3", "O4"])


@query
def diets_per_category(spark, d):
    return comp.diets_per_category(star.diet_items(spark, d), ITEM)


@query
def count_positive_share(spark, d):
    fit = density.rank_regression(ranks.rank_triplet(prey(spark, d)))
    return comp.count_positive_share(fit, "dens_slopes")


@query
def handling_time_lower_bound(spark, d):
    return comp.handling_time_lower_bound(star.diet_meta(spark, d))


@query
def median_by_level(spark, d):
    draws = density.long_draws(star.posterior_draws(spark, d), [1, 2, 3, 4])
    return density.median_by_level(draws)


@query
def correlation_pearson(spark, d):
    return comp.correlation(star.table(spark, d, "part"), "p_size", "p_retailprice")


@query
def correlation_spearman(spark, d):
    return comp.correlation(star.table(spark, d, "part"), "p_size", "p_retailprice", "spearman")


# --- ranks ---------------------------------------------------------------------

@query
def rank_abundance(spark, d):
    return ranks.rank_abundance(star.diet_items(spark, d)).select(GROUP, ITEM, COUNT, "rank", "frequency")


@query
def cumulative_share(spark, d):
    return ranks.cumulative_share(star.diet_items(spark, d)).select(GROUP, ITEM, "cumulative")


@query
def cumulative_share_by_name(spark, d):
    return ranks.cumulative_share(star.diet_items(spark, d), by="name").select(GROUP, ITEM, "cumulative")


@query
def sp50(spark, d):
    return comp.sp50(star.diet_items(spark, d))


@query
def rank_triplet(spark, d):
    return ranks.rank_triplet(prey(spark, d)).select(GROUP, ITEM, "DensRank", "CountRank", "MassRank")


@query
def group_share(spark, d):
    return ranks.diet_shares(prey(spark, d)).select(GROUP, ITEM, "Frequencies", "Rel_density")


@query
def frequency_gap(spark, d):
    return ranks.frequency_gap(prey(spark, d))


@query
def sorted_families(spark, d):
    counts = comp.diets_per_category(
        lookup.lookup(star.diet_items(spark, d), star.trait_mass(spark, d), ITEM,
                      "SciName", {"Family": "PreyFamily"}), "PreyFamily")
    return counts.orderBy(F.desc("Diets"), "PreyFamily")


@query
def first_crossing(spark, d):
    return ranks.first_crossing(ranks.cumulative_share(star.diet_items(spark, d)), 0.3)


# --- sets ----------------------------------------------------------------------

@query
def union_adjusted(spark, d):
    items = star.diet_items(spark, d).select(GROUP, ITEM, COUNT)
    adjusted = items.filter(F.col(ITEM).startswith("gear")).withColumn(COUNT, F.col(COUNT) * 2)
    return redistribute.union_adjusted(items, adjusted, [GROUP, ITEM])


@query
def test_differences(spark, d):
    items = prey(spark, d)
    return foraging.foraging_test(items, totals(spark, d, items), [0.02]).select(GROUP, ITEM, "diff")


@query
def stacked_names(spark, d):
    traits = star.trait_mass(spark, d)
    genus = lookup.genus_means(traits).select(F.col("label").alias("name"), "BodyMassValue")
    family = traits.groupBy("Family").agg(F.avg("BodyMassValue").alias("BodyMassValue"))
    return genus.unionByName(family.withColumnRenamed("Family", "name"))


@query
def redistribute_genus(spark, d):
    return redistribute.redistribute_genus(cut_lineage(star.diet_items(spark, d)))


# --- rarefaction -------------------------------------------------------------------

@query
def rarefy_draws(spark, d):
    return rarefy.rarefy(star.diet_items(spark, d), m=100, reps=100)


@query
def frequency_table(spark, d):
    return rarefy.frequency_table(star.diet_items(spark, d), m=100, reps=200)


@query
def rarefied_richness(spark, d):
    return rarefy.rarefied_metrics(star.diet_items(spark, d)).select(GROUP, "rare_richness")


@query
def rarefied_entropy(spark, d):
    return rarefy.rarefied_metrics(star.diet_items(spark, d)).select(GROUP, "rare_entropy")


@query
def rarefied_top_frequency(spark, d):
    return rarefy.rarefied_metrics(star.diet_items(spark, d), reps=100).select(GROUP, "rare_top_frequency")


@query
def expected_rarefied_richness(spark, d):
    return rarefy.expected_rarefied_richness(star.diet_items(spark, d))


@query
def rarefaction_skips_unknown(spark, d):
    unknown = (F.col(GROUP) % 4 == 1) & (F.col(ITEM) == "gear sp")
    items = star.diet_items(spark, d).withColumn(COUNT, F.when(~unknown, F.col(COUNT)))
    return rarefy.rarefied_metrics(items, m=100, reps=200, fill=0.0)


@query
def rarefaction_effect(spark, d):
    return rarefy.rarefaction_effect(star.diet_items(spark, d))


@query
def sampled_metrics(spark, d):
    """Samples of ten million: every item is met, and the entropy is that of the whole diet."""
    items = cut_lineage(star.diet_items(spark, d))
    return rarefy.sampled_metrics(items, m=10_000_000).join(comp.shannon_entropy(items), GROUP).select(
        GROUP, "rare_richness", (F.abs(F.col("rare_entropy") - F.col("entropy")) < 1e-4).alias("entropy_agrees"))


@query
def sampled_richness(spark, d):
    """Mean richness of 200 samples of 100 per diet against its expectation, summed over the diets.

    The variance of a richness is at most the sum of q (1 - q) with q the chance that an item is missed.
    """
    items = cut_lineage(star.diet_items(spark, d))
    q = F.pow(1 - F.col(COUNT) / F.col("total"), F.lit(100.0))
    law = comp.ranked_spectrum(items).groupBy(GROUP).agg(
        F.sum(F.col("n_items") * (1 - q)).alias("expected"), F.sum(F.col("n_items") * q * (1 - q)).alias("variance"))
    gap = F.abs(F.sum("rare_richness") - F.sum("expected"))
    return rarefy.sampled_metrics(items, m=100, reps=200).join(law, GROUP).agg(
        F.count("*").alias("diets"), F.sum("expected").alias("expected_richness"),
        (gap <= 4 * F.sqrt(F.sum("variance") / 200)).alias("agrees"))


# --- density and regressions ---------------------------------------------------------

@query
def allometry_simple(spark, d):
    return density.allometry_simple(log_obs(spark, d))


@query
def allometry_by_order(spark, d):
    return density.allometry_by_order(log_obs(spark, d))


@query
def allometry_r2(spark, d):
    return density.allometry_r2(log_obs(spark, d))


@query
def predict_density(spark, d):
    rows = enriched(spark, d).select(ITEM, "PreyOrder", MASS).distinct()
    lines = density.allometry_by_order(log_obs(spark, d))
    natural = density.predict_density(rows, lines).select(ITEM, "LogDensity", "Density")
    decimal = density.predict_density(rows, lines, base="10").select(ITEM, F.col("Density").alias("Density10"))
    return natural.join(decimal, ITEM)


def _coded_species(spark, d):
    rows = enriched(spark, d).select(ITEM, "PreyOrder", col.safe_log10(MASS).alias("LogMass")).distinct()
    return names.level_codes(rows, "PreyOrder", out="group_idx")


@query
def posterior_density(spark, d):
    draws = density.long_draws(star.posterior_draws(spark, d), [1, 2, 3, 4])
    return density.posterior_density(_coded_species(spark, d), draws, [ITEM])


@query
def posterior_summary(spark, d):
    draws = density.long_draws(star.posterior_draws(spark, d), [1, 2, 3, 4])
    return density.posterior_summary(_coded_species(spark, d), draws, [ITEM])


@query
def posterior_point(spark, d):
    medians = density.median_by_level(density.long_draws(star.posterior_draws(spark, d), [1, 2, 3, 4]))
    return density.posterior_point(_coded_species(spark, d), medians, [ITEM])


@query
def rank_regression(spark, d):
    return density.rank_regression(ranks.rank_triplet(prey(spark, d)))


@query
def rank_line(spark, d):
    ranked = ranks.rank_triplet(prey(spark, d))
    return density.rank_line(ranked, density.rank_regression(ranked))


@query
def ols_formulas(spark, d):
    wanted = [m for m in model_list.OLS if not model_list.near_copies(m)]
    return models.coefficient_table(spark, models.ols_many(model_table(spark, d), wanted))


@query
def ols_formulas_near_copies(spark, d):
    wanted = [m for m in model_list.OLS if model_list.near_copies(m)]
    return models.coefficient_table(spark, models.ols_many(model_table(spark, d), wanted))


@query
def ols_fitted_near_copies(spark, d):
    """Fitted values of the models whose terms nearly copy each other; their coefficients are not stable."""
    table = model_table(spark, d)
    fits = models.ols_many(table, [m for m in model_list.OLS if model_list.near_copies(m)])
    rows = [F.struct(F.lit(f.model.label).alias("model"), f.fitted().alias("fitted")) for f in fits]
    return table.select(GROUP, F.explode(F.array(*rows)).alias("f")).select(GROUP, "f.*")


@query
def ols_r2(spark, d):
    return models.r2_table(spark, models.ols_many(model_table(spark, d), model_list.OLS))


@query
def predict_interval(spark, d):
    table = model_table(spark, d)
    return models.predict_interval(table, models.ols(table, "l_ns", ["l_re"]))


@query
def predict_interval_of_several(spark, d):
    table = model_table(spark, d)
    fit = models.ols(table, "l_ns", ["l_re", "log_LocalRichness", "FreqBirds"])
    return models.predict_interval(table, fit, along="log_LocalRichness")


@query
def residuals(spark, d):
    table = model_table(spark, d)
    fit = models.ols(table, "dens_slopes", ["FreqBirds", "sum_R"])
    return models.residuals(table, fit, "residual").select(GROUP, "residual")


@query
def partial_regression(spark, d):
    fit = models.partial_regression(
        model_table(spark, d), "dens_slopes", "ShannEnt_rare", ["DietRichness_rare", "PreyPerPellet", "largest_prey_mass"])
    return models.coefficient_table(spark, [fit])


@query
def poisson_glm(spark, d):
    table = model_table(spark, d)
    return glm.glm_table(table, glm.poisson_many(table, [m for m in model_list.POISSON if not _copied(m)]))


def _copied(spec: tuple[str, list[str]]) -> bool:
    return model_list.near_copies(models.Model(spec[0], tuple(spec[1])))


@query
def poisson_glm_near_copies(spark, d):
    """How well models fit whose terms nearly copy each other; their coefficients are not stable."""
    fits = glm.poisson_many(model_table(spark, d), [m for m in model_list.POISSON if _copied(m)])
    return spark.createDataFrame([(f.label, f.n, float(f.deviance), f.converged) for f in fits], "model string, n bigint, lack double, converged boolean")


@query
def probit_glm(spark, d):
    return glm.probit_glm(model_table(spark, d), "IsTopPreyBiggest", ["mass_of_most_common_dropones"])


@query
def random_intercept_lm(spark, d):
    table = model_table(spark, d)
    wanted = [m for m in model_list.MIXED if not model_list.near_copies(m)]
    return models.mixed_table(spark, models.random_intercept_many(table, wanted))


@query
def random_intercept_near_copies(spark, d):
    """Likelihood (to three places) and variances of the models whose terms nearly copy each other; their coefficients are not stable."""
    wanted = [m for m in model_list.MIXED if model_list.near_copies(m)]
    fits = models.random_intercept_many(model_table(spark, d), wanted)
    return spark.createDataFrame([(f.model.label, models._null(f.sigma2), models._null(f.tau * f.sigma2), models._null(round(f.loglik, 3)), f.n, f.groups) for f in fits],
                                 "model string, residual_variance double, group_variance double, loglik double, n bigint, groups bigint")


@query
def exp_fit(spark, d):
    return curves.exp_fit(star.diet_items(spark, d))


@query
def exp_curve(spark, d):
    return curves.exp_curve(curves.exp_fit(star.diet_items(spark, d)))


@query
def histogram(spark, d):
    return comp.histogram(star.table(spark, d, "part"), "p_retailprice", 8)


# --- foraging -----------------------------------------------------------------------

@query
def attack_rate(spark, d):
    sums = comp.total_density(prey(spark, d))
    return sums.join(star.diet_meta(spark, d), GROUP).select(
        GROUP, foraging.attack_rate("sum_R", "PreyPerPellet", 0.02).alias("baow_a"))


@query
def intake_rate(spark, d):
    return foraging.intake_rate(totals(spark, d, prey(spark, d)), meals=3)


@query
def discounted_intake(spark, d):
    items = prey(spark, d)
    return foraging.discounted_intake(items, totals(spark, d, items)).select(GROUP, ITEM, "ne_disc")


@query
def foraging_test(spark, d):
    items = prey(spark, d)
    return foraging.foraging_test(items, totals(spark, d, items))


@query
def suboptimal_count(spark, d):
    items = prey(spark, d)
    return foraging.suboptimal_count(foraging.foraging_test(items, totals(spark, d, items)))


@query
def proportion_meeting_rule(spark, d):
    items = prey(spark, d)
    return foraging.proportion_meeting_rule(items, totals(spark, d, items), [0.01, 0.02, 0.04, 0.08, 0.16, 0.5, 0.9])


def _attack_rates(spark, d):
    sums = comp.total_density(prey(spark, d))
    return sums.join(star.diet_meta(spark, d), GROUP).select(
        GROUP, "sum_R", foraging.attack_rate("sum_R", "PreyPerPellet", 0.02).alias("baow_a"))


@query
def response_curve(spark, d):
    return foraging.response_curve(_attack_rates(spark, d))


@query
def clearance_comparison(spark, d):
    return foraging.clearance_comparison(_attack_rates(spark, d), star.clearance_records(spark, d))


@query
def mean_clearance(spark, d):
    return foraging.mean_clearance(_attack_rates(spark, d))


@query
def net_energy_points(spark, d):
    items = prey(spark, d)
    return foraging.net_energy_points(foraging.foraging_test(items, totals(spark, d, items), [0.02]))


# --- assembled tables -----------------------------------------------------------------

SPECTRUM_LAYERS = ["ALL", "SUPPLIERS", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _spectrum_inputs(spark, d) -> dict[str, DataFrame]:
    supplier = star.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias(GROUP), "s_acctbal",
        F.when(F.col("s_suppkey") % 2 == 0, "X").alias("Forest"),
        F.when(F.col("s_suppkey") % 3 == 0, "X").alias("Desert"),
        F.when(F.col("s_suppkey") % 5 == 0, "X").alias("Urban"))
    meta = star.diet_meta(spark, d).join(supplier, GROUP).select(
        GROUP, F.col("ecozone").alias("Order"), F.col("Continent").alias("Family"),
        F.split_part("Continent", F.lit("_"), F.lit(2)).alias("Genus"), F.col("Continent").alias("Species"),
        (F.col("s_acctbal") / 1000).alias("Lat"), (F.col("s_acctbal") / 500).alias("Long"),
        F.col("Num_obs").alias("NumObs"), (F.abs("s_acctbal") + 1).alias("raptor_mass"),
        (F.col(GROUP) % 4).cast("string").alias("Season"), "Forest", "Desert", "Urban")
    return {
        "items": enriched(spark, d), "meta": meta, "cell_map": star.cell_map(spark, d),
        "layers": star.richness_layers(spark, d), "climate": star.climate(spark, d),
        "biome": star.cell_map(spark, d).select(GROUP, (F.col("POLYFID") % 14).alias("biome")),
        "ranges": predator_traits(spark, d), "distinctiveness": predator_traits(spark, d),
    }


@query
def diet_spectrum_table(spark, d):
    return tables.diet_spectrum_table(_spectrum_inputs(spark, d), SPECTRUM_LAYERS, ["Forest", "Desert", "Urban"])


@query
def diet_meta_table(spark, d):
    return tables.diet_meta_table(
        star.diet_items(spark, d), star.diet_meta(spark, d), richness_columns(spark, d), "ASIA")


@query
def diet_items_table(spark, d):
    return tables.diet_items_table(
        star.diet_items(spark, d), star.trait_mass(spark, d), star.diet_meta(spark, d), "ASIA")


@query
def foraging_table(spark, d):
    items = cut_lineage(star.diet_items(spark, d))
    lines = density.allometry_by_order(log_obs(spark, d))
    rows = tables.foraging_items(lookup.prey_mass(items, star.trait_mass(spark, d)), lines)
    return tables.foraging_table(star.diet_meta(spark, d), rows, items)


@query
def handling_time_sweep(spark, d):
    lines = density.allometry_by_order(log_obs(spark, d))
    return tables.handling_time_sweep(tables.foraging_items(enriched(spark, d), lines), star.diet_meta(spark, d))


def _phylo_rows(spark, d):
    items = cut_lineage(star.diet_items(spark, d))
    diets = lookup.attach_meta(
        star.diet_meta(spark, d).select(
            GROUP, F.col("RaptorScientificName").alias("Species"), "Continent", F.col("ecozone").alias("Biome")),
        rarefy.rarefied_metrics(items).select(
            GROUP, F.col("rare_richness").alias("rare_NT"), F.col("rare_entropy").alias("rare_SE")))
    traits = star.table(spark, d, "nation").join(
        star.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws(" ", "r_name", "n_name").alias("Species1"), F.col("n_nationkey").cast("double").alias("Mass"))
    return diets, traits


@query
def phylo_ready_table(spark, d):
    renames = {"ASIA_NATION_2": "ASIA_NATION_7", "AFRICA_NATION_0": "AFRICA_NATION_5"}
    return tables.phylo_ready_table(*_phylo_rows(spark, d), renames, {"AFRICA_NATION_0": "AFRICA_NATION_5"})


@query
def random_intercept_biome(spark, d):
    """Rarefied metrics against predator mass and distinctiveness, with an intercept per biome."""
    diets, traits = _phylo_rows(spark, d)
    rows = lookup.lookup(diets, traits, "Species", "Species1", {"Mass": "Mass"})
    rows = cut_lineage(lookup.lookup(rows, predator_traits(spark, d), "Continent", "species", {"FairProp": "FairProp"}))
    return models.mixed_table(spark, models.random_intercept_many(rows, model_list.BIOME))


# --- small diets --------------------------------------------------------------------
# An order is a diet of a few items; one prey order is excluded, and two genera have no mass.

def sparse_items(spark: SparkSession, d: str) -> DataFrame:
    return names.exclude_values(star.diet_items(spark, d, "l_orderkey"), "PreyOrder", ["O4"])


def sparse_enriched(spark: SparkSession, d: str) -> DataFrame:
    return lookup.prey_mass(sparse_items(spark, d), star.sparse_traits(spark, d))


@query
def sparse_sp50(spark, d):
    return comp.sp50(sparse_items(spark, d))


@query
def sparse_lognormal_params(spark, d):
    return comp.lognormal_params(sparse_items(spark, d))


@query
def sparse_exp_fit(spark, d):
    return curves.exp_fit(sparse_items(spark, d))


@query
def sparse_size_selectivity(spark, d):
    return comp.size_selectivity(cut_lineage(sparse_enriched(spark, d)))


@query
def sparse_foraging_test(spark, d):
    items = cut_lineage(tables.foraging_items(sparse_enriched(spark, d), density.allometry_by_order(log_obs(spark, d))))
    tests = foraging.foraging_test(items, foraging.diet_totals(items, star.sparse_meta(spark, d)))
    # Many values of so few items lie halfway between two last digits.
    return tests.withColumns({c: F.round(c, 9) for c in ("ne_prey", "ne_disc", "diff")})
