"""Composition tables out of the star-schema test tables.

A supplier plays the diet, a part name plays the prey (the noun is the genus),
a nation plays the spatial cell and a region the ecozone.  See README for the
whole mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import genus_label

# Which nouns belong to which order, which orders to which class.
ORDER_OF_NOUN = {
    "anvil": "O1", "bolt": "O1",
    "gear": "O2", "gizmo": "O2", "plate": "O2",
    "ring": "O3", "rod": "O3",
    "widget": "O4",
}
CLASS_OF_ORDER = {"O1": "Mammalia", "O2": "Mammalia", "O3": "Aves", "O4": "Insecta"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# Declared, so that opening a table starts no job to find its schema.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _case(value: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, result in mapping.items():
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the noun first, as a species name."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    adjective = F.split_part("p_name", F.lit(" "), F.lit(1))
    order = _case(noun, ORDER_OF_NOUN)
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", "p_size",
        noun.alias("Genus"),
        F.concat_ws(" ", noun, adjective).alias("SciName"),
        order.alias("PreyOrder"),
    )


def diet_items(spark: SparkSession, sf_dir: str, diet: str = "l_suppkey") -> DataFrame:
    """One row per (diet, id level, prey name) with the summed count; the diet is a column of the line items."""
    level = F.when(F.col("l_linenumber") % 7 == 0, "Genus").otherwise("Species")
    lines = table(spark, sf_dir, "lineitem").select(
        diet, "l_partkey", level.alias("IDLevel"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    prey = F.when(F.col("IDLevel") == "Genus", genus_label("Genus")).otherwise(F.col("SciName"))
    # The class follows from the order, so it is no key and is found for the summed rows only.
    return (
        lines.join(parts(spark, sf_dir), lines.l_partkey == F.col("p_partkey"))
        .groupBy(F.col(diet).alias("DataSet"), "IDLevel", "PreyOrder", prey.alias("PreyScientificName"))
        .agg(F.sum("quantity").alias("CountInt"))
        .select("DataSet", "IDLevel", _case(F.col("PreyOrder"), CLASS_OF_ORDER).alias("PreyClass"), "PreyOrder",
                "PreyScientificName", "CountInt")
    )


def trait_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species masses and families, one row per species."""
    return parts(spark, sf_dir).groupBy("SciName", "Genus").agg(
        F.avg("p_size").alias("BodyMassValue"),
        F.min_by("p_type", "p_partkey").alias("Family"),
    )


def sparse_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species masses without two genera, whose prey then has no mass."""
    return trait_mass(spark, sf_dir).filter(~F.col("Genus").isin("anvil", "rod"))


def sparse_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, the diet of the sparse mapping."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("DataSet"), F.when(key % 4 != 0, (1 + key % 5).cast("double")).alias("PreyPerPellet"))


def trait_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unreduced trait table: many records per species."""
    return parts(spark, sf_dir).select(
        "p_partkey", "SciName", "Genus", F.col("p_size").cast("double").alias("BodyMassValue"),
        F.col("p_type").alias("Family"),
    )


def density_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One density observation per part: species, order, mass, density."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("Density_km"))
    obs = parts(spark, sf_dir).join(lines, F.col("p_partkey") == F.col("l_partkey"))
    return obs.select(
        F.col("p_partkey").alias("obs_id"),
        F.col("SciName").alias("AcceptedName_COL"),
        F.col("PreyOrder").alias("Order"),
        F.col("p_size").cast("double").alias("BodyMass"),
        "Density_km",
    )


def diet_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per diet: predator, continent, ecozone, observations, prey per pellet."""
    key = F.col("s_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("Num_obs"))
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lines, key == F.col("l_suppkey"), "left")
        .select(
            key.alias("DataSet"),
            F.concat_ws(" ", "r_name", "n_name").alias("RaptorScientificName"),
            F.col("n_name").alias("Continent"),
            F.coalesce("Num_obs", F.lit(0)).alias("Num_obs"),
            F.when(key % 4 != 0, (1 + key % 5).cast("double")).alias("PreyPerPellet"),
            F.col("r_name").alias("ecozone"),
        )
    )


def cell_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diet -> cell; every tenth diet has no cell."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("DataSet"),
        F.when(F.col("s_suppkey") % 10 != 7, F.col("s_nationkey").cast("bigint")).alias("POLYFID"),
    )


def richness_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, cell, species): customers per nation and segment, and suppliers.

    Layers have holes, as shipped ones do: a segment layer has no cell where
    the nation key plus the segment number is a multiple of six.
    """
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("POLYFID"), "c_mktsegment")
    by_segment = customers.groupBy(F.col("c_mktsegment").alias("layer"), "POLYFID").agg(
        F.count("*").alias("species"))
    position = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("layer"))
    by_segment = by_segment.filter((F.col("POLYFID") + position) % 6 != 0)
    everyone = customers.groupBy("POLYFID").agg(F.count("*").alias("species")).select(
        F.lit("ALL").alias("layer"), "POLYFID", "species")
    suppliers = table(spark, sf_dir, "supplier").groupBy(
        F.col("s_nationkey").cast("bigint").alias("POLYFID")).agg(F.count("*").alias("species")).select(
        F.lit("SUPPLIERS").alias("layer"), "POLYFID", "species")
    rich = everyone.filter("species % 2 = 0").select(F.lit("EVEN").alias("layer"), "POLYFID", "species")
    return by_segment.unionByName(everyone).unionByName(suppliers).unionByName(rich)


LAYERS = [*SEGMENTS, "ALL", "SUPPLIERS", "EVEN"]


def flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, an 'X' under every order priority the customer used."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("DataSet")).agg(*[
        F.max(F.when(F.col("o_orderpriority") == p, "X")).alias(f"flag_{i}")
        for i, p in enumerate(PRIORITIES, 1)
    ])


FLAGS = [f"flag_{i}" for i in range(1, len(PRIORITIES) + 1)]


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric columns per diet."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("DataSet")).agg(
        F.avg("l_discount").alias("Temp"),
        F.avg("l_tax").alias("Seasonality"),
        F.avg("l_quantity").alias("AnnPrecip"),
        F.avg("l_extendedprice").alias("PrecipSeason"),
    )


def posterior_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide draws, one row per customer: a slope and an intercept per order level."""
    c = table(spark, sf_dir, "customer")
    columns = [F.col("c_custkey").alias("draw")]
    for k in (1, 2, 3, 4):
        columns.append((-(F.col("c_custkey") % (10 + k)) / 20.0).alias(f"orders{k}"))
        columns.append((F.col("c_acctbal") / (1000.0 * k)).alias(f"Intercept{k}"))
    return c.select(*columns)


def clearance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published predator masses and attack rates."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record"),
        F.col("p_retailprice").alias("PredatorMass"),
        (F.col("p_size") / 10.0).alias("Fitted_a"),
    )
