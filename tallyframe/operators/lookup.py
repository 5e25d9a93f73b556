"""Joins that bring traits, cells and results to a table.

A look-up table is broadcast when it is counted and found small, and shuffled
with salts for hot names when it is not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import genus_label
from tallyframe.operators.skew import sized_join


def reduce_duplicates(trait: DataFrame, key: str, columns: Sequence[str], on_dup: str = "first",
                      order: str | None = None) -> DataFrame:
    """One row per key: the ``first`` by ``order``, the ``mean``, or checked ``unique``."""
    if on_dup == "mean":
        aggs = [F.avg(c).alias(c) for c in columns]
    elif on_dup == "first":
        if order is None:
            raise ValueError("on_dup='first' needs an order column")
        # Missing values give way to the next record, as an empty match does.
        aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    elif on_dup == "unique":
        single = F.assert_true(F.count("*") == 1, F.concat(F.lit("duplicate key: "), F.max(key).cast("string")))
        aggs = [F.when(single.isNull(), F.max(c)).alias(c) for c in columns]
    else:
        raise ValueError(f"unknown duplicate policy {on_dup!r}")
    return trait.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def lookup(df: DataFrame, trait: DataFrame, left_key: str, right_key: str, columns: Mapping[str, str],
           on_dup: str = "unique", order: str | None = None) -> DataFrame:
    """Exact-name left look-up; ``columns`` maps trait column -> output column."""
    reduced = reduce_duplicates(trait, right_key, list(columns), on_dup, order)
    renamed = reduced.select(
        F.col(right_key).alias(left_key), *[F.col(c).alias(out) for c, out in columns.items()])
    return sized_join(df, renamed, [left_key], "left").select(*df.columns, *columns.values())


def lookup_chain(df: DataFrame, left_key: str, sources: Sequence[tuple[DataFrame, str, str]],
                 out: str) -> DataFrame:
    """Several (table, key, value) sources; the last one with a value wins.

    Keys must be unique in each source.
    """
    stacked = None
    for i, (trait, key, value) in enumerate(sources):
        reduced = reduce_duplicates(trait, key, [value], "unique")
        part = reduced.select(F.col(key).alias(left_key), F.lit(i).alias("_at"), F.col(value).alias("_value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    # The sources become one table, so the rows are joined once.
    best = stacked.filter(F.col("_value").isNotNull()).groupBy(left_key).agg(F.max_by("_value", "_at").alias(out))
    return sized_join(df, best, [left_key], "left").select(*df.columns, out)


def genus_means(trait: DataFrame, genus: str = "Genus", value: str = "BodyMassValue") -> DataFrame:
    """Mean per genus under the label of a prey identified to genus."""
    means = trait.groupBy(genus).agg(F.avg(value).alias(value))
    return means.select(genus_label(genus).alias("label"), value)


def prey_mass(items: DataFrame, trait: DataFrame, item: str = "PreyScientificName") -> DataFrame:
    """Mass by species name, or by genus label for items identified to genus."""
    return lookup_chain(items, item, [
        (trait, "SciName", "BodyMassValue"),
        (genus_means(trait), "label", "BodyMassValue"),
    ], "PreyMass")


def cell_richness(cell_map: DataFrame, layers: DataFrame, names: Sequence[str],
                  key: str = "DataSet", cell: str = "POLYFID", fill: float | None = None) -> DataFrame:
    """Two hops: diet -> cell -> one richness column per layer.

    The layers are turned wide per cell first, so the diets are joined once.
    No cell or no entry gives NULL, or ``fill``.
    """
    wide = layers.filter(F.col(cell).isNotNull()).groupBy(cell).pivot("layer", list(names)).agg(F.max("species"))
    out = sized_join(cell_map.select(key, cell), wide, [cell], "left").select(key, *names)
    return out if fill is None else out.na.fill(fill, list(names))


def attach_meta(meta: DataFrame, *results: DataFrame, key: str = "DataSet") -> DataFrame:
    """Left-join per-diet results to the meta table by key."""
    for result in results:
        meta = meta.join(result, key, "left")
    return meta


def natural_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared column names."""
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return sized_join(a, b, shared)


def names_not_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct names of ``a`` without a row in ``b``."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def names_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct names of ``a`` with a row in ``b``."""
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_semi")


def cross_candidates(df: DataFrame, values: Sequence[float], out: str = "cand_h") -> DataFrame:
    """Every row once per candidate value, without a join."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(float(v)) for v in values])))
