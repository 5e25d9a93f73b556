"""Row filters, name clean-up and category codes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import flag_count
from tallyframe.operators.scan import HOT_ROWS, Scan, ordered_scan
from tallyframe.operators.skew import sized_join
from tallyframe.session import cut_lineage

# Renames of the diet table to the names of the phylogeny.
DIET_RENAMES = {
    "Aquila_fasciata": "Aquila_fasciatus",
    "Bubo_scandiacus": "Bubo_scandiaca",
    "Buteogallus_coronatus": "Harpyhaliaetus_coronatus",
    "Circus_hudsonius": "Circus_cyaneus",
    "Clanga_clanga": "Aquila_clanga",
    "Geranoaetus_polyosoma": "Buteo_polyosoma",
    "Glaucidium_nana": "Glaucidium_brasilianum",
    "Ictinaetus_malaiensis": "Ictinaetus_malayensis",
    "Rupornis_magnirostris": "Buteo_magnirostris",
}
# Renames of the trait table to the names of the diet table.
TRAIT_RENAMES = {
    "Clanga_clanga": "Aquila_clanga",
    "Aquila_fasciata": "Aquila_fasciatus",
    "Bubo_scandiacus": "Bubo_scandiaca",
    "Rupornis_magnirostris": "Buteo_magnirostris",
    "Geranoaetus_polyosoma": "Buteo_polyosoma",
    "Buteogallus_coronatus": "Harpyhaliaetus_coronatus",
    "Ictinaetus_malaiensis": "Ictinaetus_malayensis",
}


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def exclude_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Drop rows with one of the values; rows with NULL stay."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(list(values)))


def keep_id_levels(df: DataFrame, levels: Sequence[str] = ("Species", "Genus"),
                   column: str = "IDLevel") -> DataFrame:
    return df.filter(F.col(column).isin(list(levels)))


def contains_filter(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-sensitive substring."""
    return df.filter(F.col(column).contains(text))


def thresholds(df: DataFrame, above: Mapping[str, float] | None = None,
               nonzero: Sequence[str] = ()) -> DataFrame:
    """Keep rows above every limit and different from zero in every column."""
    condition: Column = F.lit(True)
    for column, limit in (above or {}).items():
        condition = condition & (F.col(column) > limit)
    for column in nonzero:
        condition = condition & (F.col(column) != 0)
    return df.filter(condition)


def count_flags(df: DataFrame, columns: Sequence[str], mark: str = "X", out: str = "NumHabs") -> DataFrame:
    return df.withColumn(out, flag_count(columns, mark))


def remap_names(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace names by a synonym table, one step only.

    A dict is a short fixed list and becomes a literal map.  A DataFrame with
    columns ``old`` and ``new`` is joined; of several ``new`` for one ``old`` the
    first by sort counts.
    """
    if isinstance(mapping, DataFrame):
        synonyms = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias("_new"))
        joined = sized_join(df, synonyms, [column], "left")
        return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(literal, F.col(column)), F.col(column)))


def level_codes(df: DataFrame, column: str, levels: Sequence[str] | None = None,
                out: str = "level", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Integer code from 1 per category: by the given levels, else in sorted order.

    Values outside the given levels get NULL.  Sorted codes are ranks over the
    distinct values only.
    """
    if levels is not None:
        position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
        return df.withColumn(out, F.nullif(position, F.lit(0)).cast("bigint"))
    return code_columns(df, {out: column}, hot_rows)


def code_columns(df: DataFrame, columns: Mapping[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Codes from 1 in sorted order for several columns at once; ``columns`` maps output -> column.

    ``df`` is read once.  The distinct values of all columns of one type are found
    and ranked together, with the column as their group.  NULL gets NULL.
    """
    rows = cut_lineage(df)
    kinds: dict[str, list[str]] = {}
    for out, column in columns.items():
        kinds.setdefault(df.schema[column].dataType.simpleString(), []).append(out)
    for outs in kinds.values():
        pairs = rows.select(F.explode(F.array(*[
            F.struct(F.lit(out).alias("_out"), F.col(columns[out]).alias("_value")) for out in outs
        ])).alias("_pair")).select("_pair.*").filter(F.col("_value").isNotNull()).distinct()
        codes = cut_lineage(ordered_scan(pairs, ["_out"], [Scan(["_value"], rank="_code")], hot_rows))
        for out in outs:
            one = codes.filter(F.col("_out") == out).select(
                F.col("_value").alias(columns[out]), F.col("_code").alias(out))
            rows = sized_join(rows, one, [columns[out]], "left")
    return rows.select(*df.columns, *columns)
