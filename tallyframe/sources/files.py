"""Delimited and columnar files in, result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "csv",
               na: str | None = "NA") -> DataFrame:
    """Read a table with a declared schema; ``na`` is the text that means missing."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
        if na is not None:
            reader = reader.option("nullValue", na)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def read_richness_layers(spark: SparkSession, layers: Mapping[str, str],
                         schema: str = "POLYFID INT, species INT") -> DataFrame:
    """Stack one (cell, species) file per taxon layer into (layer, cell, species)."""
    parts = [
        read_table(spark, path, schema).withColumn("layer", F.lit(layer))
        for layer, path in layers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_sheet_export(spark: SparkSession, path: str, schema: str | T.StructType,
                      columns: Mapping[str, str]) -> DataFrame:
    """Read the export of a spreadsheet and keep columns by name.

    ``columns`` maps sheet name -> output name.  Spark reads no workbooks, so
    the sheet is exported to a delimited file first.
    """
    return select_as(read_table(spark, path, schema), columns)


def select_as(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Column subset, with the output names when a mapping is given."""
    if isinstance(columns, Mapping):
        return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])
    return df.select(*columns)


def parse_na(df: DataFrame, column: str, out: str | None = None, na: str = "NA",
             type_: str = "bigint") -> DataFrame:
    """Drop rows where ``column`` is missing, then parse it; ``na`` becomes NULL."""
    parsed = F.nullif(F.col(column), F.lit(na)).try_cast(type_)
    return df.na.drop(subset=[column]).withColumn(out or column, parsed)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a result table and return its path."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def reload_stage(spark: SparkSession, path: str) -> DataFrame:
    """Continue from a stage written as parquet."""
    return spark.read.parquet(path)
