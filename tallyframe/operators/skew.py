"""Joins whose left side is large and may hold one key in a large part of its rows.

``sized_join`` stages the right side (totals, a reduced look-up table), measures it while it is
written, and broadcasts it only when it has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes; the
left side is then not shuffled at all.  Where only the left side is that small, that one
is broadcast.  Anything larger goes through ``skew_join``.

``skew_join`` counts the left keys with one map-side-combined aggregate.  Keys
of more than ``HOT_ROWS`` rows get as many salts as they need, and the right
rows of those keys are repeated once per salt.  Rows with a NULL key match nothing and
are spread by their content.  The adaptive skew split of Spark does not reach such
joins, because their other side is an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage, measured_stage, stage_size

HOT_ROWS = 5_000_000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
NULL_SALTS = 4096


def is_small(df: DataFrame) -> bool:
    """At most BROADCAST_ROWS rows of at most BROADCAST_BYTES bytes."""
    rows, size = stage_size(df)
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on shared names with sides of unknown size."""
    right = measured_stage(right)
    if is_small(right):
        return left.join(F.broadcast(right), list(keys), how)
    if how == "inner":
        left = measured_stage(left)
        if is_small(left):
            return F.broadcast(left).join(right, list(keys), how)
    return skew_join(left, right, keys, how)


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              hot_rows: int | None = None) -> DataFrame:
    """Equi-join on shared names; ``how`` is inner or left.

    The salt of a row is the number of the partition it is read from: it spreads
    a hot key, and a task that runs again after a lost executor repeats it.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    limit = HOT_ROWS if hot_rows is None else hot_rows
    keys = list(keys)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_rows"))
    # At most rows / limit keys, whatever the data.
    hot = cut_lineage(counts.filter(F.col("_rows") > limit).select(
        *keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts")))
    if hot.isEmpty():
        return left.join(right, keys, how)

    def with_salts(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), keys, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(NULL_SALTS)).cast("int")
    salted = with_salts(left).withColumn("_salt", F.when(unknown, spread).otherwise(
        F.pmod(F.spark_partition_id(), F.col("_salts")))).drop("_salts")
    repeated = with_salts(right).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
