"""Ranks, running sums and totals inside groups, for groups of any size.

A window partitioned by the group sorts one group in one task.  That is right
for groups up to ``HOT_ROWS`` rows (the sort spills), and wrong for a group
that holds a third of the table.  ``ordered_scan`` reads its input once, into a
stage that counts its rows.  Where all of them fit one window, rank, running
sums and totals come out of one shuffle and one sort.  Otherwise one
map-side-combined aggregate over the stage gives sizes and totals, and the
larger groups are scanned in chunks:

1. the rows of the hot groups are range-partitioned by (group, order), so that
   a chunk is a contiguous piece of one sorted group,
2. each chunk is summed, and a prefix over the few chunk totals of a group
   gives what lies before each chunk,
3. rank and running sums inside a chunk plus that offset are the answer.

Rows without groups are always scanned in chunks, so no window is without
partition keys.  Chunk numbers come from the physical layout and are frozen in
the shared checkpoint folder before anything is derived from them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.skew import HOT_ROWS, sized_join
from tallyframe.session import cut_lineage, measured_stage, stage_size

CHUNK_ROWS = 1_000_000
# Chunk totals of rows without groups pass through the driver; beyond this many the chunks grow.
MAX_CHUNKS = 50_000


@dataclass(frozen=True)
class Scan:
    """One ordering: ``order`` names columns, a leading '-' means descending.

    ``running`` maps output name -> summed column; sums include the own row.
    """

    order: Sequence[str]
    rank: str | None = None
    running: Mapping[str, str] = field(default_factory=dict)

    def sort_keys(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]


def ordered_scan(df: DataFrame, group: Sequence[str], scans: Sequence[Scan], hot_rows: int = HOT_ROWS,
                 chunk_rows: int = CHUNK_ROWS, totals: Mapping[str, str] | None = None,
                 named_only: bool = False) -> DataFrame:
    """Add the rank and running-sum columns of every scan, and group sums.

    ``totals`` maps output name -> summed column.  ``df`` is read once; every
    column of it is staged, so select what is needed first.  Rows without a
    group value are a group like any other, or left out by ``named_only``; an
    empty table gives an empty result; identical rows get different ranks.
    """
    group, totals = list(group), dict(totals or {})
    if totals and not group:
        raise ValueError("totals are sums of groups")
    rows = measured_stage(df)
    count, _ = stage_size(rows)
    if not group:
        return _scan_chunks(rows, group, scans, count, chunk_rows)
    if named_only:
        rows = rows.filter(reduce(and_, [F.col(g).isNotNull() for g in group]))
    if count <= hot_rows:
        return _scan_windows(rows, group, scans, totals)
    sizes = rows.groupBy(*[F.col(g).alias(f"_key_{g}") for g in group]).agg(
        F.count("*").alias("_rows"), *[F.sum(column).alias(name) for name, column in totals.items()])
    # At most count / hot_rows groups, whatever the data.
    keys = cut_lineage(sizes.filter(F.col("_rows") > hot_rows))
    hot_count = keys.agg(F.sum("_rows")).first()[0]
    if not hot_count:
        return _scan_windows(rows, group, scans, totals)
    # A hot group may be the one without a name.
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_key_{g}")) for g in group])
    cold = _scan_windows(rows.join(F.broadcast(keys), same, "left_anti"), group, scans, totals)
    hot = rows.join(F.broadcast(keys), same).drop("_rows", *[f"_key_{g}" for g in group])
    return cold.unionByName(_scan_chunks(hot, group, scans, hot_count, chunk_rows).select(*cold.columns))


def group_totals(df: DataFrame, group: Sequence[str], totals: Mapping[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Group sums next to each row that has a group, in one reading; see :func:`ordered_scan`."""
    return ordered_scan(df, group, [], hot_rows, totals=totals, named_only=True)


def _scan_windows(df: DataFrame, group: list[str], scans: Sequence[Scan], totals: Mapping[str, str]) -> DataFrame:
    every, first = Window.unboundedPreceding, Window.currentRow
    out = {}
    for scan in scans:
        window = Window.partitionBy(*group).orderBy(*scan.sort_keys())
        if scan.rank:
            out[scan.rank] = F.row_number().over(window).cast("bigint")
        rows = window.rowsBetween(every, first)
        for name, column in scan.running.items():
            out[name] = F.sum(column).over(rows)
    # The order of the first scan, so that totals need no sort of their own.
    whole = Window.partitionBy(*group)
    if scans:
        whole = whole.orderBy(*scans[0].sort_keys()).rowsBetween(every, Window.unboundedFollowing)
    for name, column in totals.items():
        out[name] = F.sum(column).over(whole)
    return df.withColumns(out)


def _scan_chunks(df: DataFrame, group: list[str], scans: Sequence[Scan], rows: int,
                 chunk_rows: int) -> DataFrame:
    chunks = min(MAX_CHUNKS, max(2, math.ceil(rows / chunk_rows)))
    # Identical rows can only be split between chunks by an id of their own.  It is the place in the files
    # of a stage, and is frozen together with the first chunk numbers.
    out = df.withColumn("_row", F.monotonically_increasing_id()) if scans else df
    for scan in scans:
        keys = [*[F.col(g) for g in group], *scan.sort_keys(), F.col("_row")]
        out = cut_lineage(
            out.repartitionByRange(chunks, *keys).withColumn("_chunk", F.spark_partition_id()))
        sums = {f"_before_{name}": F.sum(column) for name, column in scan.running.items()}
        totals = out.groupBy(*group, "_chunk").agg(
            F.count("*").alias("_before"), *[s.alias(name) for name, s in sums.items()])
        offsets = _before(totals, group, ["_before", *sums])
        inside = Window.partitionBy(*group, "_chunk").orderBy(*scan.sort_keys(), "_row")
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = {"_in_rank": F.row_number().over(inside)}
        columns |= {f"_sum_{name}": F.sum(c).over(upto) for name, c in scan.running.items()}
        named = offsets.withColumnsRenamed({c: f"_key_{c}" for c in [*group, "_chunk"]})
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in [*group, "_chunk"]])
        out = out.withColumns(columns).join(named, same).drop(*[f"_key_{c}" for c in [*group, "_chunk"]])
        added = {}
        if scan.rank:
            added[scan.rank] = (F.col("_in_rank") + F.col("_before")).cast("bigint")
        for name in scan.running:
            # Sums before the first known value are NULL, as in a window.
            before, here = F.col(f"_before_{name}"), F.col(f"_sum_{name}")
            added[name] = F.coalesce(here + before, here, before)
        out = out.withColumns(added).drop("_chunk", "_before", *columns, *sums)
    return out.drop("_row")


def _before(totals: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """What lies before each chunk of its group; NULL sums where nothing known does."""
    if group:
        # One row per chunk: as many rows per group as the group has chunks.
        earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*group, "_chunk", *[
            (F.coalesce(F.sum(n).over(earlier), F.lit(0)) if n == "_before" else F.sum(n).over(earlier)).alias(n)
            for n in names])
    # At most MAX_CHUNKS rows.
    sums, out = {name: None for name in names} | {"_before": 0}, []
    for row in sorted(totals.collect(), key=lambda r: r["_chunk"]):
        out.append((row["_chunk"], *[sums[n] for n in names]))
        for n in names:
            sums[n] = row[n] if sums[n] is None else sums[n] if row[n] is None else sums[n] + row[n]
    spark, schema = totals.sparkSession, totals.select("_chunk", *names).schema
    for field in schema.fields:
        field.nullable = True
    return F.broadcast(spark.createDataFrame(out, schema))


def grouped_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median",
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per group: the mean of the one or two middle rows by rank."""
    group = list(group)
    rows = df.filter(F.col(value).isNotNull()).select(*group, value)
    ranked = ordered_scan(rows, group, [Scan([value], rank="_rank")], hot_rows)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    joined = sized_join(ranked, sizes, group) if group else ranked.withColumn("_n", sizes.select("_n").scalar())
    middle = (2 * F.col("_rank") >= F.col("_n")) & (2 * F.col("_rank") <= F.col("_n") + 2)
    return joined.filter(middle).groupBy(*group).agg(F.avg(value).alias(out))
