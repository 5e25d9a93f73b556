"""Move counts of items identified to genus onto the species of that genus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import genus_of
from tallyframe.operators.composition import COUNT, GROUP, ITEM
from tallyframe.operators.skew import sized_join
from tallyframe.session import cut_lineage, measured_stage

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# Windows handed on at a time.
WINDOWS = 1 << 18


def window_hashes(text: str, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the window at each place) for every length that fits; 64 bits, by code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(points) + 1, _BASE, np.uint64)) * np.uint64(_INVERSE)
    back = np.cumprod(np.full(len(points) + 1, _INVERSE, np.uint64)) * np.uint64(_BASE)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[:-1], dtype=np.uint64)])
    for n in lengths:
        if 0 < n <= len(points):
            # A window's terms carry the power of its place; that is divided out.
            yield n, (sums[n:] - sums[:-n]) * back[: len(sums) - n]


def _windows(df: DataFrame, column: str, lengths: Sequence[int] | None) -> DataFrame:
    """(column, at, len, hash): the windows of each text; only the whole text where no lengths are given."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for text in batch[column]:
                for n, hashes in window_hashes(text, [len(text)] if lengths is None else lengths):
                    held.append(pd.DataFrame({column: text, "at": np.arange(1, len(hashes) + 1, dtype=np.int32),
                                              "len": np.int32(n), "hash": hashes.view(np.int64)}))
                    size += len(hashes)
                    if size >= WINDOWS:
                        yield pd.concat(held)
                        held, size = [], 0
        if held:
            yield pd.concat(held)

    return df.select(column).mapInPandas(run, f"{column} string, at int, len int, hash bigint")


def genus_vocabulary(items: DataFrame, item: str = ITEM, level: str = "IDLevel") -> DataFrame:
    """(name, word): every distinct item name with the genus words it contains.

    The match is a case-sensitive substring anywhere in the name.  Names are not
    tested against words: the windows of each distinct name, of the lengths that
    occur among the words, are joined to the words by a rolling hash, and the
    text at that place is compared.  An empty word is in every name.
    """
    words = cut_lineage(items.filter(F.col(level) == "Genus").select(genus_of(item).alias("word")).filter("word IS NOT NULL").distinct())
    # At most as many as the longest word has characters.
    lengths = sorted(row[0] for row in words.select(F.length("word")).distinct().collect())
    names = items.select(F.col(item).alias("name")).filter("name IS NOT NULL").distinct()
    hashed = _windows(words, "word", None).select("word", "len", "hash")
    found = sized_join(_windows(names, "name", lengths), hashed, ["len", "hash"]).filter(
        F.expr("substring(name, at, len) = word")).select("name", "word").distinct()
    if 0 not in lengths:
        return found
    return found.unionByName(names.withColumn("word", F.lit("")))


def genus_matches(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                  level: str = "IDLevel") -> DataFrame:
    """(group, label, name): the items of the same group that contain the genus
    of a genus row and are not that row, with their counts and the genus total."""
    genus = items.filter(F.col(level) == "Genus").groupBy(group, F.col(item).alias("label")).agg(
        F.sum(count).alias("genus_count")).withColumn("word", genus_of("label"))
    present = items.groupBy(group, F.col(item).alias("name")).agg(F.sum(count).alias("name_count"))
    named = sized_join(present, genus_vocabulary(items, item, level), ["name"])
    return (
        sized_join(named, genus, [group, "word"])
        .filter(F.col("name") != F.col("label"))
        .select(group, "label", "name", "name_count", "genus_count")
    )


def redistribute_genus(items: DataFrame, group: str = GROUP, item: str = ITEM, count: str = COUNT,
                       level: str = "IDLevel") -> DataFrame:
    """Share the count of each genus row among the matching rows of its group.

    Shares are proportional to the counts of the matching rows and rounded half
    to even; the genus row then goes away.  A genus row without a matching row,
    or whose matching rows add up to zero, stays.  Genus rows with the same
    label are added up first and all genus rows are applied at once.
    """
    matches = cut_lineage(genus_matches(items, group, item, count, level))
    totals = measured_stage(matches.groupBy(group, "label").agg(F.sum("name_count").alias("label_total")).filter(
        F.col("label_total") > 0))
    # Rows of one name and count receive the same: one share per genus word in the name.
    given = sized_join(matches, totals, [group, "label"]).select(
        group, F.col("name").alias(item), F.col("genus_count").cast("double").alias("n"), "label_total")
    counts = items.select(group, item, count).filter(F.col(count).isNotNull()).distinct()
    share = F.bround(F.col("n") * F.col(count) / F.col("label_total"), 0).cast("bigint")
    gains = sized_join(counts, given, [group, item]).groupBy(group, item, count).agg(
        # A genus row of unknown count makes its species unknown.
        F.struct(F.when(F.count_if(share.isNull()) == 0, F.sum(share)).alias("n")).alias("_gain"))
    spent = totals.select(group, F.col("label").alias(item), F.lit(True).alias("_spent"))
    joined = sized_join(sized_join(items, gains, [group, item, count], "left"), spent, [group, item], "left")
    kept = joined.filter(~(F.coalesce("_spent", F.lit(False)) & (F.col(level) == "Genus")))
    gained = F.when(F.col("_gain").isNull(), F.lit(0)).otherwise(F.col("_gain.n"))
    return kept.withColumn(count, F.col(count) + gained).select(*items.columns)


def union_adjusted(original: DataFrame, adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Adjusted rows replace the rows with the same key; the others stay."""
    return original.join(adjusted.select(*keys), keys, "left_anti").unionByName(adjusted)
