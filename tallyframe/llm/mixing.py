"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target over
source size.  Its whole part is taken; the fractions are rounded in pairs: words
move from one document of a pair to the other, at random but fair to both, until
one of them is whole.  The words of the pair stay the same, so a source's total
moves only when its last fraction is rounded.  Blocks of a source are rounded side
by side; each leaves one fraction, and these are rounded again in a reduction
tree until each source has one left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import staged
from tallyframe.operators.skew import sized_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK_ROWS = 4_000
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and keeps a null apart from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """(key, rank, documents, source_size, target) per source.

    Sources rank by code point, null last, and take the weights in turn.  Targets
    are weight times one level, at most ``cap`` times the source; the level rises
    until ``share`` of all words is given out.  Ranks come from a range-partitioned
    sort, so any number of sources will do.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = F.asc_nulls_last("source")
    ordered = staged(totals.repartitionByRange(order).sortWithinPartitions(order).select(
        "*", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos")), "sources")
    # One row per partition of the sort.
    before = [(part, n) for part, n in sorted(ordered.groupBy("part").count().collect())]
    offsets = {part: sum(n for other, n in before if other < part) for part, _ in before}
    spark = sized.sparkSession
    shifts = spark.createDataFrame([(int(k), int(v)) for k, v in offsets.items()], "part int, shift long")
    rank = F.col("pos") + F.col("shift")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = staged(ordered.join(F.broadcast(shifts), "part").select(
        source_key(F.col("source")).alias("key"), rank.alias("rank"), "documents", "source_size", weight.alias("weight")),
        "ranked")
    top = F.col("source_size") * cap
    wanted = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while wanted:
        full = top <= level * F.col("weight")
        given, open_weight = ranked.agg(F.sum(F.when(full, top).otherwise(0.0)), F.sum(
            F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (wanted - given) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    target = F.least(top, F.col("weight") * max(level, 0.0))
    return ranked.select("key", "rank", "documents", "source_size", target.cast("double").alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round fractions in place of each other; at most one stays fractional, sum(p * size) stays."""
    p = p.copy()
    chance = rng.random(len(p)).tolist()
    values, sizes = p.tolist(), size.astype(float).tolist()
    left = -1
    for right in range(len(values)):
        q = values[right]
        if not 1e-9 < q < 1 - 1e-9:
            values[right] = float(round(q))
            continue
        if left < 0:
            left = right
            continue
        a, ratio = values[left], sizes[left] / sizes[right]
        up, down = min(1 - a, q / ratio), min(a, (1 - q) / ratio)
        move = up if chance[right] * (up + down) < down else -down
        values[left], values[right] = a + move, q - move * ratio
        for at in (left, right):
            if min(values[at], 1 - values[at]) < 1e-9:
                values[at] = float(round(values[at]))
        if 0 < values[right] < 1:
            left = right if values[left] in (0.0, 1.0) else left
        elif values[left] in (0.0, 1.0):
            left = -1
    return np.array(values)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies and taken words.

    Sizes are words; a null or empty text has none and takes none.  A null source
    is a source of its own, ranked last.  Rows with one id or equal texts are rows
    of their own.  Blocks and chances come from hashes of id and text, so reruns
    agree whatever the partitions (rows alike in both are interchangeable).  Other
    columns are not looked at; an empty table gives an empty result.
    """
    sized = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")), "sized")
    targets = source_targets(sized, weights, share, cap)
    keyed = sized_join(sized.withColumn("key", source_key(F.col("source"))), targets, ["key"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(rate + 1e-12), F.lit(int(cap)))
    keyed = staged(keyed.select(
        "doc_id", "source", "size", "h", "rank", "source_size", "target", whole.alias("whole"),
        F.greatest(rate - whole, F.lit(0.0)).alias("p"),
        F.ceil(F.col("documents") / block_rows).cast("long").alias("blocks")), "fractions")
    fraction = (F.col("size") > 0) & (F.col("p") > 1e-9)
    rows = keyed.withColumn("block", F.pmod("h", "blocks"))
    done, open_ = [rows.filter(~fraction).withColumn("p", F.lit(0.0))], rows.filter(fraction)
    level = 0
    while True:
        step = level

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["h", "size", "p"], kind="stable", ignore_index=True)
            rank, block, blocks = (int(frame[c].iloc[0]) for c in ("rank", "block", "blocks"))
            rng = np.random.default_rng([seed, step, rank, block])
            p = pivot(frame["p"].to_numpy(), frame["size"].to_numpy(), rng)
            if blocks == 1:
                last = (p > 0) & (p < 1)
                p[last] = np.rint(p[last])  # nearest: a source ends within half a text of its target
            return frame.assign(p=p, block=block // FAN_IN, blocks=-(-blocks // FAN_IN))

        rounded = staged(open_.groupBy("rank", "block").applyInPandas(run, rows.schema), "rounded")
        settled = F.col("p").isin(0.0, 1.0)
        done.append(rounded.filter(settled))
        open_, level = rounded.filter(~settled), level + 1
        if open_.isEmpty():
            break
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("long")
    return result.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))
