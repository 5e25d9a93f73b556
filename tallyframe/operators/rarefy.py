"""Rarefaction: repeated samples of fixed size from each group.

A draw is the first item whose cumulative share exceeds a uniform number, with
the items in descending order of count.  The random number is a hash of (group,
seed, replicate, draw), so every run and every engine draws the same sample.

The abundance spectrum of a group fixes its samples: the block a draw falls
into and the place inside the block give the rank of the item.  So each group
brings at most sqrt(2N) rows to its task, and the draws themselves are never
shuffled.

``rarefied_metrics`` and its kin make every draw, so that another engine can
repeat them.  ``sampled_metrics`` and ``sampled_frequencies`` draw the counts of a
sample themselves (a multinomial, by conditional binomials): their work follows
the items met and no longer the size of the sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.composition import COUNT, GROUP, ITEM, entropy_of, ranked_spectrum
from tallyframe.operators.ranks import rank_abundance
from tallyframe.session import measured_stage, spread

# Cells of one matrix of drawn counts.
CELLS = 1 << 21
_ARROW = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(),
          T.ArrayType(T.IntegerType()): pa.list_(pa.int32())}

# The columns of a ranked spectrum by name.
Block = Mapping[str, np.ndarray]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash (multiply and xor-shift), in place."""
    # The multipliers of a published 32-bit mixer.
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def uniform(key: object, seed: int, size: int) -> np.ndarray:
    """``size`` numbers in [0, 1) with 52 bits each, a function of key and seed."""
    digest = hashlib.md5(f"{key}|{seed}".encode()).hexdigest()
    a, b = (np.uint32(int(digest[i:i + 8], 16)) for i in (0, 8))
    index = np.arange(size, dtype=np.uint64).astype(np.uint32)
    high = _mix(_mix(index + a) + b)
    low = _mix(_mix(index + b) + a)
    bits = (high >> np.uint32(6)) * np.float64(1 << 26)
    bits += low >> np.uint32(6)
    bits /= 4503599627370496.0
    return bits


def _ordered(block: Block, *names: str) -> list[np.ndarray]:
    """Columns of a spectrum by descending count."""
    order = np.argsort(np.asarray(block["count_before"]), kind="stable")
    return [np.asarray(block[name])[order] for name in names]


def draw_ranks(block: Block, key: object, count: str, m: int, reps: int, seed: int) -> np.ndarray:
    """Ranks drawn from one group, one row per replicate."""
    names = ("count_before", count, "n_items", "items_before", "total")
    before, sizes, items, first, totals = (c.astype(np.int64) for c in _ordered(block, *names))
    total = int(totals[0])
    position = np.floor(uniform(key, seed, m * reps) * total).astype(np.int64)
    ends = np.cumsum(sizes * items)
    if 0 < total <= min(4 * m * reps, ends[-1]) and (ends - sizes * items == before).all():
        # The rank of every individual: no more of them than a few per draw.
        ranks = np.repeat(np.arange(1, items.sum() + 1), np.repeat(sizes, items))[position]
    else:
        at = np.searchsorted(before, position, side="right") - 1
        ranks = first[at] + (position - before[at]) // sizes[at] + 1
    return ranks.reshape(reps, m)


def _drawable(items: DataFrame, group: str, count: str) -> DataFrame:
    """Ranked spectra of the groups whose counts are all known."""
    return ranked_spectrum(items, group, count).filter("unknown = 0")


def _per_group(blocks: DataFrame, group: str, count: str, fields: dict[str, T.DataType], rows) -> DataFrame:
    """Run ``rows(key, spectrum)``, which returns columns, once per group; the key is added to its result."""
    # Zero counts are never drawn.
    blocks = blocks.filter(F.col(count) > 0).select(group, count, "n_items", "items_before", "count_before", "total")
    out = T.StructType([T.StructField(group, blocks.schema[group].dataType),
                        *[T.StructField(name, type_) for name, type_ in fields.items()]])

    # What the samples of rows without a group are keyed by.
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    nameless = np.nan if isinstance(out[group].dataType, numbers) else None

    def run(key, table):
        name = key[0].as_py() if key[0].is_valid else nameless
        found = rows(name, {c: table.column(c).to_numpy() for c in table.column_names if c != group})
        columns = [pa.array(found[name], _ARROW[type_]) for name, type_ in fields.items()]
        return pa.Table.from_arrays([pa.repeat(key[0], len(columns[0])), *columns], out.names)

    return spread(blocks, group).groupBy(group).applyInArrow(run, out)


def rarefy(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1, group: str = GROUP,
           item: str = ITEM, count: str = COUNT) -> DataFrame:
    """(group, rep, draw, rank, item): the drawn individuals in long form.

    Each rank met goes to its item with the list of its draws, so the individuals are rows only behind the join.
    """
    def rows(key, block):
        ranks = draw_ranks(block, key, count, m, reps, seed).ravel()
        order = np.argsort(ranks, kind="stable")
        met, first = np.unique(ranks[order], return_index=True)
        ends = pa.array(np.append(first, len(order)), pa.int32())
        return {"rank": met, "draws": pa.ListArray.from_arrays(ends, pa.array(order, pa.int32()))}

    items = measured_stage(items.select(group, item, count))
    drawn = _per_group(_drawable(items, group, count), group, count,
                       {"rank": T.LongType(), "draws": T.ArrayType(T.IntegerType())}, rows)
    named = drawn.join(rank_abundance(items, group, item, count).select(group, "rank", item), [group, "rank"])
    at = F.col("at")
    return named.select(group, "rank", item, F.explode("draws").alias("at")).select(
        group, "rank", (F.floor(at / m) + 1).cast("int").alias("rep"), (at % m + 1).cast("int").alias("draw"), item)


def _tally(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(replicate index, rank, times drawn), sorted by replicate and rank."""
    reps, m = ranks.shape
    span = int(ranks.max()) + 1
    keys = (np.arange(reps)[:, None] * span + ranks).ravel()
    if span <= 8 * m:
        # Few cells to a draw: counted without a sort.
        table = np.bincount(keys, minlength=reps * span).reshape(reps, span)
        rep, rank = np.nonzero(table)
        return rep, rank, table[rep, rank]
    keys, n = np.unique(keys, return_counts=True)
    return keys // span, keys % span, n


def frequency_table(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1,
                    group: str = GROUP, count: str = COUNT) -> DataFrame:
    """(group, rep, rank, n): how often each item occurs in each sample."""
    def rows(key, block):
        rep, rank, n = _tally(draw_ranks(block, key, count, m, reps, seed))
        return {"rep": rep + 1, "rank": rank, "n": n}

    return _per_group(
        _drawable(items, group, count), group, count, {"rep": T.IntegerType(), "rank": T.LongType(), "n": T.IntegerType()}, rows)


def rarefied_metrics(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1,
                     group: str = GROUP, count: str = COUNT, fill: float | None = None) -> DataFrame:
    """Mean richness, mean entropy and highest top frequency over the replicates.

    Groups with an unknown count get NULL, or ``fill``.
    """
    metrics = rarefied_metrics_from(_drawable(items, group, count), m, reps, seed, group, count)
    out = items.select(group).distinct().join(metrics, group, "left")
    return out if fill is None else out.na.fill(fill)


def rarefied_metrics_from(blocks: DataFrame, m: int = 100, reps: int = 200, seed: int = 1,
                          group: str = GROUP, count: str = COUNT) -> DataFrame:
    """The same from the ranked spectrum of groups whose counts are all known."""
    def rows(key, block):
        rep, _, n = _tally(draw_ranks(block, key, count, m, reps, seed))
        entropy = np.log(m) - np.bincount(rep, n * np.log(n)) / m
        return {"rare_richness": [len(rep) / reps], "rare_entropy": [entropy.mean()], "rare_top_frequency": [n.max() / m]}

    names = ("rare_richness", "rare_entropy", "rare_top_frequency")
    return _per_group(blocks, group, count, {n: T.DoubleType() for n in names}, rows)


def sampled_counts(block: Block, key: object, count: str, m: int, reps: int, seed: int):
    """Yield (replicate index, rank, times drawn) arrays that together are ``reps`` samples of ``m``.

    The counts of a sample are multinomial.  The draws that fall into each block of
    equal counts come first, one binomial per block given the blocks before; the draws
    of a block are then divided among its items, which are alike: by binomials again
    where it has fewer items than draws, else by choosing an item for each draw.  A
    sample so costs at most the smaller of its items and its draws, whatever ``m`` is.

    The generator is counter-based and keyed by (key, seed); the samples depend on the
    spectrum, the key and the seed only.
    """
    share, items, before = _ordered(block, count, "n_items", "items_before")
    items, before = items.astype(np.int64), before.astype(np.int64)
    rng = np.random.Generator(np.random.Philox(
        key=int(hashlib.md5(f"{key}|{seed}".encode()).hexdigest(), 16)))
    share = share.astype(np.float64) * items
    share /= share.sum()
    rows = max(1, CELLS // len(items))
    for first in range(0, reps, rows):
        inside = rng.multinomial(m, share, size=min(rows, reps - first))
        for b in np.flatnonzero(inside.any(axis=0)):
            for rep, item, n in _divide(rng, inside[:, b], int(items[b])):
                yield rep + first, item + before[b] + 1, n


def _divide(rng: np.random.Generator, draws: np.ndarray, items: int):
    """Divide each number of draws among ``items`` alike items, in bounded pieces."""
    if items > CELLS:
        pieces = -(-items // CELLS)
        sizes = np.full(pieces, items // pieces)
        sizes[:items % pieces] += 1
        table = rng.multinomial(draws, sizes / items)
        for p, offset in enumerate(np.cumsum(sizes) - sizes):
            if table[:, p].any():
                for rep, item, n in _divide(rng, table[:, p], int(sizes[p])):
                    yield rep, item + offset, n
        return
    if items == 1:
        rep = np.flatnonzero(draws)
        yield rep, np.zeros(len(rep), np.int64), draws[rep]
        return
    dense = items <= draws.max()
    # A row's cells are its items, or its draws where they are fewer: at most CELLS, and one row is the least
    # that a piece can hold.
    ends = np.cumsum(np.maximum(1, np.full(len(draws), items) if dense else draws))
    start = 0
    while start < len(draws):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + CELLS, side="right")))
        part = draws[start:end]
        if dense:
            table = rng.multinomial(part, np.full(items, 1.0 / items))
            rep, item = np.nonzero(table)
            yield rep + start, item, table[rep, item]
        else:
            owner = np.repeat(np.arange(len(part)), part)
            cells, n = np.unique(owner * items + rng.integers(0, items, len(owner)), return_counts=True)
            yield cells // items + start, cells % items, n
        start = end


def sampled_frequencies(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1,
                        group: str = GROUP, count: str = COUNT) -> DataFrame:
    """(group, rep, rank, n) of multinomial samples: the form of :func:`frequency_table`, for samples of any size.

    Ranks number the items by descending count.  Groups with an unknown count, or
    without a positive one, have no rows.
    """
    def rows(key, block):
        rep, rank, n = (np.concatenate(x) for x in zip(*sampled_counts(block, key, count, m, reps, seed)))
        return {"rep": rep + 1, "rank": rank, "n": n}

    fields = {"rep": T.IntegerType(), "rank": T.LongType(), "n": T.LongType()}
    return _per_group(_drawable(items, group, count), group, count, fields, rows)


def sampled_metrics(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1, group: str = GROUP,
                    count: str = COUNT) -> DataFrame:
    """Mean richness, mean entropy and highest top frequency over multinomial samples of any size.

    The quantities of :func:`rarefied_metrics` from other samples of the same law.
    Groups with an unknown count, or without a positive one, get NULL, and so do rows without a group.
    """
    def rows(key, block):
        richness, n_ln_n, top = np.zeros(reps), np.zeros(reps), 0
        for rep, _, n in sampled_counts(block, key, count, m, reps, seed):
            richness += np.bincount(rep, minlength=reps)
            n_ln_n += np.bincount(rep, n * np.log(n), minlength=reps)
            top = max(top, int(n.max(initial=0)))
        return {"rare_richness": [richness.mean()], "rare_entropy": [(np.log(m) - n_ln_n / m).mean()],
                "rare_top_frequency": [top / m]}

    names = ("rare_richness", "rare_entropy", "rare_top_frequency")
    metrics = _per_group(_drawable(items, group, count), group, count, {n: T.DoubleType() for n in names}, rows)
    return items.select(group).distinct().join(metrics, group, "left")


def expected_rarefied_richness(items: DataFrame, m: int = 100, group: str = GROUP,
                               count: str = COUNT) -> DataFrame:
    """Closed form of the mean richness: sum of 1 - (1 - f)^m."""
    f = F.col(count) / F.col("total")
    return _drawable(items, group, count).filter(F.col(count) > 0).groupBy(group).agg(
        F.sum(F.col("n_items") * (1 - F.pow(1 - f, F.lit(float(m))))).alias("expected_richness"))


def rarefaction_effect(items: DataFrame, m: int = 100, reps: int = 200, seed: int = 1,
                       group: str = GROUP, count: str = COUNT) -> DataFrame:
    """Richness and entropy of each group before and after rarefying."""
    raw = items.groupBy(group).agg(F.count("*").alias("richness"), entropy_of(count).alias("entropy"))
    rare = rarefied_metrics(items, m, reps, seed, group, count)
    return raw.join(rare.select(group, "rare_richness", "rare_entropy"), group)
