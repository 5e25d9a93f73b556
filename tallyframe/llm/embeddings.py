"""Embedding near-dedup by collision counting on one-dimensional projections.

Two unit vectors at the least allowed cosine are close on any random direction,
two unrelated ones seldom are.  The first projections cut each label into cells: a
vector goes to both sides of a cut when it lies near it, so a linked pair shares a
cell with a chance that the margin sets.  In a cell the vectors are sorted by one
projection; around each vector a window is opened on each further projection, and
the windows another vector falls into are counted.  Pairs that reach the count
calibrated for the wanted recall are verified by their cosine.

Equal vectors are one row before any pair is looked at.  A pair that shares several
cells counts in the first of them only.  A cell larger than a task should hold is
split into blocks, and pairs of blocks are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import connected_components, staged
from tallyframe.llm.simhash import component_roots
from tallyframe.operators.skew import sized_join

MIN_COSINE = 0.98
RECALL = 0.999
PROJECTIONS = 24
CELL_ROWS = 1024
TASK_ROWS = 4096
#: Half widths, in standard deviations of the projected difference of a pair at the least cosine.
MARGIN, WINDOW, REACH = 1.5, 2.5, 4.5
_QUERIES = 256


def least_count(projections: int, recall: float) -> int:
    """The largest window count that a pair at the least cosine still reaches with chance ``recall``."""
    inside = erf(WINDOW / sqrt(2))
    missed, count = 1.0, projections
    while count > 0:
        missed -= comb(projections, count) * inside**count * (1 - inside) ** (projections - count)
        if missed <= 1 - recall:
            break
        count -= 1
    return count


def directions(dim: int, cuts: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions of the cuts and of the counted projections."""
    rng = np.random.default_rng([17, dim])
    return rng.standard_normal((64, dim))[:cuts].T, rng.standard_normal((projections, dim)).T


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked_pairs(unit: np.ndarray, left: np.ndarray, right: np.ndarray, min_cosine: float, recall: float,
                 projections: int, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows, one from ``left`` and one from ``right`` (masks), at the least cosine or above.

    A pair of two rows of both masks is returned once.  ``allowed(i, j)`` says
    which pairs belong to this cell.
    """
    spread = sqrt(2 - 2 * min_cosine)
    p = unit @ directions(unit.shape[1], 0, projections)[1]
    order = np.argsort(p[:, 0], kind="stable")
    p, unit, left, right = p[order], unit[order], left[order], right[order]
    need = least_count(projections, recall)
    both = left & right
    found_i, found_j = [], []
    others = np.flatnonzero(right)
    first = p[others, 0]
    queries = np.flatnonzero(left)
    for at in range(0, len(queries), _QUERIES):
        rows = queries[at:at + _QUERIES]
        a = np.searchsorted(first, p[rows[0], 0] - REACH * spread)
        b = np.searchsorted(first, p[rows[-1], 0] + REACH * spread, "right")
        cols = others[a:b]
        count = np.zeros((len(rows), len(cols)), np.int8)
        for k in range(projections):
            count += np.abs(p[rows, k][:, None] - p[cols, k][None, :]) <= WINDOW * spread
        i, j = np.nonzero(count >= need)
        i, j = rows[i], cols[j]
        once = (i < j) | ~(both[i] & both[j])
        once &= i != j
        i, j = i[once], j[once]
        for low in range(0, len(i), 1 << 17):
            x, y = i[low:low + (1 << 17)], j[low:low + (1 << 17)]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= min_cosine
            x, y = order[x[near]], order[y[near]]
            mine = allowed(x, y)
            found_i.append(x[mine])
            found_j.append(y[mine])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def _cells(classes: DataFrame, cuts: int, min_cosine: float) -> DataFrame:
    """A row per class and cell; bit d of ``low`` says that the row is (also) on the lower side of cut d."""
    margin = MARGIN * sqrt(2 - 2 * min_cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                p = _unit(_matrix(part.column("vec"), dim)) @ directions(dim, cuts, 1)[0]
                row, cell = np.arange(len(p)), np.zeros(len(p), np.int64)
                low = np.zeros(len(p), np.int64)
                for d in range(cuts):
                    low |= (p[:, d] < margin).astype(np.int64) << d
                    up, down = p[row, d] >= -margin, p[row, d] < margin
                    row, cell = (np.concatenate([row[down], row[up]]),
                                 np.concatenate([cell[down], cell[up] | (1 << d)]))
                for at in range(0, len(row), 4096):
                    some = row[at:at + 4096]
                    taken = part.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cell[at:at + 4096]), pa.array(low[some])],
                        [*taken.schema.names, "cell", "low"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{fields}, cell bigint, low bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 min_cosine: float = MIN_COSINE, recall: float = RECALL, projections: int = PROJECTIONS,
                 cell_rows: int = CELL_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id and kept (vec_id = component_id).

    Vectors of one label and length link at cosine ``min_cosine`` or more (double
    precision); no other pair does.  A null label, and a vector that is null, empty,
    zero or holds a null or non-finite component, links with nothing and is its own
    component.  Equal vectors of a label, also under one id, link with each other.  A
    null id counts like any other, its component is the smallest id that is not null
    (null if there is none) and it is not kept.  Other columns are not looked at.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    classes = staged(rows.filter(good).groupBy("label", "vec").agg(F.min("vec_id").alias("lo"), F.count("*").alias("n")).select(
        F.monotonically_increasing_id().alias("node"), "label", "vec", "lo", "n", F.size("vec").alias("dim")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # A cut leaves a little over half of a cell's rows on each side.
    cuts = 0
    while cuts < 62 and largest * 0.62**cuts > cell_rows:
        cuts += 1
    cells = staged(_cells(classes.select("node", "label", "vec", "n", "dim"), cuts, min_cosine), "cells")
    key = ["label", "dim", "cell"]
    large = cells.groupBy(*key).count().filter(F.col("count") > task_rows).select(
        *key, F.ceil(F.col("count") / task_rows).cast("int").alias("parts"))
    tasks = sized_join(cells, large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), "parts").cast("int")
    tasks = tasks.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def links(table: pa.Table) -> pa.Table:
        unit = _unit(_matrix(table.column("vec"), table.column("dim")[0].as_py()))
        cell, low = table.column("cell")[0].as_py(), table.column("low").to_numpy()
        own, a, b = table.column("own").to_numpy(), table.column("a")[0].as_py(), table.column("b")[0].as_py()
        i, j = linked_pairs(unit, own == a, own == b, min_cosine, recall, projections,
                            lambda x, y: (low[x] & low[y] & cell) == 0)
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        linked = np.zeros(len(node), np.int64)
        np.add.at(linked, i, n[j])
        np.add.at(linked, j, n[i])
        root = component_roots(np.arange(len(node)), i, j)
        at = np.flatnonzero(linked)
        return pa.table({"node": pa.array(node[at], pa.int64()), "linked": pa.array(linked[at], pa.int64()),
                         "root": pa.array(node[root[at]], pa.int64())})

    found = staged(tasks.groupBy(*key, "a", "b").applyInArrow(links, "node bigint, linked bigint, root bigint"), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    known = classes.select("node", "label", "vec", "lo", "n").join(linked, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("lo").alias("component_id"))
    known = known.join(ids, "root").select("label", "vec", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.filter(good).join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return joined.unionByName(alone).withColumn("kept", kept)
