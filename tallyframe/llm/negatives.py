"""Hard negatives of anchors, pruned by bounds along spanning trees of the anchors.

Anchors of one label that lie near each other form a minimum spanning tree.  A candidate's score with a tree's root
is computed; with every other anchor it lies within *edge length times candidate norm* of its score with the
parent anchor, or of the bounds of that score.  Only candidates whose bounds overlap the window of scores wanted
are scored.  For positives the window starts at the lowest score among the best found so far, for negatives
it is the range allowed by the positives' scores, raised in the same way.

Blocks of candidates meet blocks of anchors in a cogroup; both have a bounded size, so neither a label that holds a
third of all rows nor the number of anchors decides what a task holds.  Each block returns its best few per
anchor, and a window keeps the best of those.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.components import staged
from tallyframe.operators.skew import sized_join

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
TREE_ROWS = 256
#: Bytes of doubles in a block of candidates or anchors: more blocks for more work at once, at most the larger size.
SMALL_BLOCK, LARGE_BLOCK = 1 << 20, 64 << 20
_BLOCKS = 64
_CHUNK = 4096
_NO_ID = np.iinfo(np.int64).max
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: parents come first, the root's parent is -1; ``parent`` counts places in ``order``."""
    n = len(points)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, link = np.full(n, np.inf), np.full(n, -1)
    out = np.zeros(n, dtype=bool)
    at = 0
    for k in range(n):
        order[k], parent[k], edge[k] = at, link[at], near[at] if k else 0.0
        out[at] = True
        gap = points - points[at]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        closer = ~out & (far < near)
        near[closer], link[closer] = far[closer], k
        at = int(np.argmin(np.where(out, np.inf, near)))
    return order, parent, edge


class _Rows:
    """Vectors of one length as whole numbers, with exact scores."""

    def __init__(self, table: pa.Table, dim: int, scale: int):
        x = np.asarray(table.column("vec").combine_chunks().flatten(), np.float64).reshape(table.num_rows, dim)
        with np.errstate(over="ignore"):
            self.q = np.floor(x * scale)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.q, self.q))
        self.x, self.scale = x, scale
        self.node = table.column("node").to_numpy()
        self.id = table.column("id").fill_null(_NO_ID).to_numpy()

    def whole(self, rows: np.ndarray) -> list[list[int]]:
        return [[int(v) * self.scale if abs(v) > 2**60 else floor(v * self.scale) for v in row] for row in self.x[rows].tolist()]


def _exact(rows: _Rows, anchors: _Rows) -> bool:
    """Whether every sum of products is a whole number that a double holds."""
    high = [np.abs(r.q).max(initial=0) for r in (rows, anchors)]
    return bool(rows.q.shape[1] * high[0] * high[1] < 2**53)


def _scores(rows: _Rows, at: np.ndarray, anchors: _Rows, k: int, exact: bool) -> np.ndarray:
    if exact:
        return (rows.q[at] @ anchors.q[k]).astype(np.int64)
    anchor = anchors.whole(np.array([k]))[0]
    sums = [sum(a * b for a, b in zip(row, anchor)) for row in rows.whole(at)]
    return np.array([min(max(s, _LEAST), _MOST) for s in sums], np.int64)


def _best(score: np.ndarray, row: np.ndarray, rows: _Rows, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` by falling score, ties by smaller id."""
    if len(score) > most:
        few = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
        score, row = score[few], row[few]
    order = np.lexsort((rows.node[row], rows.id[row], ~score))[:most]
    return score[order], row[order]


def best_in_windows(rows: _Rows, anchors: _Rows, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int, windows, wanted):
    """Per anchor row k a list of (scores, rows), one for each of ``windows(k)``: the first ``most`` with a score in the window.

    ``trees`` holds (anchor rows, parents' places, edges); ``wanted(k, at)`` says which candidate rows count for anchor k.  Also
    returns how many scores were computed.
    """
    exact = _exact(rows, anchors)
    found = {k: [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows(k)] for tree, _, _ in trees for k in tree.tolist()}
    scored = 0
    for tree, parent, edge in trees:
        for start in range(0, len(rows.q), _CHUNK):
            at = np.arange(start, min(start + _CHUNK, len(rows.q)))
            low, high = np.empty((len(tree), len(at))), np.empty((len(tree), len(at)))
            for place, k in enumerate(tree.tolist()):
                held = found[k]
                # A full list only takes scores from its last one on.
                open_from = [max(w[0], int(s[-1])) if len(s) == most else w[0] for w, (s, _) in zip(windows(k), held)]
                least, top = min(open_from, default=1), max((w[1] for w in windows(k)), default=0)
                if place:
                    # One more than the bound: rounding of the norms.
                    slack = edge[place] * rows.norm[at] * (1 + 1e-9) + 1
                    low[place], high[place] = low[parent[place]] - slack, high[parent[place]] + slack
                    near = (high[place] >= least) & (low[place] <= top) if exact else np.full(len(at), bool(held))
                else:
                    near = np.ones(len(at), dtype=bool)
                some = at[near]
                if not len(some):
                    continue
                score = _scores(rows, some, anchors, k, exact)
                scored += len(some)
                low[place, near] = high[place, near] = score
                mine = wanted(k, some) & (score >= least) & (score <= top)
                score, some = score[mine], some[mine]
                for j, (bottom, window) in enumerate(zip(open_from, windows(k))):
                    inside = (score >= bottom) & (score <= window[1])
                    if inside.any():
                        both = np.concatenate([held[j][0], score[inside]]), np.concatenate([held[j][1], some[inside]])
                        held[j] = _best(*both, rows, most)
    return found, scored


def _trees(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    tree, place = table.column("tree").to_numpy(), table.column("place").to_numpy()
    parent, edge = table.column("parent").to_numpy(), table.column("edge").to_numpy()
    order = np.lexsort((place, tree))
    cuts = np.flatnonzero(np.diff(tree[order])) + 1
    return [(rows, parent[rows], edge[rows]) for rows in np.split(order, cuts) if len(rows)]


def anchor_trees(rows: DataFrame, scale: int = SCALE, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``rows`` with tree, place, parent and edge: trees of at most ``tree_rows`` neighbours on a projection, of one length and label."""
    side = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * F.sin(i * 12.9898 + 1)), F.lit(0.0), lambda a, x: a + x)
    ordered = staged(rows.withColumn("_side", side).orderBy("dim", "label", "_side", "node").drop("_side")
                     .withColumn("tree", F.floor(F.monotonically_increasing_id() / tree_rows)), "anchors")

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order, parent, edge = spanning_tree(_Rows(table, dim, scale).q)
        table = table.take(pa.array(order))
        # Neighbours in the order may have two labels and so two trees; the root's number tells them apart.
        table = table.set_column(table.schema.get_field_index("tree"), "tree", pa.array([table.column("node")[0].as_py()] * len(order), pa.int64()))
        for name, values in (("place", np.arange(len(order))), ("parent", parent.astype(np.int64)), ("edge", edge)):
            table = table.append_column(name, pa.array(values))
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.groupBy("dim", "label", "tree").applyInArrow(build, f"{fields}, place bigint, parent bigint, edge double")


def _copies(df: DataFrame, name: str, count: Column) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   tree_rows: int = TREE_ROWS, block_bytes: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first ``negatives`` for each anchor and positive.

    Components count as floor(scale * x); a score is the whole-number inner product with the anchor.
    An anchor's positives are its first ``positives`` other rows of the same label by falling
    score, ties by smaller id; a negative has another label and a score from ``low`` to ``high`` percent of the positive's.

    Rows with a null label, a null vector or a null or non-finite component take no part.  Repeated rows, also
    under one id, are rows of their own, and a repeated anchor has its result as often; a null
    id comes last among ties, and rows with one are anchors only if ``anchor`` says so (a null condition
    does not).  Rows whose vector has another length than the anchor's have no score with it.  Scores beyond 64 bits
    are set to the limits of 64 bits.  Other columns are not looked at; an empty table, or one without
    anchors, gives no rows.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"),
                          F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull()).filter(~F.coalesce(bad, F.lit(False)))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("node"), "id", "label", "vec", F.size("vec").alias("dim"), "is_anchor"), "vectors")
    row_bytes = F.col("dim").cast("bigint") * 8 + 32
    totals = rows.agg(F.coalesce(F.sum(row_bytes), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_anchor"), row_bytes)), F.lit(0))).first()
    size = block_bytes or min(LARGE_BLOCK, max(SMALL_BLOCK, totals[0] // _BLOCKS))
    blocks, groups = (max(1, -(-t // size)) for t in totals)
    trees = staged(anchor_trees(rows.filter("is_anchor").drop("is_anchor"), scale, tree_rows), "trees").withColumn(
        "grp", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
    parts = rows.groupBy("dim", "label").agg(F.ceil(F.sum(row_bytes) / size).cast("int").alias("parts"))
    own = rows.select("node", "id", "label", "vec", "dim")

    def positive(key: tuple[pa.Scalar, ...], cands: pa.Table, tops: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not cands.num_rows or not tops.num_rows:
            return pa.table({"anchor": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        some, anchors = _Rows(cands, dim, scale), _Rows(tops, dim, scale)
        found, _ = best_in_windows(some, anchors, _trees(tops), positives, lambda k: [(_LEAST, _MOST)],
                                   lambda k, at: some.node[at] != anchors.node[k])
        return _listed({(k,): lists[0] for k, lists in found.items()}, some, anchors, ["anchor"])

    near_rows = sized_join(own, parts, ["dim", "label"])
    near_rows = near_rows.withColumn("blk", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    near_tops = _copies(sized_join(trees, parts, ["dim", "label"]), "blk", F.col("parts"))
    keys = ["dim", "label", "blk", "grp"]
    partial = _copies(near_rows, "grp", F.lit(groups)).groupBy(*keys).cogroup(near_tops.groupBy(*keys)).applyInArrow(
        positive, "anchor bigint, id bigint, score bigint, node bigint")
    falling = [F.desc("score"), F.asc_nulls_last("id"), F.asc("node")]
    best = partial.withColumn("nth", F.row_number().over(Window.partitionBy("anchor").orderBy(*falling))).filter(F.col("nth") <= positives)
    best = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("pos"))
    tops = staged(trees.join(best.withColumnRenamed("anchor", "node"), "node", "left"), "anchors")

    def negative(key: tuple[pa.Scalar, ...], cands: pa.Table, tops: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not cands.num_rows or not tops.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "nth", "id", "score", "node")})
        some, anchors = _Rows(cands, dim, scale), _Rows(tops, dim, scale)
        label = cands.column("label").to_numpy()
        own_label = tops.column("label").to_numpy()
        windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in given or []] for given in tops.column("pos").to_pylist()]
        found, _ = best_in_windows(some, anchors, _trees(tops), negatives, lambda k: windows[k], lambda k, at: label[at] != own_label[k])
        return _listed({(k, j + 1): pair for k, lists in found.items() for j, pair in enumerate(lists)}, some, anchors, ["anchor", "nth"])

    far_rows = _copies(own.withColumn("blk", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")), "grp", F.lit(groups))
    far_tops = _copies(tops, "blk", F.lit(blocks))
    keys = ["dim", "blk", "grp"]
    partial = far_rows.groupBy(*keys).cogroup(far_tops.groupBy(*keys)).applyInArrow(
        negative, "anchor bigint, nth bigint, id bigint, score bigint, node bigint")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(*falling))).filter(F.col("rank") <= negatives)
    named = tops.select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("pos").alias("p")).select(
        "anchor", "anchor_id", F.col("p.nth").cast("bigint").alias("nth"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return named.join(ranked, ["anchor", "nth"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _listed(found: dict, rows: _Rows, anchors: _Rows, names: list[str]) -> pa.Table:
    """One row per entry of the lists; the first part of a key is an anchor's row, further parts are kept."""
    sizes = [len(score) for score, _ in found.values()]
    key = np.array(list(found), np.int64).reshape(len(found), len(names))
    key[:, 0] = anchors.node[key[:, 0]]
    empty = np.zeros(0, np.int64)
    row = np.concatenate([empty, *[r for _, r in found.values()]])
    ids = rows.id[row]
    columns = {name: pa.array(np.repeat(key[:, i], sizes)) for i, name in enumerate(names)}
    return pa.table(columns | {"id": pa.array(ids, mask=ids == _NO_ID), "score": pa.array(np.concatenate([empty, *[s for s, _ in found.values()]])),
                               "node": pa.array(rows.node[row])})
