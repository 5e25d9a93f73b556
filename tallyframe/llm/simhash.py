"""SimHash near-dedup by a self-join of binary tries.

A fingerprint goes to four tries, one per 16-bit block moved to the front: two
fingerprints that differ in at most three bits agree in a block, so they meet
below one depth-16 node of that block's trie.  Below such a node the join walks
pairs of nodes together, adds up the differing bits and drops a pair beyond the
budget.  A node with more fingerprints than a task should hold is split into
pairs of its descendants, which are joined by other tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import connected_components, staged
from tallyframe.llm import words as W

BITS = 64
MAX_DISTANCE = 3
SHINGLE = 3
NODE_ROWS = 1 << 18
SPLIT_BITS = 8
_FRONT = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 (seed 42) bits over all word shingles; 0 for a text without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp holds the 64 bits as a signed long.  Null text counts as empty."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = W.string_parts(batch.column(1))
            raw, at = buf.tobytes(), off.tolist()
            fp = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def component_roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component after adding the edges a-b to ``label``."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def trie_join(values: np.ndarray, groups: np.ndarray, top: int, budget: int) -> np.ndarray:
    """Root index of each value after linking values of one group at ``budget`` bits or fewer.

    ``values`` (unsigned, the front block already cut off) are sorted within
    sorted ``groups`` and distinct there; ``top`` is the number of their bits.
    A node is a range of rows.  Blocks of the pair list are walked depth first, so
    memory is bounded, and pairs of nodes whose rows are already one component are
    dropped: a dense group of n near copies costs about n steps, not n^2.
    """
    n = len(values)
    label = np.arange(n)
    if n < 2:
        return label
    ones = [None] * top

    def count(bit: int) -> np.ndarray:
        if ones[bit] is None:
            total = np.zeros(n + 1, np.int32)
            np.cumsum((values >> np.uint64(bit)) & np.uint64(1), out=total[1:], dtype=np.int32)
            ones[bit] = total
        return ones[bit]

    lo = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    hi = np.append(lo[1:], n)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(top - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > _FRONT:
            half = len(al) // 2
            stack.append((bit, *(x[half:] for x in (al, ah, bl, bh, d))))
            al, ah, bl, bh, d = (x[:half] for x in (al, ah, bl, bh, d))
            stack.append((bit, al, ah, bl, bh, d))
            continue
        # Pairs whose rows are all in one component already can add nothing.
        change = np.zeros(n + 1, np.int32)
        np.cumsum(label[1:] != label[:-1], out=change[1:n])
        even = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (label[al] == label[bl])
        al, ah, bl, bh, d = (x[~even] for x in (al, ah, bl, bh, d))
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            a, b = al[leaf], bl[leaf]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            if near.any():
                label = component_roots(label, a[near], b[near])
            al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        if not len(al) or bit < 0:
            continue
        total = count(bit)
        am, bm = ah - (total[ah] - total[al]), bh - (total[bh] - total[bl])
        same = al == bl
        parts = []
        for x, y, u, v, more in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
            ok = (x < y) & (u < v) & (d + more <= budget)
            if more and x is am:
                ok &= ~same  # the mirrored half of a node joined with itself
            if not more:
                ok &= ~((x == u) & (y - x == 1))
            parts.append((x[ok], y[ok], u[ok], v[ok], d[ok] + np.int8(more)))
        joined = [np.concatenate(p) for p in zip(*parts)]
        if len(joined[0]):
            stack.append((bit - 1, *joined))
    return label


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but the last) that never cut a group of column ``node``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            node = table.column("node").to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


def near_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) that join the same fingerprints as all pairs at ``max_distance`` bits or fewer.

    ``fps`` has distinct longs in column ``fp``.  Each trie part returns a star per
    component, so the edges are at most as many as the rows it read.
    """
    width = BITS // (max_distance + 1)
    blocks = max_distance + 1
    rest = BITS - width
    mask = F.lit((1 << rest) - 1)

    def turned(k: int):
        # The block k moved to the front, as (block, rest).
        shift = k * width
        if not shift:
            return F.col("fp")
        return F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", BITS - shift))

    tries = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), turned(k).alias("v")) for k in range(blocks)])).alias("t"))
    block = F.shiftrightunsigned(F.col("t.v"), rest)
    tries = tries.select((F.col("t.k").cast("long") * (1 << width) + block).alias("node"),
                         F.col("t.v").bitwiseAND(mask).alias("v"), F.col("t.k").alias("k"))
    heavy = staged(tries.groupBy("node").count().filter(F.col("count") > node_rows).select("node"), "heavy")
    if heavy.isEmpty():
        tries = tries.withColumn("pair", F.lit(0).cast("long"))
    else:
        # Pairs of descendants SPLIT_BITS deeper, as far apart as the budget lets them be.
        near = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= max_distance]
        deep = F.shiftrightunsigned("v", rest - SPLIT_BITS)
        other = F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: deep.bitwiseXOR(m)))
        split = tries.join(heavy, "node", "left_semi").withColumn("o", other).withColumn(
            "pair", F.lit(1) + F.least("o", deep) * (1 << SPLIT_BITS) + F.greatest("o", deep)).drop("o")
        tries = tries.join(heavy, "node", "left_anti").withColumn("pair", F.lit(0).cast("long")).unionByName(split)
    key = F.col("node") * (1 << (2 * SPLIT_BITS + 1)) + F.col("pair")
    tries = tries.select(key.alias("node"), "v", (F.lit(1).cast("long") * F.pmod(F.floor(F.col("node") / (1 << width)), F.lit(blocks))).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            node = table.column("node").to_numpy()
            v = table.column("v").to_numpy().view(np.uint64)
            label = trie_join(v, node, rest, max_distance)
            at = np.flatnonzero(label != np.arange(len(label)))
            pair_bits = np.int64(2 * SPLIT_BITS + 1)
            front = ((node >> pair_bits) & ((1 << width) - 1)).astype(np.uint64)
            full = (front << np.uint64(rest)) | v
            shift = (table.column("k").to_numpy() * width).astype(np.uint64)
            back = np.where(shift == 0, full, (full >> shift) | (full << ((np.uint64(BITS) - shift) % np.uint64(BITS))))
            back = back.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back[at]), pa.array(back[label[at]])], ["a", "b"])

    return tries.repartition("node").sortWithinPartitions("node", "v").mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_distance: int = MAX_DISTANCE, node_rows: int = NODE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, text_hash and root.

    Fingerprints at ``max_distance`` bits or fewer are linked; component_id is the
    smallest doc_id reachable.  Texts without words (null, empty, only spaces) have
    fingerprint zero and are linked like any other.  Rows with one id or equal texts
    share a component; a null id has a component like any other, whose id is the
    smallest that is not null (null if there is none).  Copies are one fingerprint
    before any pair is looked at.  ``root``, a fingerprint, names the component when ids
    cannot.  Very long texts are read whole; other columns are not looked at.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    low = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct")
    roots = connected_components(near_links(low.select("fp"), max_distance, node_rows))
    known = low.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = known.groupBy("root").agg(F.min("lo").alias("component_id"))
    member = known.select("fp", "root").join(ids, "root").select("fp", "component_id", "root")
    return prints.join(member, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each component the smallest id stays.

    A null id stays only where its component has no other; of rows with one id the
    smallest text hash stays, of rows alike in id and text any one.
    """
    found = staged(simhash_components(docs, id_col, text_col, shingle, max_distance), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    winners = found.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash"))
    kept = docs.join(winners, same, "left_semi")
    if found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn("_hash", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "_hash"]).drop("_hash")
