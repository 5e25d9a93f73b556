"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

Texts are words of lower-case letters and digits.  A random walk (CGK embedding)
reads a window of words: at each step it writes the word under it, and a random
bit of (word, step) decides whether it moves on.  After an edit two walks tend to
meet again, so few edits leave most written words equal: edit distance becomes
Hamming distance, and a hash of a few sampled steps (bit sampling) is equal for
near copies with a good chance.  Each item-sized window is walked from several of
its places with several independent walks; the number of walks is raised until
simulated copies at the largest edit distance reach the target recall.  Windows
that cannot be near any item are skipped before (a window within k edits of n words
shares at least n - 1 - 2k pairs of neighbours), and each candidate is verified by its
exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.llm import words as W

EDIT_SHARE = 0.25
MIN_WORDS = 5
RECALL = 0.98
BLOCK_BYTES = 4 << 20
MAX_WALKS = 24
#: (steps of a walk, sampled steps) for items of at least so many words.
WALKS = ((10, 12, 5), (MIN_WORDS, 5, 3))
STRIDE = 2
_PAIR_BITS = 24

_PLAIN = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        _PLAIN[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b


def plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, first word of each text): A-Z lowered, all but letters, digits and non-ASCII split words."""
    buf = _PLAIN[buf]
    start, end, first = W.spans(buf, off)
    return W.word_hashes(buf, start, end), first


def edits_of(words: int, share: float) -> int:
    return int(words * share)


class Walk:
    """One random walk and its sampled steps."""

    def __init__(self, seed: int, steps: int, sampled: int):
        rng = np.random.default_rng([seed, steps])
        self.salts = rng.integers(1, 1 << 63, steps, dtype=np.uint64)
        self.sampled = set(rng.choice(steps, sampled, replace=False).tolist())

    def keys(self, hashes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the sampled steps of the walk from each place; behind ``stop`` there is a blank."""
        at, key = at.copy(), np.zeros(len(at), np.uint64)
        for step, salt in enumerate(self.salts):
            word = np.where(at < stop, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
            if step in self.sampled:
                key = W.mix(key * np.uint64(W.BASE) + word)
            at += ((W.mix(word ^ salt) >> np.uint64(63)) & np.uint64(1)).astype(at.dtype)
        return key


def edit_distance(item: list[int], text: list[int]) -> int:
    """Smallest edit distance of the whole item to any run of words of the text (bit-parallel)."""
    n = len(item)
    places: dict[int, int] = {}
    for k, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    more, less, now = full, 0, n
    best = now
    for word in text:
        same = places.get(word, 0) | less
        across = ((((same & more) + more) ^ more) | same) & full
        up, down = less | (full & ~(across | more)), more & across
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        more, less = down | (full & ~(across | up)), up & across
        best = min(best, now)
    return best


class Matcher:
    """Items of one block, their walks and the table from keys to (item, place)."""

    def __init__(self, items: list[list[int]], share: float = EDIT_SHARE, recall: float = RECALL, seed: int = 11):
        self.items, self.share = items, share
        self.long = np.array([len(i) for i in items], np.int64)
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        for item in items:
            words = np.array(item, np.uint64)
            self.pairs[self.pair_slots(words)] = True
        self.families = []
        for lower, steps, sampled in WALKS:
            own = [k for k in range(len(items)) if lower <= len(items[k])
                   and not any(lower < other <= len(items[k]) for other, _, _ in WALKS)]
            if own:
                self.families.append(self.family(own, steps, sampled, recall, seed))
        self.classes = self.length_classes()

    @staticmethod
    def pair_slots(words: np.ndarray) -> np.ndarray:
        return (W.mix(words[:-1] * np.uint64(W.BASE) + words[1:]) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def places(self, item: list[int], steps: int) -> range:
        """Places of an item its walks start from; a walk moves on about every other step."""
        return range(0, max(1, len(item) - steps // 2), STRIDE)

    def family(self, own: list[int], steps: int, sampled: int, recall: float, seed: int):
        """Walks, sorted keys, and item and place per key; walks are added until copies are found often enough."""
        rng = np.random.default_rng(seed)
        trials = []
        for k in own[:: max(1, len(own) // 60)]:
            for _ in range(4):
                trials.append((k, self.edited(self.items[k], rng)))
        found = np.zeros(len(trials), dtype=bool)
        walks, keys, ids, places = [], [], [], []
        while len(walks) < MAX_WALKS:
            walk = Walk(seed + len(walks), steps, sampled)
            walks.append(walk)
            for k in own:
                words, at = np.array(self.items[k], np.uint64), np.array(self.places(self.items[k], steps))
                keys.append(walk.keys(words, at, np.full(len(at), len(words))))
                ids.append(np.full(len(at), k))
                places.append(at)
            for n, (k, copy) in enumerate(trials):
                words, at = np.array(copy, np.uint64), np.arange(len(copy))
                item, own_at = np.array(self.items[k], np.uint64), np.array(self.places(self.items[k], steps))
                found[n] |= bool(np.isin(walk.keys(words, at, np.full(len(at), len(words))),
                                         walk.keys(item, own_at, np.full(len(own_at), len(item)))).any())
            if found.mean() >= recall:
                break
        key, which = np.concatenate(keys), np.concatenate([np.full(len(own_keys), n // len(own), np.uint64)
                                                           for n, own_keys in enumerate(keys)])
        key = W.mix(key ^ which)
        order = np.argsort(key, kind="stable")
        return walks, key[order], np.concatenate(ids)[order], np.concatenate(places)[order]

    def edited(self, item: list[int], rng: np.random.Generator) -> list[int]:
        """A copy with as many random edits as are allowed."""
        copy = list(item)
        for _ in range(edits_of(len(item), self.share)):
            at, new = int(rng.integers(len(copy))), int(rng.integers(1, 1 << 62))
            kind = int(rng.integers(3))
            copy[at:at + (kind > 0)] = [] if kind == 1 else [new]
        return copy

    def length_classes(self) -> list[tuple[int, int]]:
        """(window, pairs it must share) for items of about one length."""
        out, lengths = [], np.unique(self.long[self.long >= MIN_WORDS])
        while len(lengths):
            low = int(lengths[0])
            same = lengths[lengths <= low * 1.2]
            high = int(same[-1])
            out.append((high + edits_of(high, self.share),
                        max(1, min(int(n) - 1 - 2 * edits_of(int(n), self.share) for n in same))))
            lengths = lengths[len(same):]
        return out

    def match(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, edits) of the best place of each item within the allowed edits."""
        n = len(hashes)
        if n < 2 or not self.families:
            return []
        shared = np.zeros(n + 1, np.int64)
        np.cumsum(self.pairs[self.pair_slots(hashes)], out=shared[1:n])
        shared[n] = shared[n - 1]
        near = np.zeros(n + 1, np.int32)
        for window, least in self.classes:
            at = np.flatnonzero(shared[np.minimum(np.arange(n) + window, n)] - shared[:n] >= least)
            np.add.at(near, at, 1)
            np.add.at(near, np.minimum(at + window, n), -1)
        at = np.flatnonzero(np.cumsum(near[:n]) > 0)
        if not len(at):
            return []
        text = np.searchsorted(first, at, "right") - 1
        stop = first[text + 1]
        hits = []
        for walks, keys, ids, places in self.families:
            for which, walk in enumerate(walks):
                key = W.mix(walk.keys(hashes, at, stop) ^ np.uint64(which))
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                some = np.flatnonzero(high > low)
                count = (high - low)[some]
                slot = np.repeat(low[some] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
                begin = np.repeat(at[some], count) - places[slot]
                hits.append(np.stack([np.repeat(text[some], count), ids[slot], begin // 4], axis=1))
        found: dict[tuple[int, int], int] = {}
        for row, k, quarter in np.unique(np.concatenate(hits), axis=0).tolist():
            size = len(self.items[k])
            allowed = edits_of(size, self.share)
            a = max(int(first[row]), quarter * 4 - allowed)
            b = min(int(first[row + 1]), quarter * 4 + 4 + size + 2 * allowed)
            edits = edit_distance(self.items[k], hashes[a:b].tolist())
            if edits <= allowed:
                found[row, k] = min(edits, found.get((row, k), edits))
        return [(row, k, edits) for (row, k), edits in sorted(found.items())]


def _blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, share: float, recall: float,
            block_bytes: int) -> Iterator:
    """The benchmark as broadcast blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(
        F.col("text").isNotNull())
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        hashes, first = plain_words(*W.string_parts(pa.array([r["text"] for r in rows], pa.string())))
        words = [hashes[a:b].tolist() for a, b in zip(first.tolist(), first[1:].tolist())]
        yield benchmark.sparkSession.sparkContext.broadcast(
            {"ids": [r["item_id"] for r in rows], "words": words, "share": share, "recall": recall})


def _matches(shared, texts) -> tuple[Matcher, list[tuple[int, int, int]]]:
    """The matcher of a block, compiled once per worker, and its (row, item, edits) in a column of texts."""
    held = shared.value
    if "matcher" not in held:
        held["matcher"] = Matcher(held["words"], held["share"], held["recall"])
    found = []
    for low, _, part, at in W.pieces(*W.string_parts(texts)):
        found += [(low + row, k, edits) for row, k, edits in held["matcher"].match(*plain_words(part, at))]
    return held["matcher"], found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", edit_share: float = EDIT_SHARE,
                 recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_edits, n_words, similarity) per row of ``docs`` and item it holds.

    A text holds an item when some run of its words is within ``edit_share`` of the
    item's words in edit distance.  The benchmark is the query set: it is read in
    blocks of about ``block_bytes``, each broadcast and held against all texts.  Null
    and empty texts hold nothing; items of fewer than five words are too short to
    tell and are found nowhere; repeated items are found each; repeated rows and
    null ids give rows of their own; very long texts are read whole; other columns are
    not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_kind = benchmark.schema[item_id_col].dataType
    items_type = to_arrow_type(item_kind)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item_kind.simpleString()}, "
              "n_edits bigint, n_words bigint, similarity double")
    out = None
    for shared in _blocks(benchmark, item_id_col, item_text_col, edit_share, recall, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher, found = _matches(shared, batch.column(1))
                size = [len(matcher.items[k]) for _, k, _ in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([shared.value["ids"][f[1]] for f in found], items_type),
                    pa.array([f[2] for f in found], pa.int64()), pa.array(size, pa.int64()),
                    pa.array([1 - f[2] / n for f, n in zip(found, size)], pa.float64())],
                    ["doc_id", "item_id", "n_edits", "n_words", "similarity"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text", edit_share: float = EDIT_SHARE, recall: float = RECALL,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; see :func:`contaminated`.  Nothing is shuffled."""
    at = docs.columns.index(text_col)
    for shared in _blocks(benchmark, item_id_col, item_text_col, edit_share, recall, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, _, _ in _matches(shared, batch.column(at))[1]]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
