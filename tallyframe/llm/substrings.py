"""Substring dedup: words covered by a run of words that also stands elsewhere.

Four steps, all over whole texts, keyed by blocks of about two megabytes:

1. Every window of 35 words has a smallest 18-word phrase hash.  A block sends
   the distinct hashes of these *anchors* to shards, which send back those that
   occur more than once.  Equal windows have equal anchors, so a window without
   a returned anchor occurs once.
2. Blocks hash the windows that hold returned anchors, and the shards confirm
   the window hashes that occur more than once.
3. Per block the confirmed windows form passages; an Aho-Corasick automaton is
   compiled from the block's distinct passages.
4. The block's texts are streamed through its automaton; each hit marks words.

An automaton holds passages of one block, so its size is bounded, and a passage
reaches only blocks that can hold it.  The texts are shuffled once: the three
readings share one exchange.  A block sends a hash once however often it holds
it, so a passage in a third of all texts is as cheap as any other.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W

WINDOW = 35
BLOCK_BYTES = 2 << 20
SHARD_HASHES = 1 << 20

_SENT = "shard int, blk int, payload binary"
_BACK = "blk int, payload binary"
_OUT = "doc_id {id}, n_words bigint, n_removed bigint, kept_text string"


def _places(buf: np.ndarray, off: np.ndarray, window: int):
    """Words, window hashes, phrase hashes, each window's anchor hash, and which windows lie in one text."""
    gram = window // 2 + 1
    start, end, first = W.spans(buf, off)
    hashes = W.word_hashes(buf, start, end)
    grams = W.window_hashes(hashes, gram)
    anchor = W.sliding(grams, window - gram + 1)
    return start, end, first, W.window_hashes(hashes, window), grams, anchor, W.within(first, window, len(start))


def _sent(blk: int, hashes: np.ndarray, shards: int) -> pa.Table:
    """One row per shard; the lowest bit of a hash says that the block holds it more than once."""
    found, counts = np.unique(hashes & ~np.uint64(1), return_counts=True)
    shard = (W.mix(found) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    packed = (found | (counts > 1).astype(np.uint64))[order]
    ids, at = np.unique(shard[order], return_index=True)
    parts = [p.tobytes() for p in np.split(packed, at[1:])] if len(ids) else []
    return pa.table({"shard": pa.array(ids, pa.int32()), "blk": pa.array([blk] * len(ids), pa.int32()),
                     "payload": pa.array(parts, pa.binary())})


def _recurring(sent: DataFrame) -> DataFrame:
    """Back to each block, the hashes it sent that it holds twice or another block holds."""

    def answer(table: pa.Table) -> pa.Table:
        blocks = table.column("blk").to_numpy()
        lists = [np.frombuffer(p, np.uint64) for p in table.column("payload").to_pylist()]
        packed = np.concatenate(lists)
        found, inverse, counts = np.unique(packed >> np.uint64(1), return_inverse=True, return_counts=True)
        often = counts > 1
        often[inverse[(packed & np.uint64(1)) == 1]] = True
        back, at = [], 0
        for part in lists:
            back.append((part[often[inverse[at:at + len(part)]]] & ~np.uint64(1)).tobytes())
            at += len(part)
        return pa.table({"blk": pa.array(blocks, pa.int32()), "payload": pa.array(back, pa.binary())})

    return sent.groupBy("shard").applyInArrow(answer, _BACK)


def _member(values: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which values a block got back."""
    lists = [np.frombuffer(p, np.uint64) for p in table.column("payload").to_pylist()]
    known = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    values = values & ~np.uint64(1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _covered(buf, off, start, end, first, hits: np.ndarray, window: int) -> np.ndarray:
    """Words covered by passages, located by the block's automaton in every text that can hold one."""
    cover = np.zeros(len(start) + 1, np.int32)
    if not hits.any():
        return cover[:-1].astype(bool)
    texts = np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.flatnonzero(hits)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (texts[at[1:]] != texts[at[:-1]])
    begin = at[new]
    stop = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + window
    joined, ends = W.kept_text(buf, off, start, end, first, np.ones(len(start), dtype=bool))
    raw = joined.tobytes()
    # Byte place of each word in its joined text: word lengths and one space between words.
    long = end - start + 1
    total = np.zeros(len(start) + 1, np.int64)
    np.cumsum(long, out=total[1:])
    place = total[:-1] - total[first[:-1]][texts] + ends[:-1][texts]
    automaton = ahocorasick.Automaton()
    for a, b in zip(begin.tolist(), stop.tolist()):
        # Latin-1 keeps one character per byte; spaces on both sides keep hits on word borders.
        passage = " " + raw[place[a]:place[b - 1] + long[b - 1] - 1].decode("latin-1") + " "
        automaton.add_word(passage, (len(passage), b - a))
    automaton.make_automaton()
    for text in np.unique(texts[begin]).tolist():
        line = " " + raw[ends[text]:ends[text + 1]].decode("latin-1") + " "
        found = [(last - size + 1, count) for last, (size, count) in automaton.iter(line)]
        if found:
            byte, count = np.array(found, np.int64).T
            word = np.searchsorted(place[first[text]:first[text + 1]] - ends[text], byte) + first[text]
            np.add.at(cover, word, 1)
            np.add.at(cover, word + count, -1)
    return np.cumsum(cover[:-1]) > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept_text, the kept words joined by one space.

    With ``carry`` there is a column ``row``, too, a struct of the other columns of the
    input, and a text that loses nothing stays as it is.

    A word goes when a window of ``window`` consecutive words that covers it also
    starts anywhere else, in the same text too; windows are judged on the input,
    so all copies go.  Null and empty texts have no words and an empty result; a
    text shorter than the window is kept whole; repeated rows (also with one id,
    or a null id) are texts of their own and so lose their windows; other columns
    are not looked at; an empty table gives an empty result.
    """
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *others)
    row = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.sum(F.regexp_count("text", F.lit("[ \t-\r]"))).alias("w")).first()
    blocks = max(1, -(-(row["n"] or 0) // block_bytes))
    shards = max(1, -(-(row["w"] or 0) // (8 * SHARD_HASHES)))
    docs = docs.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    by_block = docs.groupBy("blk")

    def anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        buf, off = W.string_parts(table.column("text"))
        *_, grams, anchor, whole = _places(buf, off, window)
        if not len(anchor):
            return _sent(key[0].as_py(), anchor, shards)
        # Each place of an anchor once, although neighbouring windows share it.
        side = np.zeros(len(grams) - len(anchor), np.uint64)
        padded = np.concatenate([side, np.where(whole, anchor, np.uint64(0)), side])
        chosen = W.sliding(padded, len(side) + 1, np.maximum) == grams
        return _sent(key[0].as_py(), grams[chosen], shards)

    def windows(key: tuple[pa.Scalar, ...], table: pa.Table, back: pa.Table) -> pa.Table:
        buf, off = W.string_parts(table.column("text"))
        *_, hashes, _, anchor, whole = _places(buf, off, window)
        at = np.flatnonzero(whole)
        return _sent(key[0].as_py(), hashes[at[_member(anchor[at], back)]], shards)

    def removed(table: pa.Table, back: pa.Table) -> pa.Table:
        buf, off = W.string_parts(table.column("text"))
        start, end, first, hashes, _, _, whole = _places(buf, off, window)
        hits = np.zeros(len(start), dtype=bool)
        hits[:len(whole)] = whole & _member(hashes, back)
        cover = _covered(buf, off, start, end, first, hits, window)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(cover, out=total[1:])
        text = W.text_array(*W.kept_text(buf, off, start, end, first, ~cover)).cast(pa.string())
        n_removed = np.diff(total[first])
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "kept_text": text}
        if carry:
            same = table.column("text").combine_chunks().cast(pa.string())
            out |= {"kept_text": pc.if_else(pa.array(n_removed == 0), same, text), "row": W.nullable(table.column("row"))}
        return pa.table(out)

    repeated = _recurring(by_block.applyInArrow(anchors, _SENT))
    confirmed = _recurring(by_block.cogroup(repeated.groupBy("blk")).applyInArrow(windows, _SENT))
    schema = _OUT.format(id=docs.schema["doc_id"].dataType.simpleString())
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"
    return by_block.cogroup(confirmed.groupBy("blk")).applyInArrow(removed, schema)
