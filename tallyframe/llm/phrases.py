"""Phrase collocations by dynamic itemset counting.

The corpus is cut into blocks, and the blocks into a few corpus shards that are scanned in turn, again and again.
Words are counted from the first scan on.  At each stop, a phrase becomes active as soon as the two phrases that it
is made of by dropping its last or its first word have both reached the threshold; it is counted from the next
shard on until the scan comes round to where it began, so that longer phrases are counted while shorter ones are
still under way.  Nothing is counted twice, and every phrase that reaches the threshold is counted in full: its parts
are at least as frequent and so become known by the time their own cycle ends.

A phrase of two words and more is a pair of the numbers of its two parts, so keys are exact; words are their
bytes.  In each scan a block sends its distinct active phrases with their counts, packed, to the *home* of each (a hash
range of the language), which adds them up and answers which were known to be frequent at the last stop.  With the
answers the block forms its phrases of the next length.  A phrase in a third of all texts costs one entry per block.
Homes are staged in the shared folder at every stop; only sums over all blocks reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.components import staged
from tallyframe.operators.skew import sized_join
from tallyframe.session import drop_stage

LEAST_COUNT = 30
LONGEST = 4
CORPUS_SHARDS = 3
ABSORBED = 80
TOP = 2000
SCORE_SCALE = 2_000_000
BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20
HOME_WORDS = 1 << 20

# What ends a piece, and what parts words.
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True

_LAYOUT = "lang string, blk bigint, n bigint, size int, keys binary, counts binary, codes binary"
_SENT = "lang string, blk bigint, home int, base int, keys binary, counts binary, starts binary, homes int, size int, codes binary"
_HOME = "lang string, home int, blk bigint, keys binary, counts binary, starts binary, idents binary, reached binary, serial bigint"
_FOUND = "lang string, id bigint, f bigint, {}"


def piece_codes(buf: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, counts, codes) of a batch of texts, A-Z in lower case.

    ``words`` are the distinct words in order of their hashes, ``codes`` all words in turn
    as places in that list, with a -1 wherever the next word belongs to another piece or text.
    """
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    ends = _ENDS_PIECE[buf]
    inside = ~(ends | _BLANK[buf])
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    # Equal bytes, not equal hashes, make two words one.
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(np.append(0, np.cumsum(end - start))), pa.py_buffer(_taken(buf, start, end))])
    encoded = column.dictionary_encode()
    words = encoded.dictionary.to_pylist()
    order = np.argsort(_word_hashes(words), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    code = place[encoded.indices.to_numpy(zero_copy_only=False)]
    ended = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(ends, out=ended[1:])
    new = np.flatnonzero((ended[start[1:]] != ended[start[:-1]]) | (np.diff(np.searchsorted(off, start, "right")) > 0)) + 1
    return [words[i] for i in order], np.bincount(code, minlength=len(words)), np.insert(code, new, -1)


def _taken(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    marks = np.zeros(len(buf) + 1, np.int8)
    marks[start] += 1
    np.add.at(marks, end, -1)
    return buf[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    buf = np.frombuffer(b"".join(words), np.uint8)
    return W.word_hashes(buf, np.append(0, ends[:-1]), ends)


def _pair_hashes(pairs: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(pairs[:, 0].astype(np.uint64)) * np.uint64(W.BASE) + pairs[:, 1].astype(np.uint64))


_ZSTD = W.Local()


def _squeezed(data: bytes) -> bytes:
    if not _ZSTD:
        _ZSTD["in"], _ZSTD["out"] = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return _ZSTD["in"].compress(data) if data else b""


def _restored(data: bytes) -> bytes:
    if not _ZSTD:
        _squeezed(b"")
    return _ZSTD["out"].decompress(data) if data else b""


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: the high bytes of numbers compress to nothing."""
    values = np.ascontiguousarray(values)
    return _squeezed(values.view(np.uint8).reshape(len(values), -1).T.tobytes()) if len(values) else b""


def _whole(payload: bytes, kind, width: int = 1) -> np.ndarray:
    """The numbers (rows of ``width`` numbers) that :func:`_planes` laid out."""
    size = np.dtype(kind).itemsize * width
    values = np.frombuffer(_restored(payload), np.uint8).reshape(size, -1).T.copy(order="C").view(kind)
    return values if width > 1 else values.reshape(-1)


def _pack(keys) -> bytes:
    """Words joined by spaces (no word holds one), or pairs of numbers."""
    return _squeezed(b" ".join(keys)) if isinstance(keys, list) else _planes(keys)


def _words(payload: bytes) -> list[bytes]:
    return _restored(payload).split(b" ") if payload else []


def _unpack(payloads: list[bytes], size: int) -> tuple[pa.Array, list[int]]:
    """All keys of the payloads as one Arrow array, and how many each payload holds."""
    if size == 1:
        lists = [_words(p) for p in payloads]
        return pa.array([w for some in lists for w in some], pa.large_binary()), [len(some) for some in lists]
    pairs = [_whole(p, np.int64, 2) for p in payloads]
    whole = np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    return pa.Array.from_buffers(pa.binary(16), len(whole), [None, pa.py_buffer(whole)]), [len(p) for p in pairs]


def _repack(keys: pa.Array, size: int) -> bytes:
    if size == 1:
        return _pack(keys.to_pylist())
    return _planes(np.frombuffer(keys.buffers()[1], np.int64, 2 * len(keys), keys.offset * 16).reshape(-1, 2)) if len(keys) else b""


def _home(hashes: np.ndarray, homes: int) -> np.ndarray:
    """The home of a key: homes are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def _home_rows(lang: str, blk: int, home: np.ndarray, keys, counts: np.ndarray, starts: np.ndarray) -> list[dict]:
    """One row per home; the keys are in order of their homes."""
    first = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else []
    return [{"lang": lang, "blk": blk, "home": int(home[a]), "base": int(a), "keys": _pack(keys[a:b]),
             "counts": _planes(counts[a:b].astype(np.int64)), "starts": _planes(starts[a:b].astype(np.int16))}
            for a, b in zip(first, [*first[1:], len(home)])]


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def lay_out(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Blocks of about ``block_bytes`` of one language's texts: the distinct words, their counts, and all words as codes.

    A block holds neighbouring rows of one partition, so texts are not shuffled and no language, id or copied text is a
    hot key.  The numbers of blocks hold once the result is staged.
    """
    schema = _arrow(_LAYOUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        blk = TaskContext.get().partitionId() << 32

        def block(lang: str) -> pa.RecordBatch:
            nonlocal blk
            blk += 1
            sizes.pop(lang)
            words, counts, codes = piece_codes(*W.string_parts(pa.chunked_array(held.pop(lang))))
            return pa.RecordBatch.from_pylist([{"lang": lang, "blk": blk - 1, "n": int(counts.sum()), "size": len(words), "keys": _pack(words),
                                                "counts": _planes(counts.astype(np.int64)), "codes": _planes(codes.astype(np.int32))}], schema)

        for batch in batches:
            encoded = batch.column("lang").dictionary_encode()
            place = encoded.indices.to_numpy(zero_copy_only=False)
            text = batch.column("text").cast(pa.large_string())
            for k, lang in enumerate(encoded.dictionary.to_pylist()):
                rows = np.flatnonzero(place == k)
                ends = np.cumsum(pc.binary_length(text.take(pa.array(rows))).to_numpy(zero_copy_only=False))
                while len(rows):
                    room = block_bytes - sizes.get(lang, 0)
                    fit = max(1, int(np.searchsorted(ends, room, "right")))
                    held.setdefault(lang, []).append(text.take(pa.array(rows[:fit])))
                    sizes[lang] = sizes.get(lang, 0) + int(ends[fit - 1])
                    rows, ends = rows[fit:], ends[fit:] - ends[fit - 1]
                    if sizes[lang] >= block_bytes or len(rows):
                        yield block(lang)
            if sum(sizes.values()) > HELD_BYTES:
                for lang in list(held):
                    yield block(lang)
        for lang in list(held):
            yield block(lang)

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, _LAYOUT).filter("n > 0")


def _words_sent(layout: DataFrame) -> DataFrame:
    """A block's words to their homes."""
    schema = _arrow(_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _words(row["keys"])
                sent = _home_rows(row["lang"], row["blk"], _home(_word_hashes(words), row["homes"]), words,
                                  _whole(row["counts"], np.int64), np.zeros(len(words), np.int16))
                yield from _table(sent, schema).to_batches()

    return layout.select("lang", "blk", "homes", "keys", "counts").mapInArrow(run, _SENT)


def _homes(sent: DataFrame, state: DataFrame | None, size: int, step: int, cycle: int, least: int) -> DataFrame:
    """New states (blk is null) and answers (blk is set) of all homes after a scan.

    An answer lists the places of the block's phrases that were frequent before this scan, with number and step.
    A phrase is counted in the ``cycle`` scans from its start on; one that is infrequent after them is let go.
    """
    schema = _arrow(_HOME)

    def run(sent: pa.Table, held: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        state = held.to_pylist()[0] if held.num_rows else None
        lang, home = (rows[0] if rows else state)["lang"], (rows[0] if rows else state)["home"]
        ints = lambda name, kind: _whole(state[name], kind) if state else np.zeros(0, kind)
        count, start, ident, reached = ints("counts", np.int64), ints("starts", np.int16), ints("idents", np.int64), ints("reached", np.int16)
        known, _ = _unpack([state["keys"]] if state else [], size)
        serial = state["serial"] if state else 0
        keys, sizes = _unpack([r["keys"] for r in rows], size)
        encoded = keys.dictionary_encode()
        which, keys = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        at = pc.fill_null(pc.index_in(keys, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        seen = at >= 0
        out, row_at = [], 0
        number, when = np.full(len(at), -1, np.int64), np.full(len(at), -1, np.int16)
        number[seen], when[seen] = ident[at[seen]], reached[at[seen]]
        for row, n in zip(rows, sizes):
            mine = which[row_at:row_at + n]
            row_at += n
            hit = np.flatnonzero(number[mine] >= 0)
            if len(hit):
                out.append({"lang": lang, "home": home, "blk": row["blk"], "keys": _planes((hit + row["base"]).astype(np.int32)),
                            "idents": _planes(number[mine[hit]]), "reached": _planes(when[mine[hit]])})
        begun = np.zeros(len(at), np.int16)
        more = np.zeros(len(at), np.int64)
        if rows:
            begun[which] = np.concatenate([_whole(r["starts"], np.int16) for r in rows])
            np.add.at(more, which, np.concatenate([_whole(r["counts"], np.int64) for r in rows]))
        live = step < begun.astype(np.int64) + cycle
        count[at[seen & live]] += more[seen & live]
        new = np.flatnonzero(~seen & live)
        known = pa.concat_arrays([known.cast(keys.type), keys.take(pa.array(new))])
        count, start = np.append(count, more[new]), np.append(start, begun[new])
        ident, reached = np.append(ident, np.full(len(new), -1)), np.append(reached, np.full(len(new), -1, np.int16))
        first = np.flatnonzero((count >= least) & (ident < 0))
        ident[first], reached[first] = (home << 36) + serial + np.arange(len(first)), step
        keep = np.flatnonzero((ident >= 0) | (step < start.astype(np.int64) + cycle - 1))
        if size > 1 and len(keep):
            # In order, the numbers of first parts compress to nothing.
            pairs = np.frombuffer(known.buffers()[1], np.int64, 2 * len(known), known.offset * 16).reshape(-1, 2)[keep]
            keep = keep[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        out.append({"lang": lang, "home": home, "keys": _repack(known.take(pa.array(keep)), size), "counts": _planes(count[keep]),
                    "starts": _planes(start[keep]), "idents": _planes(ident[keep]), "reached": _planes(reached[keep]), "serial": serial + len(first)})
        return _table(out, schema)

    held = state if state is not None else sent.sparkSession.createDataFrame([], _HOME)
    return sent.groupBy("lang", "home").cogroup(held.groupBy("lang", "home")).applyInArrow(run, _HOME)


def grown(codes: np.ndarray, number: np.ndarray, reached: np.ndarray, homes: int):
    """Phrases one word longer: (homes, pairs of numbers, counts, starts, codes), in order of homes and pairs.

    ``codes`` are places of phrases (-1: none) at successive words; two known neighbours make a phrase.
    """
    known = np.append(number, -1)[codes] >= 0
    both = known[:-1] & known[1:]
    left, right = codes[:-1][both], codes[1:][both]
    local, inverse, counts = np.unique(left.astype(np.int64) * len(number) + right, return_inverse=True, return_counts=True)
    left, right = local // max(1, len(number)), local % max(1, len(number))
    pairs = np.stack([number[left], number[right]], axis=1)
    home = _home(_pair_hashes(pairs), homes)
    order = np.lexsort((pairs[:, 1], pairs[:, 0], home))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    out = np.full(len(both), -1, np.int32)
    out[both] = place[inverse]
    # One -1 parts two runs as well as many.
    out = out[(out >= 0) | np.append(True, out[:-1] >= 0)] if len(out) else out
    return home[order], pairs[order], counts[order], np.maximum(reached[left], reached[right])[order] + 1, out


def _longer(carried: DataFrame, answers: DataFrame, last: bool, step: int, cycle: int) -> DataFrame:
    """From a block's codes and its answers: rows for the homes of the next length, and the block's next codes (home is null)."""
    schema = _arrow(_SENT)

    def run(key: tuple[pa.Scalar, ...], carried: pa.Table, answers: pa.Table) -> pa.Table:
        if not carried.num_rows or not answers.num_rows:
            return _table([], schema)
        row = carried.to_pylist()[0]
        number, reached = np.full(row["size"], -1, np.int64), np.full(row["size"], -1, np.int16)
        for a in answers.to_pylist():
            at = _whole(a["keys"], np.int32)
            number[at], reached[at] = _whole(a["idents"], np.int64), _whole(a["reached"], np.int16)
        home, pairs, counts, starts, codes = grown(_whole(row["codes"], np.int32), number, reached, row["homes"])
        if last:
            # Nothing is made of the longest phrases, so only those that are still counted are sent.
            live = step < starts + cycle
            home, pairs, counts, starts = home[live], pairs[live], counts[live], starts[live]
        if not len(pairs):
            return _table([], schema)
        sent = _home_rows(row["lang"], row["blk"], home, pairs, counts, starts)
        if not last:
            sent.append({"lang": row["lang"], "blk": row["blk"], "homes": row["homes"], "size": len(pairs), "codes": _planes(codes)})
        return _table(sent, schema)

    return carried.groupBy("lang", "blk").cogroup(answers.groupBy("lang", "blk")).applyInArrow(run, _SENT)


def _frequent(state: DataFrame, size: int) -> DataFrame:
    """A row per phrase that reached the threshold: lang, number, f, and the word or the numbers of its two parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ident = _whole(row["idents"], np.int64)
                hit = np.flatnonzero(ident >= 0)
                keys, _ = _unpack([row["keys"]], size)
                columns = {"lang": pa.array([row["lang"]] * len(hit), pa.string()), "id": pa.array(ident[hit]),
                           "f": pa.array(_whole(row["counts"], np.int64)[hit])}
                if size == 1:
                    columns["word"] = keys.take(pa.array(hit)).cast(pa.large_string()).cast(pa.string())
                else:
                    pair = _whole(row["keys"], np.int64, 2)[hit]
                    columns |= {"a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])}
                yield from pa.table(columns).to_batches()

    return state.select("lang", "keys", "counts", "idents").mapInArrow(run, _FOUND.format("word string" if size == 1 else "a bigint, b bigint"))


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, longest: int = LONGEST,
                  shards: int = CORPUS_SHARDS, block_bytes: int = BLOCK_BYTES, home_words: int = HOME_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for each length, the phrases that occur ``least`` times or more, by dynamic itemset counting.

    The first length has lang, id, f and word, the others lang, id, f and the numbers ``a`` and ``b`` of the phrase without its last
    and without its first word.
    """
    spark = docs.sparkSession
    layout = staged(lay_out(docs, lang_col, text_col, block_bytes), "layout")
    totals = staged(layout.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    if totals.isEmpty():
        return totals, [spark.createDataFrame([], _FOUND.format("word string" if size == 1 else "a bigint, b bigint")) for size in range(1, longest + 1)]
    blocks = sized_join(layout, totals.select("lang", F.ceil(F.col("n") / home_words).cast("int").alias("homes")), ["lang"])
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("blk"), F.lit(shards)))
    states: list[DataFrame | None] = [None] * longest
    kept: dict[tuple[int, int], DataFrame] = {}
    for step in range(shards * longest):
        cycle, shard = divmod(step, shards)
        here, spent = blocks.filter(F.col("shard") == shard), []
        # Lengths under ``cycle`` were final in the last cycle, so what the blocks sent then of this length still holds.
        size = max(1, cycle)
        sent = _words_sent(here) if size == 1 else kept.pop((size, shard), None)
        while sent is not None:
            if size > 1:
                spent.append(sent)
            after = staged(_homes(sent.filter("home IS NOT NULL"), states[size - 1], size, step, shards, least), f"homes{size}")
            spent.append(after if step >= size * shards else states[size - 1])
            if step < size * shards:
                states[size - 1] = after.filter("blk IS NULL")
            if size == longest or size > step:
                break
            carried = here if size == 1 else sent.filter("home IS NULL")
            carried = carried.select("lang", "blk", "homes", "size", "codes")
            sent = staged(_longer(carried, after.filter("blk IS NOT NULL"), size + 1 == longest, step, shards), f"sent{size + 1}")
            size += 1
            if size == cycle + 1 and cycle:
                kept[size, shard] = sent
        held = list(kept.values())
        drop_stage(*[s for s in spent if s is not None and all(s is not k for k in held)])
    return totals, [_frequent(state, size) for size, state in enumerate(states, 1)]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, longest: int = LONGEST,
                 absorbed: int = ABSORBED, top: int = TOP, shards: int = CORPUS_SHARDS, block_bytes: int = BLOCK_BYTES,
                 home_words: int = HOME_WORDS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z in lower case, end pieces at ``.,;:!?`` and line breaks, and have words between blanks; phrases of 2 to
    ``longest`` words lie within a piece.  ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring
    cut (ties: the first), ``n`` all words of the language; score is floor(2000000 a / (l + r)).  A phrase within a longer
    one that also reaches ``least`` and has ``absorbed`` percent of its count is dropped.  Order: score and a falling, phrase by its bytes.

    A null language is ``und``, a null or empty text has no words, repeated rows count as often as they are
    there, ids and other columns are not looked at, and an empty table gives no rows.  A text longer than a block is a
    block of its own.
    """
    totals, found = count_phrases(docs, lang_col, text_col, least, longest, shards, block_bytes, home_words)
    # before[k - 1] and after[k - 1]: counts of the first and of the last k words.
    one = found[0].select("lang", "id", "f", F.array("word").alias("words"), F.array("f").alias("before"), F.array("f").alias("after"))
    tables = [one]
    for rows in found[1:]:
        left = tables[-1].select("lang", F.col("id").alias("a"), F.col("words").alias("head"), "before")
        right = tables[-1].select("lang", F.col("id").alias("b"), F.element_at("words", -1).alias("tail"), "after")
        rows = rows.join(left, ["lang", "a"]).join(right, ["lang", "b"])
        tables.append(staged(rows.select("lang", "id", "f", "a", "b", F.concat("head", F.array("tail")).alias("words"),
                                         F.concat("before", F.array("f")).alias("before"), F.concat("after", F.array("f")).alias("after")), "phrases"))
    kept = []
    for size, rows in enumerate(tables[1:], 2):
        if size < longest:
            wider = tables[size]
            most = wider.select("lang", F.col("a").alias("id"), "f").unionByName(wider.select("lang", F.col("b").alias("id"), "f"))
            most = most.groupBy("lang", "id").agg(F.max("f").alias("most"))
            rows = rows.join(most, ["lang", "id"], "left").filter(
                F.expr(f"most IS NULL OR CAST(100 AS DECIMAL(20,0)) * most < {absorbed} * CAST(f AS DECIMAL(20,0))"))
        cuts = [F.struct(F.expr(f"CAST({SCORE_SCALE} AS DECIMAL(20,0)) * CAST(f AS DECIMAL(18,0)) "
                                f"DIV (CAST(before[{k - 1}] AS DECIMAL(20,0)) + after[{size - k - 1}])").alias("score"),
                         F.lit(k).alias("k"), F.get("before", F.lit(k - 1)).alias("l"), F.get("after", F.lit(size - k - 1)).alias("r"))
                for k in range(1, size)]
        kept.append(rows.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return sized_join(best, totals, ["lang"]).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
