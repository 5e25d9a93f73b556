"""Quality by the perplexity under word models of trusted text, one per language.

Words are taken as they are written: letters of any script, case and accents kept; in
scripts without spaces each character is a word, and runs of marks and of line ends
are words, too.  Pairs of neighbouring words of the trusted texts are counted per
language; joins with the context totals and with the shorter contexts give interpolated
modified Kneser-Ney probabilities, tables that grow with the corpus and stay on the
cluster.  Single words fall back on those of all languages, and a word no trusted text
has on its spelling in 44 classes of characters, four in a row.  The different pairs of
all texts are priced once by joins, the counts of each text are joined with the prices.

A text is scored by the model of the half of the trusted texts it is not in, so trusted
texts are as new to their model as the others.  A text whose perplexity lies outside the
quantiles of the trusted texts of its language is rejected: too high is noise, too low
is repetition.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import phrases as P
from tallyframe.llm import words as W
from tallyframe.llm.characters import SCRIPTS, code_points, letter_tables
from tallyframe.llm.components import staged
from tallyframe.operators.skew import sized_join
from tallyframe.session import drop_stage

#: Texts of a block, texts a task holds before it lays out a block, words whose pairs share a home, and rounds of the homes and the blocks.
BLOCK_BYTES, HELD_BYTES, HOME_WORDS, ROUNDS = 4 << 20, 32 << 20, 1 << 20, 6
#: Kinds of code points besides white space: of scripts without spaces, other letters and digits, marks, marks of scripts without spaces, line ends.
SINGLE, LETTER, MARK, SIGN, NEW_LINE = 1, 2, 3, 4, 5

ORDER = 4
QUANTILES = (0.005, 0.99)
#: Classes besides 1..26 (letters a to z without case and accent).
SPACE, VOWEL, CONSONANT, OTHER_LETTER, DIGIT, LINE = 0, 27, 28, 29, 30, 31
MARKS = ".", ",", ";:?'\"()-", "!", "*", "$", "%", "&", "#", "|", "@"
CLASSES = 44
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for name in ("han", "kana", "thai", "lao", "khmer") for a, b in SCRIPTS[name])
_UNSPACED += "\u1000-\u109f"
#: What a word is; :func:`word_spans` finds the same.
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+|[^\w\s]+|\n+")
#: The limits of a language count as much as the pooled ones with so many trusted texts; its level does with LEVEL_SHRINK.
SHRINK, LEVEL_SHRINK = 50.0, 2.0
#: Chance that the next word goes by what the text itself has done before.
CACHE = 0.2
#: So many characters of usual perplexity are thought to be added to each text, so few characters do not decide.
PRIOR_CHARS = 20.0


def class_table() -> np.ndarray:
    """Class per code point; capitals are only vowels and consonants, so that running capitals stand out."""
    script, lower, folded = letter_tables()
    out = np.where(script > 0, OTHER_LETTER, CLASSES - 1).astype(np.uint8)
    some = (folded > 0) & (folded < 27)
    out[some] = folded[some]
    capital = (lower != np.arange(len(lower))) & (script > 0)
    vowel = np.isin(folded, [1, 5, 9, 15, 21])
    out[capital & vowel], out[capital & ~vowel] = VOWEL, CONSONANT
    out[[ord(c) for c in " \t\r\x0b\x0c"] + [0xA0, 0x3000]] = SPACE
    out[ord("\n")] = LINE
    out[[ord(c) for c in "0123456789"]] = DIGIT
    for k, marks in enumerate(MARKS, LINE + 1):
        out[[ord(c) for c in marks]] = k
    return out


def gram_codes(buf: np.ndarray, off: np.ndarray, table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of the run of ``order`` classes that ends at each character, and each text's offsets.

    A text opens with line ends, so every character has a full context.
    """
    points, at = code_points(buf, off)
    kinds = np.insert(table[points], np.repeat(at[:-1], order - 1), LINE).astype(np.int32)
    code = np.zeros(len(kinds), np.int32)
    for back in range(order):
        code[order - 1:] += kinds[order - 1 - back:len(kinds) - back] * np.int32(CLASSES**back)
    real = np.ones(len(kinds), dtype=bool)
    begin = at[:-1] + np.arange(len(at) - 1) * (order - 1)
    for k in range(order - 1):
        real[begin + k] = False
    return code[real], at


def count_grams(texts: DataFrame) -> DataFrame:
    """(code, n) over whole texts."""
    shared = texts.sparkSession.sparkContext.broadcast(class_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in batches:
            buf, off = W.string_parts(batch.column(0))
            for _, _, part, at in W.pieces(buf, off):
                total += np.bincount(gram_codes(part, at, shared.value)[0], minlength=len(total))
        code = np.flatnonzero(total)
        for low in range(0, len(code), 1 << 16):
            some = code[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["code", "n"])

    return texts.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Per order 1..``order``: (code, p, gamma) of the seen runs.

    ``p`` is the interpolated probability of the last class after the others; ``gamma``
    is the mass the context leaves to the shorter one, the same for all runs of a
    context.  Lower orders count the different classes in front of a run.
    """
    levels = {order: staged(grams.withColumn("code", F.col("code").cast("long")), "grams")}
    for k in range(order - 1, 0, -1):
        suffix = F.pmod("code", F.lit(CLASSES**k))
        levels[k] = staged(levels[k + 1].groupBy(suffix.alias("code")).agg(F.count("*").alias("n")), "grams")
    out: list[DataFrame] = []
    for k in range(1, order + 1):
        counts = levels[k]
        n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("n") == r).cast("long")) for r in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1, d2, d3 = (min(max(r - (r + 1) * y * b / a, 0.1), r - 0.05) if a else 0.5
                      for r, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        context = F.floor(F.col("code") / CLASSES)
        number = [F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("n") == 1, F.col("n") == 2, F.col("n") >= 3)]
        totals = counts.groupBy(context.alias("context")).agg(
            F.sum("n").alias("total"), (d1 * number[0] + d2 * number[1] + d3 * number[2]).alias("mass"))
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        gamma = F.col("mass") / F.col("total")
        joined = counts.withColumn("context", context).join(totals, "context")
        if k == 1:
            lower = F.lit(1.0 / CLASSES)
        else:
            joined = joined.withColumn("suffix", F.pmod("code", F.lit(CLASSES ** (k - 1)))).join(
                out[-1].select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
            lower = F.col("lower")
        out.append(staged(joined.select("code", ((F.col("n") - off) / F.col("total") + gamma * lower).alias("p"),
                                        gamma.alias("gamma")), "model"))
    return out


def cost_table(model: list[DataFrame]) -> np.ndarray:
    """-log p of every run of ORDER classes, unseen ones included; CLASSES^ORDER floats."""
    lower = np.array([1.0 / CLASSES])
    for k, level in enumerate(model, 1):
        rows = level.toPandas()
        gamma = np.ones(CLASSES ** (k - 1))
        code = rows["code"].to_numpy(np.int64)
        gamma[code // CLASSES] = rows["gamma"].to_numpy()
        suffix = np.tile(lower, CLASSES ** (k - 1) * CLASSES // len(lower))
        p = np.repeat(gamma, CLASSES) * suffix
        p[code] = rows["p"].to_numpy()
        lower = p
    return (-np.log(lower)).astype(np.float32)


def character_costs(texts: DataFrame) -> np.ndarray:
    """-log p of each code point within its class, from its counts; at most one row a code point is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, _, part, at in W.pieces(*W.string_parts(batch.column(0))):
                total += np.bincount(code_points(part, at)[0], minlength=len(total))
        point = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(point, pa.int32()), pa.array(total[point])], ["point", "n"])

    counts, table = np.full(0x110000, 0.5), class_table()
    for r in texts.select("text").mapInArrow(run, "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n")).collect():
        counts[r["point"]] += r["n"]
    return -np.log(counts / np.bincount(table, counts, CLASSES)[table]).astype(np.float32)


def spelling_costs(words: list[str], costs: np.ndarray, table: np.ndarray, within: np.ndarray) -> np.ndarray:
    """-log p of the spelling of each word, its end included: of the classes, and of the characters ``within`` them."""
    buf, off = W.string_parts(pa.array([f" {w} " for w in words], pa.string()))
    code, at = gram_codes(buf, off, table)
    total = np.zeros(len(code) + 1)
    np.cumsum(costs[code] + within[code_points(buf, off)[0]], dtype=np.float64, out=total[1:])
    return total[at[1:]] - total[at[:-1] + 1]


def kind_table() -> np.ndarray:
    """What each code point is to ``_WORD``: 0 white space, then the constants below."""
    out = np.full(0x110000, MARK, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalnum() or c == "_":
            out[point] = LETTER
        elif c.isspace():
            out[point] = 0
    for low, high in [*(r for name in ("han", "kana", "thai", "lao", "khmer") for r in SCRIPTS[name]), (0x1000, 0x109F)]:
        part = out[low:high + 1]
        part[:] = np.where(part == LETTER, SINGLE, np.where(part == MARK, SIGN, part))
    out[ord("\n")] = NEW_LINE
    return out


def word_spans(buf: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, n): byte spans of all matches of ``_WORD`` in texts given as bytes, and how many each text has."""
    points, at = code_points(buf, off)
    kind = kinds[points]
    edge = np.zeros(len(kind) + 1, dtype=bool)
    edge[at] = True
    changed = edge[:-1].copy()
    changed[1:] |= kind[1:] != kind[:-1]
    start = (changed & np.isin(kind, [LETTER, NEW_LINE])) | (kind == SINGLE)
    # A run of marks takes in the signs behind its first mark; a sign before that is a word.
    among = np.isin(kind, [MARK, SIGN])
    begins = edge[:-1].copy()
    begins[1:] |= ~among[:-1]
    begins = np.flatnonzero(begins & among)
    if len(begins):
        marks = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(kind == MARK, out=marks[1:])
        here = np.flatnonzero(among)
        run = begins[np.searchsorted(begins, here, "right") - 1]
        start[here[marks[here] == marks[run]]] = True
    stops = np.flatnonzero(np.append(start | (kind == 0), True) | edge)
    start = np.flatnonzero(start)
    end = stops[np.searchsorted(stops, start) + 1] if len(start) else start
    place = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    return place[start], place[end], np.diff(np.searchsorted(start, at))


def coded_words(buf: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, codes, sizes): the different words, all words in turn as places in that list, and how many each text has."""
    found, sizes = [], []
    for _, _, part, at in W.pieces(buf, off):
        start, end, n = word_spans(part, at, kinds)
        # Words touch, so each is copied: from its start on, one byte after the other.
        size = end - start
        edges = np.append(0, np.cumsum(size))
        taken = part[np.arange(edges[-1]) + np.repeat(start - edges[:-1], size)]
        found.append(pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(taken)]))
        sizes.append(n)
    encoded = pa.chunked_array(found, pa.large_binary()).dictionary_encode().combine_chunks()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.chunk(0)
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False), np.concatenate([np.zeros(0, np.int64), *sizes])


def lay_out(docs: DataFrame) -> DataFrame:
    """Blocks of about BLOCK_BYTES of the texts of one language and half of ``docs`` (doc_id, lang, key, half, known, text).

    A block holds neighbouring rows of one partition: its different words, and all its words as places among them.
    The numbers of the blocks hold once the result is staged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(kind_table())
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = ["blk", "lang", "key", "half", "n", "doc_ids", "chars", "known", "sizes", "words", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
        weight: dict[tuple[int, int], int] = {}
        blk = TaskContext.get().partitionId() << 32

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal blk
            weight.pop(key)
            part = pa.Table.from_batches(held.pop(key)).combine_chunks().to_batches()[0]
            text = part.column("text")
            words, codes, sizes = coded_words(*W.string_parts(text), shared.value)
            chars = pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())
            blk += 1
            return pa.RecordBatch.from_arrays([
                pa.array([blk - 1]), part.column("lang").slice(0, 1), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                pa.array([len(codes)], pa.int64()), one(part.column("doc_id")), one(chars), one(part.column("known")),
                one(pa.array(sizes, pa.int64())), pa.array([P._pack(words)], pa.binary()),
                pa.array([P._planes(codes.astype(np.int32))], pa.binary())], names)

        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                keys, halves = batch.column("key").to_numpy(), batch.column("half").to_numpy()
                size = np.diff(W.string_parts(batch.column("text"))[1])
                for key in sorted({*zip(keys.tolist(), halves.tolist())}):
                    mine = np.flatnonzero((keys == key[0]) & (halves == key[1]))
                    held.setdefault(key, []).append(batch.take(pa.array(mine)))
                    weight[key] = weight.get(key, 0) + int(size[mine].sum())
                    if weight[key] >= BLOCK_BYTES:
                        yield block(key)
                while sum(weight.values()) >= HELD_BYTES:
                    yield block(max(weight, key=weight.get))
        for key in list(held):
            yield block(key)

    return docs.mapInArrow(run, f"blk bigint, lang {kinds['lang']}, key bigint, half int, n bigint, doc_ids array<{kinds['doc_id']}>, "
                                "chars array<bigint>, known array<boolean>, sizes array<bigint>, words binary, codes binary")


def block_pairs(block: dict, k: int | None = None) -> dict[str, np.ndarray]:
    """Of each word of a block, or of those whose word before belongs to round ``k`` (``key``, ``words``, ``codes``, ``sizes``): text, code, before (a code; the number of
    words in front of the first) and pair, a hash of key, the word before (0 in front of the first) and the word; and ``hashes`` and ``rounds`` of the words."""
    words = P._words(block["words"])
    code = P._whole(block["codes"], np.int32)
    hashes = np.append(P._word_hashes(words) if words else np.zeros(0, np.uint64), np.uint64(0))
    sizes = np.asarray(block["sizes"], np.int64)
    before = np.full(len(code), len(words), np.int32)
    before[1:] = code[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(words)
    base = np.uint64(W.BASE)
    context = W.mix(W.mix(np.array([block["key"]], np.int64).view(np.uint64)) * base + hashes)
    rounds = P._home(W.mix(hashes), ROUNDS)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if k is not None:
        mine = np.flatnonzero((rounds == k)[before])
        text, code, before = text[mine], code[mine], before[mine]
    return {"text": text, "code": code, "before": before, "hashes": hashes, "rounds": rounds, "pair": W.mix(context[before] * base + hashes[code])}


def text_pairs(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The different pairs of each text of :func:`block_pairs`: text, pair, place (among all pairs in order; ``rounds`` has those of all), before and word (codes), n, and the share of
    the pair, its first use left out, in the text's uses of before."""
    pair, at, place = np.unique(got["pair"], return_index=True, return_inverse=True)
    both = np.sort(got["text"].astype(np.int64) * len(pair) + place)
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    n = np.diff(np.append(first, len(both)))
    text, place = both[first] // len(pair), both[first] % len(pair)
    before = got["before"][at][place]
    _, context = np.unique(text * len(got["hashes"]) + before, return_inverse=True)
    return {"text": text, "pair": pair[place], "place": place, "before": before, "word": got["code"][at][place], "n": n,
            "again": (n - 1) / np.bincount(context, n)[context], "rounds": got["rounds"][got["before"][at]]}


def word_pairs(texts: list[str], keys: np.ndarray, costs: np.ndarray, table: np.ndarray,
               within: np.ndarray) -> dict[str, np.ndarray]:
    """The different pairs of neighbouring words of each text: text, pair, before, word (hashes, 0 before the first), n,
    the share of the pair, its first use left out, in the text's uses of before, and the spelling cost of word."""
    names = ["text", "pair", "before", "word", "n", "again", "spelling"]
    found: list[dict[str, np.ndarray]] = [{c: np.zeros(0, np.int64) for c in names}]
    for key in np.unique(keys):
        mine = np.flatnonzero(keys == key)
        words, codes, sizes = coded_words(*W.string_parts(pa.array([texts[k] for k in mine], pa.string())), kind_table())
        if not len(codes):
            continue
        got = block_pairs({"key": int(key), "words": P._pack(words), "codes": P._planes(codes.astype(np.int32)), "sizes": sizes})
        some, hashes = text_pairs(got), got["hashes"].view(np.int64)
        found.append({"text": mine[some["text"]], "pair": some["pair"].view(np.int64), "before": hashes[some["before"]], "word": hashes[some["word"]],
                      "n": some["n"], "again": some["again"], "spelling": spelling_costs([w.decode() for w in words], costs, table, within)[some["word"]]})
    return {c: np.concatenate([f[c] for f in found]) for c in names}


_SENT = "home int, key bigint, half int, blk bigint, pairs binary, known binary, before binary, word binary"
_HOME = "home int, key bigint, half int, blk bigint, counts binary, stats binary"
STATS = "total", "n1", "n2", "n3", "n4", "more", "preceded"


def sent_pairs(block: dict, k: int, each: int) -> Iterator[dict]:
    """The different pairs of a block in round ``k`` of ``each`` homes, a row per home: their hashes in order, how often
    trusted texts have them, and the words of those that they have."""
    got = block_pairs(block, k)
    if not len(got["pair"]):
        return
    some = np.argsort(got["pair"], kind="stable")
    pair = got["pair"][some]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    known = np.add.reduceat(np.asarray(block["known"], np.int64)[got["text"][some]], first)
    some, pair = some[first], pair[first]
    home = k * each + P._home(pair, each)
    before, word = got["hashes"][got["before"][some]], got["hashes"][got["code"][some]]
    cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(home)]):
        n = known[a:b]
        yield {"home": int(home[a]), "key": block["key"], "half": block["half"], "blk": block["blk"], "pairs": P._planes(np.diff(pair[a:b], prepend=np.uint64(0))),
               "known": P._planes(n), "before": P._planes(before[a:b][n > 0]), "word": P._planes(word[a:b][n > 0])}


def at_home(table: pa.Table) -> pa.Table:
    """Of the pairs that the blocks sent to one home: for each block how often the other half's trusted texts have each of
    its pairs, and for each language and half the sums of STATS by word, its different pairs counted as of the first or second word."""
    rows = table.to_pylist()
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for row in rows:
        row["pairs"] = np.cumsum(P._whole(row["pairs"], np.uint64), dtype=np.uint64)
        row["known"] = P._whole(row["known"], np.int64)
    for half in (0, 1):
        mine = [r for r in rows if r["half"] == half]
        pair, at, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *[r["pairs"][r["known"] > 0] for r in mine]]),
                                   return_index=True, return_inverse=True)
        n = np.bincount(code, np.concatenate([np.zeros(0), *[r["known"][r["known"] > 0] for r in mine]]), len(pair)).astype(np.int64)
        kept[half] = pair, n
        if not len(pair):
            continue
        before = np.concatenate([P._whole(r["before"], np.uint64) for r in mine])[at]
        word = np.concatenate([P._whole(r["word"], np.uint64) for r in mine])[at]
        key = np.repeat([r["key"] for r in mine], [int((r["known"] > 0).sum()) for r in mine])[at]
        for one in np.unique(key):
            of = key == one
            words, place = np.unique(np.concatenate([before[of], word[of]]), return_inverse=True)
            head, tail, m = place[:of.sum()], place[of.sum():], n[of]
            sums = [np.bincount(head, w, len(words)) for w in (m, m == 1, m == 2, m == 3, m == 4, m > 4)]
            stats = np.stack([words.view(np.int64), *[x.astype(np.int64) for x in (*sums, np.bincount(tail, minlength=len(words)))]], 1)
            out.append({"home": rows[0]["home"], "key": int(one), "half": half, "stats": P._planes(stats)})
    for r in rows:
        pair, n = kept[1 - r["half"]]
        counts = np.zeros(len(r["pairs"]), np.int32)
        if len(pair):
            at = np.minimum(np.searchsorted(pair, r["pairs"]), len(pair) - 1)
            same = pair[at] == r["pairs"]
            counts[same] = n[at[same]]
        out.append({"home": r["home"], "key": r["key"], "half": r["half"], "blk": r["blk"], "counts": P._planes(counts)})
    return pa.Table.from_pylist(out, P._arrow(_HOME))


def meet_homes(blocks: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stages (blk, home, counts) and of :func:`word_stats` of what the homes return (:func:`at_home`), one for each round.

    The word before decides on the round of a pair, its hash on the home, so a frequent word has no home of its own.
    The files of a round are dropped before the next begins.
    """
    spark = blocks.sparkSession
    words = blocks.agg(F.sum("n")).first()[0] or 0
    each = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // (ROUNDS * HOME_WORDS)))
    answers, stats = [], []
    for k in range(ROUNDS):
        def send(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for row in sent_pairs(batch.slice(i, 1).to_pylist()[0], k, each):
                        yield pa.RecordBatch.from_pylist([row], P._arrow(_SENT))

        sent = blocks.select("blk", "key", "half", "known", "sizes", "words", "codes").mapInArrow(send, _SENT)
        homes = staged(sent.groupBy("home").applyInArrow(at_home, _HOME), "homes")
        drop_stage(spark.range(0))
        stats.append(staged(word_stats(homes), "counts"))
        answers.append(staged(homes.filter("counts is not null").select("blk", "home", "counts"), "answers"))
        drop_stage(homes)
    return answers, stats


def word_stats(homes: DataFrame) -> DataFrame:
    """(half, key, word, STATS...) over all homes."""
    names = ["half", "key", "word", *STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stats = P._whole(row["stats"], np.int64, 1 + len(STATS))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(stats), row["half"], np.int32)), pa.array(np.full(len(stats), row["key"], np.int64)),
                    *[pa.array(np.ascontiguousarray(c)) for c in stats.T]], names)

    rows = homes.filter("stats is not null").select("half", "key", "stats").mapInArrow(
        run, "half int, key bigint, " + ", ".join(f"{c} bigint" for c in names[2:]))
    return rows.groupBy(*names[:3]).agg(*[F.sum(c).alias(c) for c in STATS])


def discounts() -> list[Column]:
    """d1, d2, d3 of modified Kneser-Ney from n1 to n4."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return [F.when((F.col("n1") > 0) & (F.col(f"n{r}") > 0),
                   F.least(F.greatest(r - (r + 1) * y * F.col(f"n{r + 1}") / F.col(f"n{r}"), F.lit(0.1)), F.lit(r - 0.05))
                   ).otherwise(0.5).alias(f"d{r}") for r in (1, 2, 3)]


def discounted(counts: DataFrame, context: list[str], model: str) -> tuple[DataFrame, DataFrame]:
    """(``counts`` with ``share``, contexts with ``rest``): Kneser-Ney shares of the seen and the mass left to the shorter context.

    ``counts`` has n; the discounts are those of each ``model`` (a column).
    """
    of = counts.groupBy(model).agg(*[F.sum((F.col("n") == r).cast("double")).alias(f"n{r}") for r in (1, 2, 3, 4)])
    of = of.select(model, *discounts())
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    counts = sized_join(counts, of, [model]).withColumn("off", off).drop("d1", "d2", "d3")
    totals = staged(counts.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("rest")), "totals")
    shares = counts.join(totals.select(*context, "total"), context).withColumn("share", (F.col("n") - F.col("off")) / F.col("total"))
    return staged(shares.drop("n", "off", "total"), "shares"), totals.drop("total")


def word_model(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, sides) of :func:`word_stats`.

    ``words`` (half, word): ``s0``, the share of the word among those of all languages, and ``by_key`` for each language
    ``total`` and ``r2`` of the word as a context, and ``s1``, its share among the words of the language; ``sides`` (half, key): the
    discounts of pairs and the masses ``r1`` and ``r0`` left behind words and behind words of all languages.
    """
    stats = stats.withColumn("side", F.xxhash64("half", "key"))
    words = staged(stats.filter("preceded > 0").select("half", "side", "word", F.col("preceded").alias("n")), "counts")
    every = staged(words.groupBy("half", "word").agg(F.sum("n").alias("n")), "counts")
    share1, rest1 = discounted(words, ["side"], "side")
    share0, rest0 = discounted(every, ["half"], "half")
    sides = stats.groupBy("half", "key", "side").agg(*[F.sum(c).cast("double").alias(c) for c in ("n1", "n2", "n3", "n4")])
    sides = staged(sides.select("half", "key", "side", *discounts()), "sides")
    seen = sized_join(stats, sides.select("side", "d1", "d2", "d3"), ["side"])
    rest2 = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("n3") + F.col("n4") + F.col("more"))) / F.col("total")
    seen = seen.select("half", "key", "side", "word", "total", F.when(F.col("total") > 0, rest2).alias("r2"))
    seen = seen.join(share1.select("side", "word", F.col("share").alias("s1")), ["side", "word"], "left").groupBy("half", "word").agg(
        F.collect_list(F.struct("key", "total", "r2", "s1")).alias("by_key"))
    seen = staged(seen.join(share0.select("half", "word", F.col("share").alias("s0")), ["half", "word"], "left"), "model")
    sides = sized_join(sides, rest1.withColumnRenamed("rest", "r1"), ["side"], "left").drop("side")
    sides = sides.join(rest0.withColumnRenamed("rest", "r0"), "half", "full")
    sides = staged(sides, "sides")
    drop_stage(words, every, share1, share0, rest1, rest0)
    return seen, sides


def block_words(blocks: DataFrame) -> DataFrame:
    """(blk, half, key, word, place): the different words of each block, and the start of a text, of the half that prices them."""
    names = ["blk", "half", "key", "word", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = P._words(row["words"])
                word = np.append(P._word_hashes(words) if words else np.zeros(0, np.uint64), np.uint64(0)).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(word), row["blk"], np.int64)), pa.array(np.full(len(word), 1 - row["half"], np.int32)),
                    pa.array(np.full(len(word), row["key"], np.int64)), pa.array(word), pa.array(np.arange(len(word), dtype=np.int32))], names)

    return blocks.select("blk", "half", "key", "words").mapInArrow(run, "blk bigint, half int, key bigint, word bigint, place int")


def text_costs(block: dict, counts: np.ndarray, values: dict[str, np.ndarray], spelling: np.ndarray) -> np.ndarray:
    """-log p of each text of a block, nan for one without words.

    ``counts`` are the trusted uses of its different pairs in order of their rounds and hashes, ``values`` by word the columns r2, total, s1 and s0.
    Pairs, then words of the language, then words of all languages, then the spelling.
    """
    sizes = np.asarray(block["sizes"], np.int64)
    total = np.full(len(sizes), np.nan)
    if not sizes.any():
        return total
    got = block_pairs(block)
    some = text_pairs(got)
    if len(some["rounds"]) != len(counts):
        raise ValueError("a block's answers do not fit its pairs")
    known = np.empty_like(counts)
    known[np.argsort(some["rounds"], kind="stable")] = counts
    before, word, n, counts = some["before"], some["word"], some["n"], known[some["place"]]
    r1, r0 = (1.0 if block[c] is None else block[c] for c in ("r1", "r0"))
    r2 = values["r2"][before]
    off = np.array([0.0, *[0.5 if block[c] is None else block[c] for c in ("d1", "d2", "d3")]])[np.minimum(counts, 3)]
    s2 = np.where(counts > 0, (counts - off) / np.maximum(values["total"][before], 1), 0.0)
    seen = s2 + r2 * (values["s1"][word] + r1 * values["s0"][word])
    with np.errstate(divide="ignore"):
        cost = np.where(seen > 0, -np.log(seen + r2 * r1 * r0 * np.exp(-spelling[word])), spelling[word] - np.log(r2 * r1 * r0))
    again = np.flatnonzero(n > 1)
    cost[again] -= (n[again] - 1) * np.log((1 - CACHE) * np.exp(-cost[again]) + CACHE * some["again"][again])
    sums = np.bincount(some["text"], cost, len(sizes))
    return np.where(sizes > 0, sums, total)


def perplexities(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, lang, text): doc_id, lang, chars and perplexity; null for a text without words.

    Repeats of a pair in a text are cheap, by the share they have in it, so repetition has a low perplexity.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    lang = F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))
    texts = staged(sized_join(docs, trusted_ids, ["doc_id"]), "trusted")
    model = kneser_ney(count_grams(texts))
    costs, within = cost_table(model), character_costs(texts)
    drop_stage(texts, *model)
    marked = sized_join(docs, trusted_ids.withColumn("known", F.lit(True)), ["doc_id"], "left")
    blocks = staged(lay_out(marked.select("doc_id", "lang", F.xxhash64(lang).alias("key"), half.alias("half"),
                                          F.coalesce("known", F.lit(False)).alias("known"), "text")), "blocks")
    met, parts = meet_homes(blocks)
    answers, stats = (functools.reduce(DataFrame.unionByName, x) for x in (met, parts))
    stats = staged(stats.groupBy("half", "key", "word").agg(*[F.sum(c).alias(c) for c in STATS]), "counts")
    drop_stage(*parts)
    words, sides = word_model(stats)
    drop_stage(stats)
    shared = spark.sparkContext.broadcast({"costs": costs, "table": class_table(), "within": within})
    names = ["doc_id", "lang", "chars", "perplexity"]

    def price(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.filter(pc.is_valid(left["words"])).to_pylist()[0]
        rest = left.filter(pc.is_valid(left["counts"])).sort_by("home")["counts"].to_pylist()
        counts = np.concatenate([np.zeros(0, np.int32), *[P._whole(x, np.int32) for x in rest]])
        right = right.sort_by("place")
        values = {c: pc.fill_null(right[c].combine_chunks().cast(pa.float64()), fill).to_numpy(zero_copy_only=False)
                  for c, fill in (("r2", 1.0), ("total", 0.0), ("s1", 0.0), ("s0", 0.0))}
        known = [w.decode() for w in P._words(block["words"])]
        held = shared.value
        spelling = spelling_costs(known, held["costs"], held["table"], held["within"]) if known else np.zeros(0)
        chars = np.asarray(block["chars"], np.int64)
        perplexity = np.exp(text_costs(block, counts, values, spelling) / np.maximum(chars, 1))
        one = left.filter(pc.is_valid(left["words"]))
        return pa.table([pc.list_flatten(one["doc_ids"]), pa.chunked_array([pa.array([block["lang"]] * len(chars), one["lang"].type)]),
                         pa.array(chars), pa.array(perplexity, mask=np.isnan(perplexity))], names)

    found = []
    for k in range(ROUNDS):
        mine = F.pmod(F.xxhash64("blk"), F.lit(ROUNDS)) == k
        some = blocks.filter(mine)
        asked = block_words(some).join(words, ["half", "word"], "left")
        of = F.filter("by_key", lambda x: x["key"] == F.col("key"))
        asked = asked.select("blk", "place", "s0", F.get(of, F.lit(0)).alias("own")).select("blk", "place", "own.r2", "own.total", "own.s1", "s0")
        other = sides.withColumn("half", 1 - F.col("half"))
        with_sides = sized_join(some.drop("n", "known"), other.filter("key is not null").select("half", "key", "d1", "d2", "d3", "r1"), ["half", "key"], "left")
        with_sides = sized_join(with_sides, other.select("half", "r0").distinct(), ["half"], "left")
        held = with_sides.unionByName(answers.filter(mine), True)
        found.append(staged(held.groupBy("blk").cogroup(asked.groupBy("blk")).applyInArrow(
            price, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, chars bigint, perplexity double"), "priced"))
        drop_stage(spark.range(0))
    drop_stage(blocks, *met, words)
    return functools.reduce(DataFrame.unionByName, found)


def classify_quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", quantiles: tuple[float, float] = QUANTILES,
                     shrink: float = SHRINK) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, perplexity (per character), lowest and highest allowed, and kept.

    ``trusted_ids`` has the ids of the texts to learn from (column as ``id_col``); all of
    them are counted.  Perplexities are compared by their logarithm with the level of the
    language: the median of its trusted texts, with the median of all its texts as
    LEVEL_SHRINK texts more.  The limits are quantiles of what trusted texts are apart from
    that, of the language and of all languages, which count as ``shrink`` texts more; so
    one rule holds for any number of trusted texts, also none.  Limits are wider for texts
    of few characters; a null language is one of its own.  A null or empty text has
    no perplexity and is not kept, nor has a text without words; without trusted texts there are no limits and every text
    with characters is kept.  Very long texts are read whole; repeated rows and null ids are
    rows of their own; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    trusted_ids = trusted_ids.select(F.col(id_col).alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
    scored = staged(perplexities(docs, trusted_ids).withColumn(
        "key", F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit("n"))), "scored")
    logs = scored.withColumn("x", F.log("perplexity"))
    known = staged(sized_join(logs.filter("x is not null").select("doc_id", "key", "x", "chars"), trusted_ids, ["doc_id"]), "known")
    middle = F.percentile_approx("x", 0.5, 10_000)
    n = F.coalesce("n", F.lit(0))
    levels = logs.groupBy("key").agg(middle.alias("all")).join(
        known.groupBy("key").agg(middle.alias("own"), F.count("*").alias("n")), "key", "left")
    levels = staged(levels.select("key", n.alias("n"), (
        (n * F.coalesce("own", F.lit(0.0)) + LEVEL_SHRINK * F.col("all")) / (n + LEVEL_SHRINK)).alias("level")), "levels")
    part = F.when(F.col("chars") > 0, F.col("chars") / (F.col("chars") + PRIOR_CHARS))
    known = sized_join(known, levels, ["key"]).withColumn("apart", (F.col("x") - F.col("level")) * part)
    limits = [F.percentile_approx("apart", q, 10_000) for q in quantiles]
    everything = known.agg(*limits).first()
    own = known.groupBy("key").agg(limits[0].alias("low"), limits[1].alias("high"))
    joined = sized_join(logs, levels.join(own, "key", "left"), ["key"], "left")
    lowest, highest = (
        F.exp(F.col("level") + (n * F.coalesce(c, F.lit(0.0)) + shrink * F.lit(v).cast("double")) / (n + shrink) / part)
        for c, v in zip(("low", "high"), everything))
    inside = F.coalesce(F.col("perplexity") >= lowest, F.lit(True)) & F.coalesce(F.col("perplexity") <= highest, F.lit(True))
    return joined.select("doc_id", "lang", "perplexity", lowest.alias("lowest"), highest.alias("highest"),
                         (F.col("perplexity").isNotNull() & inside).alias("kept"))
