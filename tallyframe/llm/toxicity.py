"""Toxicity of texts whose words may be written in disguise.

A noisy channel turns letters into look-alikes, spreads them out or repeats them.
Words that show such signs become lattices: each character may stand for a letter, for
a space or for nothing, at a cost.  Viterbi decodes a lattice under a character trigram
model counted over the whole corpus.  The restored text is scored by marker words and
word beginnings learnt from labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.characters import code_points, letter_tables, runs, use_tables
from tallyframe.llm.components import staged
from tallyframe.llm.simhash import component_roots

#: What a character may stand for besides itself (fixed values).
LOOK_ALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a",
               "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LETTERS = 28  # 0: border, 1..26: a..z, 27: any other letter
FIT_ROWS = 10_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
SURE, LEAST = 0.98, 0.01
EXPLAINED = 0.5
COPY_KEYS = 4
#: Costs in the channel (negative logarithms).
AS_LETTER, AS_ITSELF, DROPPED, GAP, BORDER, SECOND, FURTHER = 1.0, 6.0, 6.0, 0.2, 1.0, 4.0, 0.1
CACHE = 1 << 16


def folded() -> np.ndarray:
    return letter_tables()[2]


def count_letters(docs: DataFrame) -> DataFrame:
    """(code, n): letter trigrams of all words of the corpus, word borders included."""
    tables = docs.sparkSession.sparkContext.broadcast(letter_tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_tables(tables.value)
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            buf, off = W.string_parts(batch.column(0))
            for _, _, part, cut in W.pieces(buf, off):
                points, at = code_points(part, cut)
                # Two borders before each text; a run of other characters is one place long or more.
                kinds = np.insert(folded()[points], np.repeat(at[:-1], 2), 0).astype(np.int32)
                code = (kinds[:-2] * LETTERS + kinds[1:-1]) * LETTERS + kinds[2:]
                total += np.bincount(code, minlength=LETTERS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def letter_costs(counts: np.ndarray) -> list[float]:
    """-log p(third | first two) per trigram code, interpolated with the shorter contexts (Witten-Bell)."""
    full = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    one = (full.sum(axis=(0, 1)) + 1) / (full.sum() + LETTERS)

    def mixed(table: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total, kinds = table.sum(axis=-1, keepdims=True), (table > 0).sum(axis=-1, keepdims=True)
        return (table + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))

    two = mixed(full.sum(axis=0), one)
    return (-np.log(mixed(full, two[None, :, :]))).reshape(-1).tolist()


def decode(observed: str, costs: list[float]) -> str:
    """The likeliest text behind ``observed``, by Viterbi over its lattice; the state is the last two letters."""
    kinds = folded()
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # (letter before last, last) -> cost, text as linked list
    last, run = "", 0
    chars = observed.lower()
    if not any(kinds[ord(c)] for c in chars):
        return chars
    # Behind the last letter a look-alike is most likely a mark or a number.
    letters_follow = [any(kinds[ord(c)] for c in chars[k + 1:k + 4]) for k in range(len(chars))]
    for k, char in enumerate(chars):
        point = ord(char)
        kind = int(kinds[point])
        run = run + 1 if char == last else 1
        last = char
        arcs: list[tuple[int, str, float]] = []  # letter, written as, cost; letter -1 stands for nothing
        if kind:
            arcs.append((kind, char, 0.0))
            if run > 1:
                arcs.append((-1, "", SECOND if run == 2 and (k + 1 == len(chars) or chars[k + 1] != char) else FURTHER))
        elif char in LOOK_ALIKES:
            arcs += [(ord(c) - 96, c, AS_LETTER) for c in LOOK_ALIKES[char]]
            arcs.append((0, char, AS_ITSELF if letters_follow[k] else BORDER))
            if run > 1 or not char.isalnum():
                arcs.append((-1, "", DROPPED if run == 1 and letters_follow[k] else FURTHER))
        elif char.isalnum():
            arcs.append((0, char, 0.0))
        else:
            arcs += [(-1, "", GAP), (0, " ", BORDER)]
        new: dict[int, tuple[float, tuple]] = {}
        for state, (cost, text) in states.items():
            for letter, written, price in arcs:
                if letter < 0:
                    goal, total, grown = state, cost + price, text
                else:
                    code = state * LETTERS + letter
                    goal, total = code % (LETTERS * LETTERS), cost + price + costs[code]
                    grown = (text, written)
                held = new.get(goal)
                if held is None or total < held[0]:
                    new[goal] = (total, grown)
        states = new
    _, text = min(((cost + costs[state * LETTERS], text) for state, (cost, text) in states.items()), key=lambda s: s[0])
    out = []
    while text:
        text, written = text
        out.append(written)
    return "".join(reversed(out))


_LIKE = np.array(sorted(ord(c) for c in LOOK_ALIKES), np.uint32)
_STRONG = np.array(sorted(ord(c) for c in LOOK_ALIKES if c.isdigit() or c in "@€£"), np.uint32)
#: Bytes of a character by its first byte.
_WIDTH = np.select([np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 2, 3], 4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def disguised(buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that show signs of disguise: marks or look-alikes among letters, repeats, letters set apart."""
    start, end, first = W.spans(buf, off)
    if not len(start):
        return []
    points, _ = code_points(buf, off)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    kinds = folded()[points] > 0
    looks = np.isin(points, _LIKE)
    letter, like = np.zeros(len(buf), dtype=bool), np.zeros(len(buf), dtype=bool)
    letter[lead], like[lead] = kinds, looks
    total = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(letter, out=total[1:])
    sign = np.zeros(len(start), dtype=bool)

    def word_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(start, at, "right") - 1

    at = lead[~kinds & ((buf[lead] > 0x20) | (buf[lead] < 0x09))]
    word = np.maximum(word_of(at), 0)
    inside = (at < end[word]) & (total[end[word]] > total[at]) & (total[at] > total[start[word]])
    sign[word[inside]] = True
    at = lead[looks]
    word = word_of(at)
    strong = np.isin(points[looks], _STRONG) & (total[end[word]] > total[start[word]])
    leads = (at == start[word]) & (total[end[word]] > total[at])
    sign[word[strong | leads]] = True
    small = letter_tables()[1][points]
    word = np.maximum(word_of(lead), 0)
    twice = kinds[1:] & (small[1:] == small[:-1]) & (word[1:] == word[:-1])
    sign[word[:-1][twice]] = True
    # Three or more single characters in a row.
    size = end - start
    single = (size == 1) & (letter[start] | like[start]) | (size > 1) & (letter[start] | like[start]) & (size == _WIDTH[buf[start]])
    begin, stop, _ = runs(single, first)
    many = stop - begin >= 3
    spans = [(int(start[a]), int(end[b - 1])) for a, b in zip(begin[many].tolist(), stop[many].tolist())]
    covered = np.zeros(len(start), dtype=bool)
    for a, b in zip(begin[many].tolist(), stop[many].tolist()):
        covered[a:b] = True
    rest = np.flatnonzero(sign & ~covered)
    return sorted(spans + list(zip(start[rest].tolist(), end[rest].tolist())))


def restore(buf: np.ndarray, off: np.ndarray, costs: list[float], cache: dict[bytes, bytes]):
    """(bytes, offsets, [(text, observed, restored)]) with disguised spans decoded."""
    spans = disguised(buf, off)
    raw = buf.tobytes()
    parts, grown, found, at = [], np.zeros(len(off), np.int64), [], 0
    for a, b in spans:
        observed = raw[a:b]
        known = cache.get(observed)
        if known is None:
            if len(cache) >= CACHE:
                cache.clear()
            known = cache[observed] = decode(observed.decode("utf-8"), costs).encode("utf-8")
        parts += [raw[at:a], known]
        at = b
        text = int(np.searchsorted(off, a, "right")) - 1
        grown[text + 1] += len(known) - (b - a)
        if known != observed.lower():
            found.append((text, observed.decode("utf-8"), known.decode("utf-8")))
    parts.append(raw[at:])
    return np.frombuffer(b"".join(parts), np.uint8), off + np.cumsum(grown), found


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of all words and word beginnings; letters i and l count as one.

    A slot is a 63-bit hash; its two lowest bits tell whole words (0) from beginnings.
    """
    points, at = code_points(buf, off)
    kinds = folded()[points].astype(np.uint64)
    start, end, first = runs(kinds > 0, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Letters without a Latin base keep their own value.
    kinds = np.where(kinds == 27, points.astype(np.uint64), np.where(kinds == 12, np.uint64(9), kinds)) + np.uint64(1)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    span = W.span_hasher(kinds)
    texts, slots = [], []
    for which, length in enumerate((0, *PREFIXES)):
        some = np.flatnonzero(end - start > length) if length else slice(None)
        h = span(start[some], start[some] + length if length else end)
        texts.append(text[some])
        slots.append(((h >> np.uint64(3)) << np.uint64(2)).astype(np.int64) | which)
    return np.concatenate(texts), np.concatenate(slots)


def distinct_pairs(text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((slot, text))
    text, slot = text[order], slot[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (slot[1:] != slot[:-1])
    return text[new], slot[new]


def copy_keys(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """COPY_KEYS smallest hashes of runs of five words per text; copies of a text share some of them."""
    start, end, first = W.spans(buf, off)
    hashes = W.window_hashes(W.word_hashes(_LOWER[buf], start, end), 5)
    hashes[~W.within(first, 5, len(start))] = np.iinfo(np.uint64).max
    out = np.zeros((len(off) - 1, COPY_KEYS), np.uint64)
    for text, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        for k in range(COPY_KEYS):
            runs_of = hashes[a:max(a, b - 4)]
            out[text, k] = W.mix(runs_of ^ np.uint64(k + 1)).min() if len(runs_of) else np.uint64(off[text] + k)
    return out


def _fit_batches(shared, batches: Iterator[pa.RecordBatch]):
    """(labels, text and slot of each text's distinct slots, copy keys) per piece of labelled texts."""
    held = shared.value
    use_tables(held["tables"])
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        buf, off = W.string_parts(batch.column(0))
        for low, high, part, at in W.pieces(buf, off):
            text, slot = features(*restore(part, at, held["costs"], held["cache"])[:2])
            yield toxic[low:high], *distinct_pairs(text, slot), copy_keys(part, at)


def copy_groups(keys: np.ndarray) -> np.ndarray:
    """A group number per text; texts that share a key are one group."""
    n = len(keys)
    label = np.arange(n)
    for k in range(keys.shape[1]):
        order = np.argsort(keys[:, k], kind="stable")
        same = np.flatnonzero(keys[order[1:], k] == keys[order[:-1], k])
        label = component_roots(label, order[same], order[same + 1]) if len(same) else label
    return label


def choose_markers(slots: np.ndarray, toxic: np.ndarray, clean: np.ndarray, base: float, start: float,
                   docs: np.ndarray, held: np.ndarray) -> dict[int, float]:
    """{slot: chance}: slots that explain toxic texts.

    ``docs`` and ``held`` are pairs of a group of copies of a toxic text and the index of
    a slot it holds.  The slot with the most evidence goes first, of equals the whole
    word; a text that a chosen slot explains counts half for those that follow.
    """
    one, none = log(SURE / base), log((1 - SURE) / (1 - base))
    left = np.ones(int(docs.max()) + 1 if len(docs) else 0)
    open_ = np.ones(len(slots), dtype=bool)
    chosen: dict[int, float] = {}
    kind = slots & 3
    preference = np.where(kind == 0, 3, kind - 1) * 1e-3
    while len(docs):
        count = np.bincount(held, left[docs], minlength=len(slots))
        odds = np.where(open_, start + count * one + clean * none, -np.inf)
        best = int(np.argmax(odds + preference + 1e-6 * toxic))
        if odds[best] <= 0:
            break
        open_[best] = False
        chosen[int(slots[best])] = SURE / (1 + np.exp(-min(odds[best], 50.0)))
        left[docs[held == best]] = EXPLAINED
    return chosen


def fit_markers(train: DataFrame, costs: list[float]) -> dict[int, float]:
    """{slot: chance that a text holding it is toxic}, for the slots that are markers.

    ``train`` has text and toxic (0 or 1) and a bounded number of rows.  Each slot is
    weighed as a marker against the base rate; few slots are markers, so each starts at
    small odds.
    """
    train = train.select("text", F.col("toxic").cast("int"))
    context = train.sparkSession.sparkContext
    rows = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    base = (rows.get(1, 0) + 0.5) / (sum(rows.values()) + 1)
    shared = context.broadcast({"costs": costs, "cache": {}, "tables": letter_tables()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, text, slot, _ in _fit_batches(shared, batches):
            found, at = np.unique(slot, return_inverse=True)
            total = np.bincount(at, toxic[text], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(found), pa.array(np.bincount(at, minlength=len(found)) - total), pa.array(total)],
                ["slot", "clean", "toxic"])

    counted = train.mapInArrow(count, "slot bigint, clean bigint, toxic bigint").groupBy("slot").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    several = staged(counted.filter("toxic > 1"), "slots")
    least = log(20 / max(40, several.count()))
    odds = F.lit(least) + F.col("toxic") * log(SURE / base) + F.col("clean") * log((1 - SURE) / (1 - base))
    found = sorted((r["slot"], r["toxic"], r["clean"]) for r in several.filter(odds > 0).collect())
    if not found:
        return {}
    slots, toxic, clean = np.array(found, np.int64).T
    likely = context.broadcast(slots)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, text, slot, keys in _fit_batches(shared, batches):
            at = np.minimum(np.searchsorted(likely.value, slot), len(likely.value) - 1)
            mine = (likely.value[at] == slot) & (label[text] == 1)
            text, at = text[mine], at[mine]
            some = np.unique(text)
            lists = [at[text == t].astype(np.int32).tobytes() for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), pa.array(
                [keys[t].tobytes() for t in some], pa.binary())], ["held", "keys"])

    rows = train.mapInArrow(holders, "held binary, keys binary").collect()  # one per toxic text of the bounded sample
    lists = [np.frombuffer(r["held"], np.int32) for r in rows]
    keys = np.array([np.frombuffer(r["keys"], np.uint64) for r in rows], np.uint64).reshape(-1, COPY_KEYS)
    docs = np.repeat(copy_groups(keys), [len(x) for x in lists])
    held = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    docs, held = np.unique(np.stack([docs, held]), axis=1) if len(docs) else (docs, held)
    return choose_markers(slots, toxic, clean, base, least, docs, held)


class Markers:
    """Look-up of slots: a small bitmap first, then the sorted slots."""

    def __init__(self, chances: dict[int, float]):
        self.slots = np.array(sorted(chances), np.int64)
        self.miss = np.log1p(-np.array([chances[k] for k in sorted(chances)]))
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.slots >> 4) & 0xFFFF] = True

    def scores(self, text: np.ndarray, slot: np.ndarray, texts: int) -> np.ndarray:
        some = np.flatnonzero(self.maybe[(slot >> 4) & 0xFFFF])
        at = np.searchsorted(self.slots, slot[some])
        hit = np.append(self.slots, -1)[at] == slot[some]
        text, at = distinct_pairs(text[some[hit]], at[hit])
        return np.clip(1 - np.exp(np.bincount(text, self.miss[at], texts)) * (1 - LEAST), 0.0, 1.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD,
                   carry: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, score (0 to 1), predicted and the restored spans (observed, restored).

    With ``carry`` there is a column ``row``, too, a struct of all columns of the input.

    The character model counts all of ``docs``; labels and ids are no part of a score.
    ``labels`` (id and 0/1 label) are the rows to learn from: about ``fit_rows`` of the
    labelled ids, taken by hash, a documented bound.  Labels other than 0 and 1 and null
    ids teach nothing; an id labelled more than once counts as toxic if one label says
    so.  Null and empty texts score as texts without any marker; without labels all texts
    do.  Very long texts are read whole; repeated rows are rows of their own; other
    columns are not looked at.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = np.zeros(LETTERS**3, np.int64)
    for r in count_letters(docs).collect():
        counts[r["code"]] = r["n"]
    costs = letter_costs(counts)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = max(1, known.count() // fit_rows)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    chances = fit_markers(docs.join(F.broadcast(some), "doc_id"), costs)  # about fit_rows rows of 12 bytes
    shared = docs.sparkSession.sparkContext.broadcast(
        {"costs": costs, "cache": {}, "chances": chances, "tables": letter_tables()})
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs_type = pa.list_(pa.struct([("observed", pa.string()), ("restored", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        use_tables(held["tables"])
        markers = Markers(held["chances"])
        for batch in batches:
            ids, texts = (batch.column(0).field(c) for c in (id_col, text_col)) if carry else batch.columns
            buf, off = W.string_parts(texts)
            for low, high, part, at in W.pieces(buf, off):
                new, cut, found = restore(part, at, held["costs"], held["cache"])
                score = markers.scores(*features(new, cut), high - low)
                spans: list[list[dict]] = [[] for _ in range(high - low)]
                for text, observed, restored in found:
                    spans[text].append({"observed": observed, "restored": restored})
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, high - low), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                    pa.array(spans, pairs_type), *([W.nullable(batch.column(0).slice(low, high - low))] if carry else [])],
                    ["doc_id", "score", "predicted", "restored", *(["row"] if carry else [])])

    schema = f"doc_id {kind}, score double, predicted int, restored array<struct<observed:string,restored:string>>"
    if carry:
        return whole.mapInArrow(run, f"{schema}, row {whole.schema['row'].dataType.simpleString()}")
    return docs.mapInArrow(run, schema)
