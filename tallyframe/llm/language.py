"""Language of texts and of the spans of mixed texts.

Words are runs of letters.  The script of a word narrows the languages down to those
seen with that script; each of them scores the word by its letter trigrams; Viterbi
then labels the words of a text, paying a penalty for each change of language.  A
text is given the label that covers most of its letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.characters import SCRIPT_NAMES, code_points, letter_tables, runs, use_tables

SLOTS = 1 << 16
SWITCH = 8.0
SMOOTH = 0.1
#: A language is a candidate for a script that makes up at least this share of its letters.
SCRIPT_SHARE = 1e-3
CHUNK = 64
UNKNOWN = "und"


def _letters(buf: np.ndarray, off: np.ndarray):
    """Trigram slot per code point, its script, and the words."""
    script, lower, _ = letter_tables()
    points, at = code_points(buf, off)
    scripts = script[points]
    small = np.where(scripts > 0, lower[points], 0).astype(np.uint64)
    start, end, first = runs(scripts > 0, at)
    # A word is read with one blank on each side, whatever stands there.
    padded = np.concatenate([np.zeros(2, np.uint64), small, np.zeros(1, np.uint64)])
    edge = np.zeros(len(padded), dtype=bool)
    edge[at + 2] = True

    def slots(a, b, c):
        return (W.mix((a * np.uint64(0x200001) + b) * np.uint64(0x200001) + c) >> np.uint64(64 - 16)).astype(np.int32)

    size = end - start
    inner = slots(padded[:-2], padded[1:-1], padded[2:])  # trigram that ends at each code point or one behind
    zero = np.zeros(len(start), np.uint64)
    letters = small
    head = slots(zero, zero, letters[start]) if len(start) else np.zeros(0, np.int32)
    second = slots(zero, letters[start], np.where(size > 1, letters[np.minimum(start + 1, len(letters) - 1)], 0).astype(
        np.uint64)) if len(start) else head
    tail = slots(np.where(size > 1, letters[np.maximum(end - 2, 0)], 0).astype(np.uint64), letters[end - 1], zero) if len(
        start) else head
    inner = inner[:len(points)].copy()
    inner[start] = head
    long = size > 1
    inner[start[long] + 1] = second[long]
    return points, scripts, inner, tail, start, end, first


def count_trigrams(train: DataFrame) -> DataFrame:
    """(lang, slot, n) over whole texts; slots from SLOTS on are letters per script."""
    tables = train.sparkSession.sparkContext.broadcast(letter_tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_tables(tables.value)
        width = SLOTS + len(SCRIPT_NAMES)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            order = np.argsort(langs, kind="stable")
            names, at = np.unique(langs[order].astype(str), return_index=True) if len(order) else ([], [])
            for name, rows in zip(names, np.split(order, at[1:]) if len(at) else []):
                total = held.setdefault(str(name), np.zeros(width, np.int64))
                buf, off = W.string_parts(batch.column(1).take(pa.array(rows)))
                for _, _, part, cut in W.pieces(buf, off):
                    _, scripts, inner, tail, *_ = _letters(part, cut)
                    total[:SLOTS] += np.bincount(inner[scripts > 0], minlength=SLOTS) + np.bincount(tail, minlength=SLOTS)
                    total[SLOTS:] += np.bincount(scripts, minlength=len(SCRIPT_NAMES))
        for name, total in held.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()),
                                              pa.array(total[slot], pa.int64())], ["lang", "slot", "n"])

    counted = train.select("lang", "text").mapInArrow(run, "lang string, slot int, n bigint")
    return counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, chunk: int = CHUNK) -> np.ndarray:
    """Best label per word; ``scores`` is (words, labels), text i has words first[i]:first[i + 1].

    Texts are cut into chunks.  A chunk's best scores from every entry label to every
    exit label are a matrix of max and plus; matrices compose along a text, which gives
    each chunk its entry and exit label, and all chunks are traced back side by side.
    """
    words, labels = scores.shape
    out = np.zeros(words, np.int16)
    size = np.diff(first)
    lanes = -(-size // chunk)
    if not lanes.sum():
        return out
    text = np.repeat(np.arange(len(size)), lanes)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = first[text] + turn * chunk
    long = np.minimum(chunk, first[text + 1] - begin)
    at = np.minimum(begin[:, None] + np.arange(chunk), words - 1)
    live = np.arange(chunk) < long[:, None]
    best = np.full((len(text), labels, labels), -np.inf)
    best[:, np.arange(labels), np.arange(labels)] = 0.0
    for t in range(int(long.max())):
        moved = np.maximum(best, best.max(axis=2, keepdims=True) - penalty) + scores[at[:, t]][:, None, :]
        best = np.where(live[:, t][:, None, None], moved, best)
    enter = np.zeros((len(text), labels))
    lane_of = np.cumsum(lanes) - lanes
    for k in range(int(lanes.max())):
        own = lane_of[lanes > k] + k
        if k:
            enter[own] = (enter[own - 1][:, :, None] + best[own - 1]).max(axis=1)
    leave = np.zeros(len(text), np.int64)
    start = np.zeros(len(text), np.int64)
    for k in range(int(lanes.max()) - 1, -1, -1):
        own = lane_of[lanes > k] + k
        paths = enter[own][:, :, None] + best[own]
        last = lanes[text[own]] - 1 == k
        leave[own] = np.where(last, paths.max(axis=1).argmax(axis=1), start[np.minimum(own + 1, len(text) - 1)])
        start[own] = paths[np.arange(len(own)), :, leave[own]].argmax(axis=1)
    value = np.full((len(text), labels), -np.inf)
    value[np.arange(len(text)), start] = 0.0
    came = np.zeros((int(long.max()), len(text), labels), np.int16)
    for t in range(int(long.max())):
        top = value.argmax(axis=1)
        over = value.max(axis=1)[:, None] - penalty
        switch = over > value
        came[t] = np.where(switch, top[:, None], np.arange(labels))
        value = np.where(live[:, t][:, None], np.maximum(value, over) + scores[at[:, t]], value)
    now = leave
    for t in range(int(long.max()) - 1, -1, -1):
        use = live[:, t]
        out[at[use, t]] = now[use]
        now = np.where(use, came[t][np.arange(len(text)), now], now)
    return out


class Model:
    """Trigram scores and candidate scripts per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, letters = counts[:, :SLOTS], counts[:, SLOTS:].astype(float)
        share = (grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * SLOTS)
        self.table = np.ascontiguousarray(np.log(share).T.astype(np.float32))
        letters[:, 0] = 0
        seen = letters / np.maximum(1, letters.sum(axis=1, keepdims=True)) >= SCRIPT_SHARE
        # A script no language was seen with leaves all of them in.
        self.allowed = np.where(seen.any(axis=0), seen, True)

    def label(self, buf: np.ndarray, off: np.ndarray, penalty: float = SWITCH):
        """(start, end, label of each word, first word of each text)."""
        points, scripts, inner, tail, start, end, first = _letters(buf, off)
        if not len(start):
            return start, end, np.zeros(0, np.int16), first
        total = np.zeros((len(points) + 1, len(self.langs)))
        np.cumsum(self.table[inner], axis=0, out=total[1:])
        scores = total[end] - total[start] + self.table[tail]
        scores -= scores.max(axis=1, keepdims=True)
        allowed = self.allowed[:, scripts[start]].T
        scores = np.where(allowed, np.maximum(scores, -4 * penalty), -4 * penalty)
        return start, end, viterbi(scores, first, penalty), first

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Label, share of the letters it covers, and spans (first and last code point, label) of each text."""
        start, end, label, first = self.label(buf, off)
        n = len(off) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        covered = np.zeros((n, len(self.langs)))
        np.add.at(covered, (text, label), end - start)
        letters = covered.sum(axis=1)
        best = covered.argmax(axis=1)
        names = [self.langs[b] if some else UNKNOWN for b, some in zip(best.tolist(), letters > 0)]
        score = np.where(letters > 0, covered.max(axis=1) / np.maximum(letters, 1), 0.0)
        change = np.ones(len(label), dtype=bool)
        change[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(change)
        stop = np.append(at[1:], len(label)) - 1
        _, base = code_points(buf, off)
        spans: list[list[dict]] = [[] for _ in range(n)]
        for a, b in zip(at.tolist(), stop.tolist()):
            row = int(text[a])
            spans[row].append({"first": int(start[a] - base[row]), "last": int(end[b] - 1 - base[row]),
                               "lang": self.langs[label[a]]})
        return names, score, spans


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def identify(train: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (share of letters under that label) and spans.

    ``train`` has the texts and languages to learn from; its whole texts are counted on
    the cluster, and only (language, slot) sums reach the driver: at most SLOTS and a few
    per language code.  Rows of ``train`` without a language or text teach nothing.  A
    text that is null, empty or without letters is ``und`` with score 0 and no spans;
    so is every text when nothing was learnt.  Very long texts are read whole; ties go
    to the first language by code point; repeated rows and null ids are rows of their
    own; other columns are not looked at.
    """
    rows = count_trigrams(train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), SLOTS + len(SCRIPT_NAMES)), np.int64)
    number = {lang: k for k, lang in enumerate(langs)}
    for r in rows:
        counts[number[r["lang"]], r["slot"]] = r["n"]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({"langs": langs, "counts": counts, "tables": letter_tables()})
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<first:bigint,last:bigint,lang:string>>"
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        use_tables(held["tables"])
        if "model" not in held and held["langs"]:
            held["model"] = Model(held["langs"], held["counts"])
        for batch in batches:
            buf, off = W.string_parts(batch.column(1))
            for low, high, part, at in W.pieces(buf, off, 1 << 20):
                if held["langs"]:
                    names, score, spans = held["model"].predict(part, at)
                else:
                    names, score, spans = [UNKNOWN] * (high - low), np.zeros(high - low), [[]] * (high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(score),
                     pa.array(spans, spans_type)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.mapInArrow(run, schema)
