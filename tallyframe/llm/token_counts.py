"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The encoding of a text under merge ranks is the only token sequence whose
neighbouring tokens would stay apart if encoded alone.  So a left-to-right
machine needs to know, for every place from which a vocabulary piece can still
grow to the present place, the token that ends there and how many tokens lead up
to it.  That tuple is a state.  Reading a character gives the next state and the
change of the token count, the number on the transition.  States are determinised
as they are met and kept in a dense table, which is dropped when full.

No piece goes on over a space that follows another character, nor over a
character outside the vocabulary (those become bytes).  After such a place the
state does not depend on what came before.  Texts are cut into chunks that run in
lock-step; the state map of a chunk is constant behind its first such place, so
maps compose in one scan that gives every chunk its entry state, the heads are
run from it, and a prefix sum of the emitted counts gives the tokens per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W

LIMIT = 4096
CHUNK = 256
TABLE_CELLS = 32 << 20
FEW = 8

_SPACE = "▁"
_DEAD, _START = 1, 2
_BREAK, _RUN, _UNKNOWN, _FIRST = 1, 2, 2, 7


class _Full(Exception):
    """The transition table has no room."""


def read_vocabulary(path: str) -> dict[str, float]:
    """{piece: rank} of a sentencepiece BPE model, lowest rank merged first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Transducer:
    """Lazily determinised transducer over one vocabulary of {piece: rank}."""

    def __init__(self, ranks: dict[str, float], cells: int = TABLE_CELLS):
        self.ranks, self.cells = ranks, cells
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for piece in ranks:
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][char]
            self.token[node] = piece
        # Pieces below each node, kept where they are few.
        self.below: list[list[str] | None] = [[] for _ in self.children]
        for piece in ranks:
            node = 0
            for char in piece[:-1]:
                node = self.children[node][char]
                self.below[node].append(piece)
        self.below = [b if len(b) <= FEW else None for b in self.below]
        self.known: dict[tuple[int, str], bool] = {}
        self.borders: dict[int, dict[str, list]] = {0: {}, -1: {}}
        self.by_char = np.zeros(0x110000, np.uint16)
        self.by_char[[ord(" "), ord(_SPACE)]] = _RUN
        self.chars: list[str] = [""] * _FIRST
        self.chars[_RUN] = _SPACE
        self.width = 128
        self.reset()

    def reset(self) -> None:
        self.rows = max(64, self.cells // self.width)
        self.next = np.zeros(self.rows * self.width, np.int32)  # 0: not compiled yet
        self.emit = np.zeros(self.rows * self.width, np.int8)
        self.states: list[tuple] = [(), (), ((0, None, 0),)]
        self.index = {self.states[_START]: _START}
        self.broken = self.state_of(self.read(self.states[_START], _SPACE)[0])
        self.prepare(_DEAD, _DEAD)
        self.prepare(_START, 0)
        self.prepare(self.broken, 0)

    def prepare(self, state: int, otherwise: int) -> None:
        """Transitions that do not depend on the state; ``otherwise`` for all others."""
        at = state * self.width
        self.next[at:at + self.width] = otherwise
        self.next[at + _BREAK], self.emit[at + _BREAK] = self.broken, 1
        for size in range(1, 5):
            self.next[at + _UNKNOWN + size], self.emit[at + _UNKNOWN + size] = _START, size

    def merges(self, chars: str) -> Iterator[tuple[float, list[str]]]:
        """(rank of the next merge, parts before it), step by step; infinite at the end."""
        parts = list(chars)
        while True:
            rank, k = min(((self.ranks.get(a + b, np.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))),
                          default=(np.inf, 0))
            yield rank, parts
            if rank == np.inf:
                return
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def merged(self, chars: str) -> list[str]:
        *_, (_, parts) = self.merges(chars)
        return parts

    def border(self, piece: str, side: int) -> list[tuple[float, str]]:
        """The outermost part on one side and the rank of the next inner merge, while a piece is built."""
        held = self.borders[side].get(piece)
        if held is None:
            held = self.borders[side][piece] = [(rank, parts[side]) for rank, parts in self.merges(piece)]
        return held

    def stays_apart(self, left: str | None, right: str) -> bool:
        """Whether two pieces, built side by side in rank order (leftmost first), never merge."""
        if left is None:
            return True
        a, b = self.border(left, -1), self.border(right, 0)
        i = j = 0
        while True:
            (inner, end), (later, begin) = a[i], b[j]
            over = self.ranks.get(end + begin, np.inf)
            if inner <= over and inner <= later:
                if inner == np.inf:
                    return end == left and begin == right
                i += 1
            elif over <= later:
                return False
            else:
                j += 1

    def matters(self, node: int, last: str) -> bool:
        """Whether the token before a growing piece can still forbid one of the pieces it may become."""
        below = self.below[node]
        if below is None:
            return True
        known = self.known.get((node, last))
        if known is None:
            known = self.known[node, last] = not all(self.stays_apart(last, piece) for piece in below)
        return known

    def read(self, live: tuple, char: str) -> tuple[tuple, int]:
        """Next state tuple and the change of the token count."""
        grown, token, count = [], None, 0
        for node, last, before in live:
            if char == _SPACE and last is not None and last[-1] != _SPACE:
                last = None  # nothing merges over this place
            child = self.children[node].get(char)
            if child is None:
                continue
            piece = self.token[child]
            if piece is not None and token is None and self.stays_apart(last, piece):
                token, count = piece, before + 1
            if self.children[child]:
                grown.append((child, last if last is not None and self.matters(child, last) else None, before))
        return (*((node, last, before - count) for node, last, before in grown), (0, token, 0)), count

    def state_of(self, live: tuple) -> int:
        state = self.index.get(live)
        if state is None:
            state = len(self.states)
            if state >= self.rows:
                raise _Full
            self.index[live] = state
            self.states.append(live)
            if hasattr(self, "broken"):
                self.prepare(state, 0)
        return state

    def compile(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            if not self.next[cell]:
                live, change = self.read(self.states[cell // self.width], self.chars[cell % self.width])
                self.next[cell], self.emit[cell] = self.state_of(live), change

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Input symbols of code points; new characters get new symbols."""
        found = self.by_char[points]
        if (found == 0).any():
            for point in np.unique(points[found == 0]).tolist():
                char = chr(point)
                if char in self.ranks:
                    self.by_char[point] = len(self.chars)
                    self.chars.append(char)
                else:
                    self.by_char[point] = _UNKNOWN + len(char.encode())
            if len(self.chars) > self.width:
                while len(self.chars) > self.width:
                    self.width *= 2
                del self.broken
                self.reset()
            found = self.by_char[points]
        return found

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = state * self.width + symbol
        new = self.next[cell]
        if len(new) and not new.min():
            self.compile(cell[new == 0])
            new = self.next[cell]
        return new, self.emit[cell]

    def counts(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Change of the token count at each symbol; the first symbol is a break."""
        n = len(symbols)
        lanes = -(-n // chunk)
        grid = np.full(lanes * chunk, _BREAK, np.int64)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
        out = np.zeros((chunk, lanes), np.int8)
        state = np.full(lanes, _DEAD, np.int64)
        head = np.zeros(lanes, np.int64)
        # The constant part of each chunk's state map.
        for t in range(chunk):
            state, out[t] = self.step(state.astype(np.int64), grid[t])
            head += state == _DEAD
        leave = state.astype(np.int64)
        # Scan: a chunk without a break passes its entry state on through its symbols.
        for lane in np.flatnonzero(head == chunk).tolist():
            at = leave[lane - 1:lane]
            for t in range(chunk):
                at, out[t, lane:lane + 1] = self.step(at.astype(np.int64), grid[t, lane:lane + 1])
            leave[lane] = at[0]
        # Heads, run from the composed entry states.
        open_ = np.flatnonzero((head > 0) & (head < chunk))
        state = leave[open_ - 1]
        t = 0
        while len(open_):
            state, out[t, open_] = self.step(state.astype(np.int64), grid[t, open_])
            t += 1
            more = head[open_] > t
            open_, state = open_[more], state[more]
        return out.T.reshape(-1)[:n]

    def plain_counts(self, text: str) -> int:
        """The same count by merging, for texts that do not fit the table."""
        total, at, marked = 0, 0, (_SPACE + text.replace(" ", _SPACE)) if text else ""
        for k in range(1, len(marked) + 1):
            if k == len(marked) or (marked[k] == _SPACE and marked[k - 1] != _SPACE):
                total += sum(1 if p in self.ranks else len(p.encode()) for p in self.merged(marked[at:k]))
                at = k
        return total

    def token_counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text of one batch."""
        text = buf.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(len(off) - 1, np.int64)
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
        at = total[off]
        try:
            symbols = self.classes(points).astype(np.int64)
            space = symbols == _RUN
            opens = np.zeros(len(points), dtype=bool)
            opens[at[:-1][np.diff(at) > 0]] = True
            # The first space behind another character is a break; a text opens with one of its own.
            symbols[1:][space[1:] & ~space[:-1] & ~opens[1:]] = _BREAK
            symbols = np.insert(symbols, np.flatnonzero(opens), _BREAK)
            shift = np.zeros(len(points) + 1, np.int64)
            np.cumsum(opens, out=shift[1:])
            total = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(self.counts(symbols), out=total[1:])
            return np.diff(total[at + shift[at]])
        except _Full:
            del self.broken
            self.reset()
            return np.array([self.plain_counts(text[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())], np.int64)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    The counts are those of the model's own library without begin, end or other
    added tokens.  Null and empty texts have none; strings that look like special
    tokens are plain text; repeated rows and null ids are rows of their own; other
    columns are not looked at.  Nothing is shuffled.  The vocabulary (its size is
    that of the model, not of the data) is broadcast.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": read_vocabulary(model_path)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        machine = held.setdefault("machine", None) or Transducer(held["ranks"])
        held["machine"] = machine  # what one task compiles, the next task of this worker uses
        for batch in batches:
            buf, off = W.string_parts(batch.column(1))
            parts = [machine.token_counts(*piece[2:]) for piece in W.pieces(buf, off, 1 << 20)]
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
