"""Code points of whole text batches: folded letters, scripts and letter words, in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np

from tallyframe.llm.words import Local

#: First and last code point of the script ranges (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)], "thai": [(0xE00, 0xE7F)], "lao": [(0xE80, 0xEFF)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)], "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
SCRIPT_NAMES = ["none", "other", *SCRIPTS]


_TABLES = Local()


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(script, lower case, folded letter) per code point.

    Script 0 is no letter, marks count as letters.  Folded letters drop accents and
    case: 1..26 for a..z, 27 for letters without a Latin base, 0 for the rest.
    """
    if "all" not in _TABLES:
        _TABLES["all"] = _letter_tables()
    return _TABLES["all"]


def use_tables(tables: tuple[np.ndarray, ...]) -> None:
    """Take tables that came with a broadcast, so that tasks need not build them."""
    _TABLES["all"] = tables


def _letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x32000):
        char = chr(point)
        if unicodedata.category(char)[0] in "LM":
            script[point] = 1
            small = char.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    for k, ranges in enumerate(SCRIPTS.values(), 2):
        for a, b in ranges:
            part = script[a:b + 1]
            part[part > 0] = k
    folded = np.where(script > 0, 27, 0).astype(np.uint8)
    for point in range(0x2000):
        if script[point]:
            base = unicodedata.normalize("NFKD", chr(point))[0].lower()
            if "a" <= base <= "z":
                folded[point] = ord(base) - 96
    return script, lower, folded


def code_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points) of texts given as bytes."""
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return points, total[off]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of maximal runs of ``inside`` that stay in one text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[off] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)
