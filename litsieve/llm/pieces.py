"""Pre-token boundaries as array operations, and cached piece encoding.

Rows whose bytes are ASCII or letters of U+00C0..U+00FF are split by byte classes;
any other row goes through the tokenizer's own library, so the results are the
library's in every case. Rows are judged one by one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable

import numpy as np
import regex

from .vec import LOWER, groups, ranges

SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER
#: Bytes that the class table doesn't describe: separators 1C-1F, and lead bytes but C3.
ODD = np.zeros(256, bool)
ODD[0x1C:0x20] = ODD[0xC0:] = True
ODD[0xC3] = False


def odd_rows(buf: np.ndarray, off: np.ndarray, special: bytes = b"") -> np.ndarray:
    """Rows that need the library: other characters, or (possibly) a special string."""
    odd = ODD[buf]
    if len(buf) > 1:
        lead = buf[:-1] == 0xC3
        odd[1:] |= lead & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        odd[1:] |= (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & ~lead
        if special:
            odd[1:] |= (buf[:-1] == special[0]) & (buf[1:] == special[1])
    return np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)


def _contractions(buf: np.ndarray, off: np.ndarray, start: np.ndarray) -> None:
    """An apostrophe that starts a piece takes s, t, d, m, re, ve or ll with it."""
    n = len(buf)
    at = np.flatnonzero((buf == 39) & start)
    if not len(at):
        return
    end = off[np.searchsorted(off, at, "right")]
    one, two = buf[np.minimum(at + 1, n - 1)], buf[np.minimum(at + 2, n - 1)]
    short = (at + 1 < end) & np.isin(one, np.frombuffer(b"stdm", np.uint8))
    long = (at + 2 < end) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
    start[at[short] + 1] = False
    start[at[long] + 1] = start[at[long] + 2] = False
    for after, limit in ((at[short] + 2, end[short]), (at[long] + 3, end[long])):
        start[after[after < limit]] = True


def byte_pieces(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces of the byte-level pattern; the pieces tile each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = CLASS[buf]
    start = np.ones(n, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    # the last of some white space is apart, and if it's a space, goes with what follows
    after = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~edge[1:n]) + 1
    start[after - 1] = True
    start[after] = buf[after - 1] != 32
    start[edge[:n]] = True
    _contractions(buf, off, start)
    return np.flatnonzero(start)


def word_pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of the pieces of the word pattern."""
    n = len(buf)
    low = LOWER[buf]
    if not n:
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
    low[upper] += 0x20
    cls = CLASS[low]
    start = np.ones(n, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= cls == DIGIT
    start[off[off < n]] = True
    _contractions(low, off, start)
    at = np.flatnonzero(start)
    to = np.append(at[1:], n)
    keep = cls[at] != SPACE
    return low, at[keep], to[keep]


class PieceIds:
    """Ids of pieces, each encoded once while the bounded cache holds it."""

    def __init__(self, encode: Callable[[bytes], list[int]], limit: int = 150_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known: dict[bytes, bytes] = {}

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, group = groups(buf, starts, ends)
        if len(self.known) > self.limit:
            self.known.clear()
        known, found = self.known, []
        raw = buf.tobytes()
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = raw[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = array("I", self.encode(piece)).tobytes()
                if b - a <= self.longest:  # so that the cache is bounded in bytes
                    known[piece] = ids
            found.append(ids)
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(counts) - counts
        lengths = counts[group]
        return flat[ranges(begin[group], lengths)], lengths


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def spelt_out(raw: bytes, letters: dict[int, str]) -> str:
    """A piece in the letters of byte-level vocabularies; printable ASCII is itself but for
    the space."""
    text = raw.decode("latin-1")
    return text.replace(" ", letters[32]) if text.isascii() and text.isprintable() else text.translate(letters)


def scan(pattern: regex.Pattern, raw: bytes) -> list[int]:
    """Byte offsets at which the pattern's pieces start, found by the pattern itself."""
    out, at = [], 0
    for piece in pattern.findall(raw.decode("utf-8", "replace")):
        out.append(at)
        at += len(piece.encode())
    return out
