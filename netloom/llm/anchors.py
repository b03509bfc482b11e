"""Content-chosen anchors for windows of a fixed length.

Every window of ``length`` symbols is assigned to the smallest-hashed gram of
``gram`` symbols inside it (the leftmost of equals). Equal windows choose the same
gram, so repeated windows always meet under one anchor, while only about one
position in ``(length - gram) / 2`` is an anchor. The windows of one anchor start at
consecutive positions; the text they cover together is its segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd base and its inverse modulo 2**64, of the rolling hash.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
#: A random value for each byte, so that the rolling hash starts from full words.
BYTE_VALUES = np.random.default_rng(2024).integers(0, 1 << 63, 256, dtype=np.uint64)
#: An Arrow block of text has less than 2**31 bytes.
_POSITION_BITS = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown when a longer block comes."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up, self.down


class Rolling:
    """Hashes of any stretches of one sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:], dtype=np.uint64)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


@dataclass
class Anchors:
    """One entry per anchor: its gram's hash, its document in the block, and the first
    and last window start (positions in the block)."""

    gram: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span, out = 1, x
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_anchors(rolling: Rolling, offsets: np.ndarray, length: int, gram: int) -> Anchors:
    """Anchors of the windows that lie inside one document each; ``offsets`` are the
    documents' bounds in the sequence."""
    total = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if total < length:
        return Anchors(np.zeros(0, np.uint64), none, none, none, none)
    grams = rolling.every(gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(ranked, length - gram + 1) & low).astype(np.int64)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(chosen)]
    starts = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[1:][owner])
    if not len(starts):
        return Anchors(np.zeros(0, np.uint64), none, none, none, none)
    place = chosen[starts]
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.concatenate([begin[1:], [len(place)]]) - 1
    at = place[begin]
    return Anchors(grams[at], owner[starts[begin]], at, starts[begin], starts[end])


def segment_hashes(rolling: Rolling, anchors: Anchors, length: int) -> np.ndarray:
    """Identity of an anchor's segment: its symbols and where the gram lies in it."""
    h = rolling(anchors.first, anchors.last + length)
    where = (anchors.at - anchors.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h ^ where ^ ((anchors.last - anchors.first).astype(np.uint64) << np.uint64(40)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than ASCII white space, and the
    documents' bounds counted in words."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # documents touch in the block
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]) | inside & edge[:-1]) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([space[1:], [True]]) | inside & edge[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)
