"""Hashes of any ranges of some bytes, vectorised; for candidates and groups that something else verifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that tables are made for at once.
LEAST = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MADE: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _powers(size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two hashes: a random number for each byte, powers of an odd base and their inverses, modulo 2**64."""
    if not _MADE or len(_MADE[0][1]) < size:
        size = max(size, LEAST + (LEAST >> 2))
        _MADE.clear()
        for seed, base in ((7, 0x5851F42D4C957F2D), (8, 0x14057B7EF767814F)):
            byte = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)

            def powers(x: int) -> np.ndarray:
                out = np.full(size, x, np.uint64)
                out[0] = 1
                return np.multiply.accumulate(out)

            _MADE.append((byte, powers(base), powers(pow(base, -1, 1 << 64))))
    return _MADE


def forget() -> None:
    """The tables go: each task makes its own, and workers outlive tasks."""
    _MADE.clear()


class Hashed:
    """From prefix sums; equal bytes have equal hashes wherever they are."""

    def __init__(self, data: np.ndarray, lanes: int = 2):
        self.lanes = []
        for byte, power, inverse in _powers(len(data) + 1)[:lanes]:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(byte[data] * power[: len(data)], out=sums[1:])
            self.lanes.append((sums, inverse))

    def ranges(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | np.uint64 = np.uint64(0), lane: int = 0) -> np.ndarray:
        sums, inverse = self.lanes[lane]
        h = ((sums[stop] - sums[start]) * inverse[start]) ^ salt
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h ^ (h >> np.uint64(29))) * _MIX


def segments(text: bytes, size: int, most: int) -> Iterator[bytes]:
    """Words joined by single spaces, in parts of about ``most`` bytes that share ``size - 1`` words: each run of ``size`` words lies in one part."""
    start = 0
    while len(text) - start > most and (stop := text.find(b" ", start + most)) >= 0:
        last = stop  # after the words that begin here, those that their runs still need
        for _ in range(size - 1):
            last = text.find(b" ", last + 1) if last >= 0 else last
        yield text[start : last if last >= 0 else len(text)]
        start = stop + 1
    rest = text[start:]
    if rest.count(b" ") >= size - 1:
        yield rest


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words of texts, joined by single spaces within and by line ends between; which are the last of a text."""
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero((data == 32) | (data == 10))
    closing = np.concatenate((data[gaps] == 10, [True]))
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)])), closing
