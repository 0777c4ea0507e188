"""Array operations on many texts at once, straight on the UTF-8 bytes of an Arrow column.

Words are runs of bytes other than space and TAB to CR; lines are cut at LF. Words, lines and n-grams are known by 64-bit hashes: a polynomial over a
table of random words for the bytes, read off prefix sums, and then mixed. Two different ones are taken for the same with a chance of about 2 ** -64.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
_TABLE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse modulo 2 ** 64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = _ONE
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any byte ranges of data."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def cuts(mark: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs where mark is set, also cut where a text begins."""
    if not len(mark):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    begins = offsets[:-1][offsets[:-1] < len(mark)]
    first[begins] = mark[begins]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    closes = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[closes] = mark[closes]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([np.zeros(1, np.int64 if values.dtype.kind in "bui" else np.float64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sequences(hashes: np.ndarray, bounds: np.ndarray, n: int, shorter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of n neighbours within each text. shorter: a text of 1 to n - 1 gives one run of all it has."""
    counts = np.diff(bounds)
    keep = np.maximum(counts - n + 1, (counts > 0) & shorter)
    out_bounds = np.concatenate([[0], np.cumsum(keep)])
    text = np.repeat(np.arange(len(counts)), keep)
    at = bounds[text] + np.arange(len(text)) - out_bounds[text]
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        place = at + i
        inside = place < bounds[text + 1]
        factor = np.uint64(2 * (0x632BE59BD9B4E019 * (i + 1) % (1 << 62)) + 1)
        out += np.where(inside, hashes[np.minimum(place, max(0, len(hashes) - 1))] * factor, np.uint64(0)) if len(hashes) else np.uint64(0)
    return mix(out), out_bounds


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def salted(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Hashes that also tell the texts apart."""
    return mix(hashes + (texts.astype(np.uint64) + _ONE) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """The words of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = cuts(~SPACE[data], offsets)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.spans = Hashes(LOWER[data] if fold else data)
        self.hashes = self.spans.of(self.starts, self.ends)

    def covered(self, n: int) -> np.ndarray:
        """Which words lie in a run of n words that occurs more than once in its text."""
        runs, bounds = sequences(self.hashes, self.bounds, n)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        again = np.flatnonzero(repeated(salted(runs, text)))
        first = self.bounds[text[again]] + again - bounds[text[again]]
        change = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + n, -1)
        return np.cumsum(change[:-1]) > 0


class Lines:
    """The lines of some texts: LF cuts, and so does a text's end."""

    def __init__(self, words: Words):
        data, offsets = words.data, words.offsets
        breaks = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        self.bounds = np.concatenate([[0], np.cumsum(1 + sums(data == 10, offsets))])
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.words = np.searchsorted(words.starts, self.ends) - np.searchsorted(words.starts, self.starts)
        self.hashes = words.spans.of(self.starts, self.ends)

    def again(self) -> np.ndarray:
        """Which lines hold a word and equal an earlier line of their text."""
        keys = salted(self.hashes, self.text)
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        return same & (self.words > 0)
