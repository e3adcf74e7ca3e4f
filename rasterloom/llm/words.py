"""Words of many texts at once: where they are, a 64-bit hash of each, and hashes of runs of words.

Texts are seen as UTF-8. The word classes used here treat every byte beyond ASCII alike, so bytes and code
points give the same words. Hashes are polynomials modulo 2^64 over random byte codes, finished by a mixer;
prefix sums give the hash of any word, and of any run of words, by one subtraction.
"""

from __future__ import annotations

import numpy as np

# fixed values: odd multipliers and mixer constants of the hashes
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD6E8FEB86659FD93
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
SEED = 20240229

SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(MIX_1)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def not_blank() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


class Words:
    """Splits texts by a table of word bytes; made once per task, as it keeps tables of powers."""

    def __init__(self, word_bytes: np.ndarray, lower: bool, seed: int = SEED):
        fold = np.arange(256)
        if lower:
            fold[0x41:0x5B] += 0x20
        codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.is_word, self.codes = word_bytes, codes[fold]
        self._step = [np.ones(1, np.uint64)] * 4

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a step and of its inverse, at least up to ``n``."""
        if len(self._step[2 * which]) <= n:
            step = (BYTE_STEP, WORD_STEP)[which]
            size = max(n, SEGMENT, 2 * len(self._step[2 * which]))
            self._step[2 * which] = powers(step, size)
            self._step[2 * which + 1] = powers(pow(step, -1, 1 << 64), size)
        return self._step[2 * which], self._step[2 * which + 1]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and the number of words before each text (one entry more)."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        word = self.is_word[data]
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every word, a few megabytes of text at a time."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
            high = ends[stop - 1]
            power, inverse = self._powers(0, int(high - low))
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.codes[data[low:high]] * power[: high - low], out=sums[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            at = stop
        return mix(out)

    def runs(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of every ``k`` words in a row, across texts; the caller keeps those inside one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        power, inverse = self._powers(1, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=sums[1:])
        return mix((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1] + np.uint64(k))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Start words of the runs of ``k`` words that stay inside one text."""
    room = np.maximum(np.diff(first) - k + 1, 0)
    total = int(room.sum())
    shift = np.repeat(first[:-1] - np.r_[0, np.cumsum(room)[:-1]], room)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in any run that begins at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + k, -1)
    return np.cumsum(change[:-1]) > 0


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    return np.diff(np.r_[0, np.cumsum(flags)][first])
