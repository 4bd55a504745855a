"""Words of a text and hashes of their sequences, on numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: The largest number of words that a worker remembers hashes of.
MEMO_WORDS = 100_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs outside space and 0x09-0x0D, in UTF-8 (bytes.split() divides at exactly those)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(sign: int, n: int) -> np.ndarray:
    have = _powers[sign]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have)), np.uint64(_BASE if sign == 1 else _INVERSE), np.uint64)
        step[0] = 1
        have = _powers[sign] = np.cumprod(step)
    return have[:n]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of `size` hashes, from prefix sums; empty where there are fewer."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power(1, n), out=total[1:])
    return mix((total[size:] - total[:-size]) * _power(-1, n - size + 1))


def sequence_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence or sorted set of hashes, as two signed longs."""
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
