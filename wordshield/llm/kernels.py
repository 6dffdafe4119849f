"""Numpy kernels that tasks apply to Arrow batches of texts: word bounds, hashes of byte ranges, chunks bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20_011))
#: A random 64-bit value for each byte, and the odd base of the range hashes with its inverse modulo 2**64.
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PRIME = np.uint64(2**31 - 1)
_PRIME_CODES = _rng.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_PRIME_BASE = 1_220_703_125
_prime_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def _folded(x: np.ndarray) -> np.ndarray:
    """x or less, equal modulo the prime: its upper bits added to its lower 31."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _prime_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_prime_powers[0]) < n:
        for k, base in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME)))):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate((p, p * np.uint64(pow(base, len(p), int(_PRIME))) % _PRIME))
            _prime_powers[k] = p
    return _prime_powers[0], _prime_powers[1]


class RangeHash:
    """64-bit hashes of any byte ranges of one buffer, from prefix sums; equal contents hash alike at any place.

    Two polynomials of the bytes' codes are mixed. One is modulo 2**64, where some texts collide by construction, whatever the
    base (such as the Thue-Morse word of 1,024 letters and its complement); the other is modulo a prime, where they don't.
    """

    def __init__(self, buf: np.ndarray):
        up, self.down = _power(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_CODES[buf] * up[: len(buf)], out=self.sums[1:])
        up, self.prime_down = _prime_power(len(buf) + 1)
        self.prime_sums = np.zeros(len(buf) + 1, np.uint64)  # of terms under 2**32, so they can't overflow
        np.cumsum(_folded(_PRIME_CODES[buf] * up[: len(buf)]), out=self.prime_sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        second = (self.prime_sums[end] - self.prime_sums[start]) % _PRIME * self.prime_down[start] % _PRIME
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ second * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space of a buffer that ends in white space."""
    gap = SPACES[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def chunks(texts: list[bytes], most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to `most` bytes together, so that a kernel's arrays stay in the CPU's cache; a longer text is a range of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def sliced(batches: Iterator, rows: int = 512) -> Iterator:
    """The record batches in pieces of a few hundred rows, so that Python copies of their texts stay small."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a blank after each text, and each text's start in it (and the end of all)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), starts
