"""Vectorised polynomial hashes over bytes, modulo two primes.

Modulo a power of two, different strings of equal hash are easy to write down whatever the base is. Modulo a prime that takes
knowing the base, and two primes below 2**31 together leave about 62 bits to chance; their products stay within 64 bits.
"""

from __future__ import annotations

import numpy as np

PRIMES = (np.uint64(2_147_483_647), np.uint64(2_147_483_629))
_BASES = (1_213_906_577, 1_763_042_303)
_SYMBOLS = tuple(np.random.RandomState(20240229 + k).randint(1, int(p), 256).astype(np.uint64) for k, p in enumerate(PRIMES))
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_QUICK = np.random.RandomState(20240229).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Powers are kept for the next call up to so many.
KEPT = 1 << 23
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(n: int, base: int, modulus: int = 0) -> np.ndarray:
    """base**0 .. base**(n-1), modulo ``modulus`` (below 2**32), or 2**64 without one."""
    have = _powers.get((int(base), int(modulus)), np.ones(1, np.uint64))
    if len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        while len(have) < size:
            step = np.uint64(pow(int(base), len(have), int(modulus) or 1 << 64))
            more = have * step
            have = np.concatenate([have, more % np.uint64(modulus) if modulus else more])
        if size <= KEPT:
            _powers[int(base), int(modulus)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomials, a row for each prime: entry i covers the first i bytes. Below 2**33 bytes no sum overflows."""
    out = np.zeros((2, len(data) + 1), np.uint64)
    for row, p, base, symbols in zip(out, PRIMES, _BASES, _SYMBOLS, strict=True):
        np.cumsum(symbols[data] * powers(len(data), base, p) % p, out=row[1:])
    return out


def _back(n: int, k: int) -> np.ndarray:
    return powers(n, pow(_BASES[k], -1, int(PRIMES[k])), PRIMES[k])


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes start..end, whatever stands before them."""
    n = sums.shape[1]
    a, b = ((s[end] - s[start]) % p * _back(n, k)[start] % p for k, (s, p) in enumerate(zip(sums, PRIMES, strict=True)))
    return mix((a << np.uint64(32) | b) + (end - start).astype(np.uint64) * _STEP)


def quick_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums modulo 2**64, at a third of the cost: for keys whose collisions cost time, not results."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_QUICK[data] * powers(len(data), _STEP), out=out[1:])
    return out


def quick_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), _BACK)[start] + (end - start).astype(np.uint64) * _STEP)


def quick_windows(sums: np.ndarray, length: int) -> np.ndarray:
    n = len(sums) - length
    return mix((sums[length:] - sums[:n]) * powers(n, _BACK)) if n > 0 else np.zeros(0, np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
