"""Hashes of words with a letter changed, left out or swapped, in time linear in the word.

A word's hash is the sum of its letters, each weighed by a power of a base, modulo a prime. The
hash of the word without letter i is a prefix sum and a shifted rest, that of a word with another
letter at i the whole without that term; so all keys of a word come from one pass over its prefix sums.
Two primes together make a key of 62 bits. Equal keys are candidates: compare the words of a pair.
"""

from __future__ import annotations

import numpy as np

# Two primes below 2^31, so that products fit 64 bits, and a base for each.
PRIMES = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
_powers: list[np.ndarray] = [np.ones(1, np.int64) for _ in PRIMES]


def _power_table(which: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base; grown by doubling and kept by the worker."""
    prime, base = PRIMES[which]
    table = _powers[which]
    while len(table) < n:
        step = int(table[-1]) * base % prime
        table = np.concatenate((table, table * step % prime))
    _powers[which] = table
    return table[:n]


def letters(word: str) -> np.ndarray:
    """Code points, from one upwards."""
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def _combined(make) -> np.ndarray:
    high, low = (make(which, PRIMES[which][0]) for which in range(2))
    return high << 31 | low


def whole_key(codes: np.ndarray) -> np.ndarray:
    """The word's own key (one number)."""
    return _combined(lambda which, prime: np.array(
        [int((codes * _power_table(which, len(codes)) % prime).sum() % prime)], np.int64))


def substitution_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place from 1, key) of the word with each letter in turn left open."""
    def make(which: int, prime: int) -> np.ndarray:
        terms = codes * _power_table(which, len(codes)) % prime
        return (terms.sum() % prime - terms) % prime

    return np.arange(1, len(codes) + 1), _combined(make)


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place from 1, key) of each distinct word left after dropping one letter.

    Letters of a run of equal ones leave the same word, so only the last of each run is dropped.
    """
    places = np.flatnonzero(np.append(codes[1:] != codes[:-1], True)) if len(codes) else np.arange(0)

    def make(which: int, prime: int) -> np.ndarray:
        powers = _power_table(which, len(codes))
        before = np.cumsum(np.append(0, codes * powers % prime)) % prime
        # Letters after the gap stand one place further left.
        after = np.cumsum(np.append(0, codes[:0:-1] * powers[len(codes) - 2::-1] % prime))[::-1] % prime
        return (before[places] + after[places]) % prime

    if len(codes) < 2:
        return places[:0] + 1, places[:0]
    return places + 1, _combined(make)


def swap_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place from 1, key) of each other word made by swapping a letter with the next one."""
    places = np.flatnonzero(codes[1:] != codes[:-1])

    def make(which: int, prime: int) -> np.ndarray:
        powers = _power_table(which, len(codes))
        whole = int((codes * powers % prime).sum() % prime)
        change = (codes[places + 1] - codes[places]) * ((powers[places] - powers[places + 1]) % prime)
        return (whole + change % prime) % prime

    return places + 1, _combined(make)
