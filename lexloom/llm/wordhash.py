"""Words of UTF-8 bytes and their 64-bit hashes, for whole arrays at once."""

from __future__ import annotations

import numpy as np

_POSITIONS = 1 << 12
# Random odd multipliers, one for each place in a word.
_FACTORS = np.random.default_rng(20240501).integers(0, 1 << 63, _POSITIONS, np.uint64) * 2 + 1

LETTERS = np.zeros(256, bool)  # ASCII letters and digits, and all bytes of other characters
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, prefixes: range = range(0)) -> tuple[np.ndarray, np.ndarray, list]:
    """Start and end of each run of letters and digits in ``data`` (bytes as uint8), and hashes.

    A-Z count as a-z. Equal words have equal hashes wherever they stand. The first array of
    hashes is of whole words; for each of ``prefixes`` an array follows with the hashes of the
    words' first so many bytes (zero where the word is not longer than that).
    """
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTERS[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, [np.empty(0, np.uint64)] * (1 + len(prefixes))
    lengths = ends - starts
    # The bytes of all words side by side, each with its place in its word.
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    letters = LOWER[data[np.repeat(starts, lengths) + place]].astype(np.uint64) + np.uint64(1)
    rounds = (place // _POSITIONS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    weighed = letters * (_FACTORS[place % _POSITIONS] + rounds)
    hashes = [mix(np.add.reduceat(weighed, offsets) + lengths.astype(np.uint64))]
    if len(prefixes):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighed, dtype=np.uint64)))
        for n in prefixes:
            ends_at = offsets + np.minimum(n, lengths)
            part = mix(sums[ends_at] - sums[offsets] + np.uint64(n << 32))
            hashes.append(np.where(lengths > n, part, np.uint64(0)))
    return starts, ends, hashes
