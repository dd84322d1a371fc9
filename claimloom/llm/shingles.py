"""Sets of hashed word shingles and their MinHash signatures, in numpy over whole batches."""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import xxhash

U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20_240_801)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, white space and its kind left out."""
    data = np.frombuffer(text, np.uint8)
    solid = np.flatnonzero(~_WHITE[data])
    if not len(solid):
        return np.zeros(0, U64)
    first = np.ones(len(solid), bool)
    first[1:] = solid[1:] != solid[:-1] + 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(solid)))
    place = np.arange(len(solid)) - np.repeat(starts, lengths)
    power = _powers(1 << int(lengths.max()).bit_length())
    return mix(np.add.reduceat(_BYTE[_LOWER[data[solid]]] * power[place], starts) + lengths.astype(U64))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; all words as one if there are fewer; empty without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, U64(size), U64)
    for k in range(size):
        h = mix(h * _STEP + words[k : len(words) - size + 1 + k])
    return np.unique(h)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


@cache
def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 2**31, (k, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (k, 1), dtype=np.uint32)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The lowest value under each of ``k`` permutations, cut to 16 bits."""
    a, b = _permutations(k)
    x = (shingles >> U64(32)).astype(np.uint32)[None, :]
    low = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 512):
        low = np.minimum(low, (x[:, at : at + 512] * a + b).min(axis=1))
    # the lowest values are all small, so their own bits are mixed before the cut
    return (mix(low.astype(U64)) >> U64(48)).astype("<u2")


def least_matches(k: int, batch: int, similarity: float, miss: float) -> list[tuple[int, int]]:
    """(signature places compared, matches needed to go on) after each batch.

    With an even prior, P(similarity >= s | m of n places match) is the chance that at most m
    of n + 1 trials succeed at rate s.  A pair is dropped once that is below ``miss``.
    """
    out = []
    for n in [*range(batch, k, batch), k]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signatures (rows) pass every batch; later batches look at those left only."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    done = 0
    for n, least in rules:
        if not len(alive):
            break
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        done = n
    return alive


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def collisions(n: int, bits: int = 32) -> int:
    """More pairs of equal hashes than ``n`` different members have, but for a chance far below 1e-20.

    Their number is about Poisson; the bound lies ten deviations, and ten pairs, above its mean.
    """
    mean = n * (n - 1) / 2 / 2**bits
    return 2 + int(mean + 10 * mean**0.5 + (10 if mean > 0.01 else 0))


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of 32-bit hashes may be that similar.

    Members that collide make a set one smaller and the common part one larger; as many are
    allowed for as can collide among the members of both.
    """
    spare = collisions(len(a) + len(b))
    common = overlap(a, b) + spare
    return 100 * common >= percent * (len(a) + len(b) + spare - common)
