"""Sets of hashed word shingles, by whole arrays.

A word's hash comes from prefix sums of a polynomial over its bytes, a shingle's from its words' hashes; both are
64 bits. Sets are compared by these hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

from evidloom.llm.common import SEPARATORS

CHUNK = 1 << 20
_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BYTES = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, np.uint64)
_IS_SEPARATOR = np.isin(np.arange(256), list(SEPARATORS.encode()))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _U(pow(int(_BASE), -1, 1 << 64)))):
            factors = np.full(n, b)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash; words stand between separator bytes.

    The text is read in pieces of one size; a word that a piece's end cuts goes on with what it summed to, so a word
    of any length takes no more room.
    """
    starts, hashes = [], []
    cut = None  # begin, sum and length of a word whose end isn't read yet
    power, inverse = _power(min(len(data), CHUNK) + 1)
    for lo in range(0, len(data), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - lo), lo)
        blank = np.concatenate([[True], _IS_SEPARATOR[b], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * power[: len(b)], out=sums[1:])
        value, length, begin = (sums[end] - sums[begin]) * inverse[begin], (end - begin).astype(np.uint64), begin + lo
        if cut:
            at, so_far, n = cut
            if len(begin) and begin[0] == lo:
                value[0] = (so_far + int(value[0]) * pow(int(_BASE), n, 1 << 64)) % (1 << 64)
                length[0] += _U(n)
                begin[0] = at
            else:
                value, length, begin = np.append(_U(so_far), value), np.append(_U(n), length), np.append(at, begin)
            cut = None
        if len(end) and end[-1] == len(b) and lo + len(b) < len(data):
            cut = int(begin[-1]), int(value[-1]), int(length[-1])
            value, length, begin = value[:-1], length[:-1], begin[:-1]
        starts.append(begin)
        hashes.append(mixed(value + length))
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles in order; a text of fewer words has its whole sequence as one, without words none."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    starts, words = word_hashes(b"\n".join(texts).lower())
    bound = np.append(0, np.searchsorted(starts, ends))
    windows = max(0, len(words) - size + 1)
    s = np.zeros(windows, np.uint64)
    for i in range(size):
        s = s * _STEP + words[i : i + windows]
    s = mixed(s + _U(size))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            h = _U(0)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _STEP + w
                out.append(mixed(np.array([h]) + _U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(found: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; none for the empty set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
