"""Deep-shallow ordering of suffixes: multikey quicksort by 8-byte characters to a shallow depth, then blind tries.

Everything works on whole arrays. A suffix is a position in one byte buffer, compared on its first ``length`` bytes.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def padded(data: bytes, length: int) -> np.ndarray:
    """The bytes as an array with room behind, so that every suffix has ``length`` bytes and a word more."""
    out = np.zeros(len(data) + length + 2 * WORD, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


class Suffixes:
    def __init__(self, buf: np.ndarray, length: int):
        self.buf, self.length = buf, length
        self.words = np.ndarray((len(buf) - WORD + 1,), ">u8", buf, strides=(1,))

    def word(self, pos: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of each suffix as one number; bytes from ``length`` on read as zero."""
        x = self.words[pos + WORD * k].astype(np.uint64)
        over = WORD * (k + 1) - self.length
        return x & np.uint64((0xFFFFFFFFFFFFFFFF << (8 * over)) & 0xFFFFFFFFFFFFFFFF) if over > 0 else x

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Length of the common prefix of each pair, known to reach ``depth`` (a multiple of 8)."""
        out = np.full(len(a), self.length, np.int64)
        steps = np.array([1 << (8 * i) for i in range(1, WORD)], np.uint64)
        for k in reversed(range(depth // WORD, -(-self.length // WORD))):
            x = self.word(a, k) ^ self.word(b, k)
            at = np.flatnonzero(x)
            out[at] = WORD * k + WORD - 1 - np.searchsorted(steps, x[at], side="right")
        return out


def _groups(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots in groups of two or more, and the group number of each such slot."""
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(head)))
    many = size > 1
    if not many.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = np.repeat(np.arange(many.sum()), size[many])
    first = np.cumsum(size[many]) - size[many]
    return np.repeat(start[many] - first, size[many]) + np.arange(len(number)), number


def deep_shallow_order(buf: np.ndarray, pos: np.ndarray, length: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and, for each place in that order, whether it differs from the one before.

    ``shallow`` bytes (a multiple of 8) are ordered as multikey quicksort does, one character at a time and each group
    of equal characters going on to the next; a character has 8 bytes, and numpy's sort of numbers partitions it. Groups that still agree are ordered by a blind
    trie, built level by level for all groups at once: a node keeps only the depth at which its members
    first part, found against one member, and the byte there; skipped bytes are never looked at again.
    """
    n = len(pos)
    if not n:
        return np.empty(0, np.int64), np.empty(0, bool)
    s = Suffixes(buf, length)
    key = s.word(pos, 0)
    order = np.argsort(key)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    for k in range(1, shallow // WORD):
        slots, number = _groups(head)
        if not len(slots):
            return order, head
        key = s.word(pos[order[slots]], k)
        by = np.lexsort((key, number))
        order[slots], key = order[slots][by], key[by]
        head[slots[1:]] |= (key[1:] != key[:-1]) & (number[1:] == number[:-1])
    slots, number = _groups(head)
    while len(slots):
        item = pos[order[slots]]
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        lcp = s.common(item, item[first][number], shallow)
        depth = np.minimum.reduceat(lcp, first)[number]
        part = depth < length
        if not part.any():
            break
        slots, number, item, depth = slots[part], number[part], item[part], depth[part]
        byte = buf[item + depth]
        by = np.lexsort((byte, number))
        order[slots], byte = order[slots][by], byte[by]
        same = number[1:] == number[:-1]
        split = np.append(False, (byte[1:] != byte[:-1]) & same)
        head[slots] |= split
        fresh = np.cumsum(np.append(True, ~same) | split) - 1
        size = np.bincount(fresh)
        keep = size[fresh] > 1
        slots = slots[keep]
        number = np.unique(fresh[keep], return_inverse=True)[1]
    return order, head
