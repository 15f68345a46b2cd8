"""A directed graph for nearest-neighbour search: greedy searches propose neighbours, relaxed pruning keeps diverse ones.

Nodes join in rounds that double. Those of a round search the graph so far together, step by step on whole arrays;
each keeps the neighbours that no kept one is clearly nearer to, and offers itself to them in turn.

Distances come from differences, never from products, so near copies far from the origin keep their order also in the
precision that the vectors are stored in; ``scaled`` keeps their squares in range.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, RELAXED, TOGETHER, STARTS = 24, 40, 1.2, 2048, 16
#: Bytes of the table that says which nodes a batch of searches has met.
MET_BYTES = 64 << 20


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors divided by a power of two that brings all components to at most one, which changes no digit, and that power."""
    largest = float(np.abs(vectors).max(initial=0))
    by = 2.0 ** np.ceil(np.log2(largest)) if largest > 0 else 1.0
    return vectors / vectors.dtype.type(by), by


def together(n: int) -> int:
    """How many searches over ``n`` nodes go on at once."""
    return max(16, min(TOGETHER, MET_BYTES // max(n, 1)))


def squares(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``v`` (one list of vectors for each query) to its query."""
    d = v - q[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam_search(vectors: np.ndarray, near: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) that a beam of ``width`` holds for each query at its end, nearest first, and how many nodes each met."""
    nodes_out = np.full((len(queries), width), -1, np.int64)
    met = np.zeros(len(queries), np.int64)
    many = together(len(vectors))
    for lo in range(0, len(queries), many):
        q = queries[lo : lo + many]
        seen = np.zeros((len(q), len(vectors) + 1), bool)
        seen[:, -1] = True  # what -1 points to
        seen[:, starts] = True
        first = squares(np.broadcast_to(vectors[starts], (len(q), *vectors[starts].shape)), q)
        by = np.argsort(first, axis=1)[:, :width]
        nodes = np.full((len(q), width), -1, np.int64)
        dist = np.full((len(q), width), np.inf, vectors.dtype)
        todo = np.full((len(q), width), np.inf, vectors.dtype)  # distances of nodes whose neighbours weren't looked at
        nodes[:, : by.shape[1]] = starts[by]
        dist[:, : by.shape[1]] = todo[:, : by.shape[1]] = np.take_along_axis(first, by, 1)
        while True:
            at = todo.argmin(axis=1)
            rows = np.flatnonzero(np.isfinite(todo[np.arange(len(q)), at]))
            if not len(rows):
                break
            todo[rows, at[rows]] = np.inf
            new = near[nodes[rows, at[rows]]]
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            d = np.full(new.shape, np.inf, vectors.dtype)
            i, j = np.nonzero(fresh)
            apart = vectors[new[i, j]] - q[rows[i]]
            d[i, j] = np.einsum("ij,ij->i", apart, apart)
            all_d = np.concatenate([dist[rows], d], axis=1)
            by = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[rows] = np.take_along_axis(all_d, by, 1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], new], axis=1), by, 1)
            todo[rows] = np.take_along_axis(np.concatenate([todo[rows], d], axis=1), by, 1)
        by = np.argsort(dist, axis=1)
        nodes_out[lo : lo + len(q)] = np.where(np.isfinite(np.take_along_axis(dist, by, 1)), np.take_along_axis(nodes, by, 1), -1)
        met[lo : lo + len(q)] = seen[:, :-1].sum(axis=1)
    return nodes_out, met


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """For each point the nearest candidate again and again, without those that a kept one is nearer to by ``relaxed``.

    Candidates (-1: none) may repeat and may hold the point; at most ``degree`` stay, padded with -1.
    """
    out = np.full((len(points), degree), -1, np.int64)
    for lo in range(0, len(points), 512):
        p, c = points[lo : lo + 512], candidates[lo : lo + 512]
        c = np.sort(np.where(c == p[:, None], -1, c), axis=1)
        alive = c >= 0
        alive[:, 1:] &= c[:, 1:] != c[:, :-1]
        v = vectors[c] - vectors[p][:, None, :]  # the point is the origin
        d = np.einsum("bij,bij->bi", v, v)
        between = d[:, :, None] + d[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for i in range(degree):
            masked = np.where(alive, d, np.inf)
            pick = masked.argmin(axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[lo + rows[ok], i] = c[rows, pick][ok]
            alive &= relaxed * relaxed * between[rows, pick] > d
            alive[rows, pick] = False
    return out


def entry_points(n: int, width: int) -> np.ndarray:
    many = n if n <= width else min(STARTS, n)
    return np.unique(np.linspace(0, n - 1, many).astype(np.int64)) if n else np.empty(0, np.int64)


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> np.ndarray:
    """Neighbours of each node, padded with -1. The order of the nodes should be by chance."""
    n = len(vectors)
    near = np.full((n, degree), -1, np.int64)
    done = min(n, 1)
    while done < n:
        new = np.arange(done, min(n, 2 * done, done + together(n)))
        found, _ = beam_search(vectors[:done], near[:done], vectors[new], entry_points(done, beam), beam)
        # those of a round see each other too: the next few by number, which are there by chance
        peers = new[0] + (new[:, None] - new[0] + np.arange(1, 5)) % len(new)
        near[new] = robust_prune(vectors, new, np.concatenate([found, peers], axis=1), degree, relaxed)
        src, dst = np.repeat(new, degree), near[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        d = squares(vectors[src][:, None, :], vectors[dst])[:, 0]
        by = np.lexsort((d, dst))
        src, dst = src[by], dst[by]
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.empty(0, np.int64)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        close = place < 2 * degree
        offered = np.full((len(first), 2 * degree), -1, np.int64)
        number = np.cumsum(np.isin(np.arange(len(dst)), first)) - 1
        offered[number[close], place[close]] = src[close]
        at = dst[first]
        near[at] = robust_prune(vectors, at, np.concatenate([near[at], offered], axis=1), degree, relaxed)
        done = int(new[-1]) + 1
    return near
