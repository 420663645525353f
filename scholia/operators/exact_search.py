"""Exact search among vectors: products of matrices leave few pairs, whose scores are then summed in order.

A task holds a block of queries as matrices, and multiplies its own vectors with them, some at a time. A pair goes where
the product, with all that rounding may add to it, shows that k others are better; what is left is scored as a loop over
the dimensions would. Lists that are null, hold nulls or have another length than the query's have a null score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Vectors multiplied at a time; how much two scores may differ that are rounded to equal ones; what stands for scores
#: that aren't numbers, in their order.
CHUNK, CLOSE = 512, 1.1e-6
NAN_FIRST, INFINITE, NAN_LAST, NULL = np.inf, np.finfo(float).max, -np.finfo(float).max, -np.inf
#: The length of lists without a score.
NONE = -1


def matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of a column's lists and a matrix of them; NONE for null lists and such with nulls."""
    lengths = pc.fill_null(pc.list_value_length(column), NONE).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    sizes = np.maximum(lengths, 0)
    starts = np.cumsum(sizes) - sizes
    if values.null_count:
        lengths[np.repeat(np.arange(len(lengths)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]] = NONE
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for n in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == n)
        out[n] = own, flat[starts[own, None] + np.arange(max(n, 0))]
    return out


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Of rows of two matrices, summed from the first dimension to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        x = a[:, d] * b[:, d] if metric == "inner" else (a[:, d] - b[:, d]) ** 2
        out += x
    return out if metric == "inner" else np.sqrt(out)


def goodness(found: np.ndarray, metric: str) -> np.ndarray:
    """Scores as numbers that are larger for what comes first."""
    good = found.copy() if metric == "inner" else -found
    good = np.clip(good, -INFINITE / 2, INFINITE)
    good[np.isnan(found)] = NAN_FIRST if metric == "inner" else NAN_LAST
    return good


def first_keys(keys: np.ndarray, k: int) -> np.ndarray:
    """The smallest keys, enough for k of them to differ from any one key."""
    names, n = np.unique(keys, return_counts=True)
    return np.repeat(names[: k + 1], np.minimum(n[: k + 1], k))


class Best:
    """The pairs of queries and keys that may be among the k first of a query."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, NULL)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.kept = 0, 0

    def add(self, query: np.ndarray, key: np.ndarray, good: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, key, good, score))
        self.size += len(query)
        if self.size > 2 * self.kept + (1 << 15):
            self.pruned()

    def pruned(self) -> tuple[np.ndarray, ...]:
        """What is left: all that are CLOSE to the kth of their query or better, of equal scores the k smallest keys."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        query, key, good, score = (np.concatenate(x) for x in zip(*self.held))
        places = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((places, -good, query))
        query, key, good, score = query[order], key[order], good[order], score[order]
        at = np.arange(len(query))
        new = np.r_[True, query[1:] != query[:-1]]
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        kth = rank == self.k - 1
        self.least[query[kth]] = good[kth]
        same = np.r_[True, (query[1:] != query[:-1]) | (good[1:] != good[:-1])]
        left = (good >= self.least[query] - CLOSE) & (at - np.maximum.accumulate(np.where(same, at, 0)) < self.k)
        self.held = [(query[left], key[left], good[left], score[left])]
        self.size = self.kept = int(left.sum())
        return self.held[0]


class Block:
    """Queries of one block: their keys and lists."""

    def __init__(self, keys: np.ndarray, column: pa.ListArray, k: int, metric: str):
        self.keys, self.own, self.k, self.metric = keys, matrices(column), k, metric

    def bounds(self, near: np.ndarray, q: np.ndarray, v: np.ndarray, keys: np.ndarray, own: np.ndarray, best: Best) -> np.ndarray:
        """How large a product (l2: twice it less the vector's square) has to be, by query."""
        eps = 8 * (q.shape[1] + 4) * np.finfo(float).eps
        squares = (q * q).sum(1)
        most = (v * v).sum(1).max(initial=0.0)
        slack = eps * np.sqrt(squares * most) if self.metric == "inner" else eps * (squares + most)
        least = best.least[own]
        if self.metric == "inner":
            bound = least - CLOSE - slack
        else:
            bound = squares - (CLOSE - least) ** 2 * (1 + 1e-12) - slack
        open_ = np.flatnonzero(least == NULL)
        if len(open_) and len(v) > self.k:  # the first vectors bound themselves
            first = np.where(self.keys[own][open_, None] == keys[None, :], -np.inf, near[open_])
            kth = np.partition(first, len(v) - self.k, axis=1)[:, len(v) - self.k]
            # Twice the slack: of the kth and of what it is held against. Distances below CLOSE differ in their squares by less than its square.
            close = CLOSE if self.metric == "inner" else CLOSE**2 + 2 * CLOSE * np.sqrt(np.maximum(squares[open_] - kth + slack[open_], 0))
            bound[open_] = kth - close - 2 * slack[open_]
        bound[~np.isfinite(squares)] = -np.inf
        return bound

    def meet(self, keys: np.ndarray, v: np.ndarray, best: Best) -> None:
        """Vectors of one length meet the queries of this length."""
        own, q = self.own[v.shape[1]]
        for at in range(0, len(v), CHUNK):
            some, k = v[at : at + CHUNK], keys[at : at + CHUNK]
            plain = np.isfinite((some * some).sum(1))
            used = np.where(plain[:, None], some, 0.0)
            with np.errstate(all="ignore"):
                near = q @ used.T
                if self.metric == "l2":
                    near *= 2
                    near -= (used * used).sum(1)
                near[:, ~plain] = -np.inf
                hit = ~(near < self.bounds(near, q, used, k, own, best)[:, None])
                hit[:, ~plain] = True
                i, j = np.nonzero(hit)
                other = self.keys[own[i]] != k[j]
                i, j = i[other], j[other]
                found = scores(some[j], q[i], self.metric)
            best.add(own[i], k[j], goodness(found, self.metric), found)

    def search(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Query keys, keys and scores of all that may be among the k first, of batches of keys and lists."""
        best, smallest = Best(len(self.keys), self.k), {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (rows, v) in matrices(batch.column(1)).items():
                smallest[n] = first_keys(np.concatenate([smallest[n], keys[rows]]) if n in smallest else keys[rows], self.k)
                if n != NONE and n in self.own:
                    self.meet(keys[rows], v, best)
        best.pruned()
        for n, (own, _) in self.own.items():  # null scores come last, by key
            few = own[best.least[own] == NULL]
            others = [x for m, x in smallest.items() if m != n or n == NONE]
            if len(few) and others:
                for i in few.tolist():
                    key = np.concatenate(others)
                    key = np.sort(key[key != self.keys[i]])[: self.k]
                    best.add(np.full(len(key), i), key, np.full(len(key), NULL), np.zeros(len(key)))
        query, key, good, score = best.pruned()
        for at in range(0, len(query), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield self.keys[query[s]], key[s], pa.array(score[s], pa.float64(), mask=good[s] == NULL, from_pandas=False)
