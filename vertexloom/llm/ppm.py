"""Prediction by partial matching over bytes: a context trie in flat arrays, escape method D, symbol exclusion.

The coded stream of a document is its lower-cased words joined by one space and one end byte (a line feed, which no
word holds), so code lengths are log10 probabilities of token sequences. Contexts run over the last ``ORDER`` bytes;
before a text stand line feeds. A trie node is a context; its edges are the symbols seen after it. Two modes:
``Trie`` is pretrained and read-only (flat arrays, vectorised), ``Adaptive`` learns while it codes one document.
"""

from __future__ import annotations

import math

import numpy as np

from vertexloom.llm._shared import Lookup

ORDER = 5
END = b"\n"
_TAG = [np.uint64((k + 1) << 56) for k in range(ORDER + 2)]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """One buffer of all coded streams, each after ORDER line feeds; the streams' lengths; the words of each text."""
    words = [t.lower().split() for t in texts]
    streams = [b" ".join(w) + END for w in words]
    pad = END * ORDER
    return np.frombuffer(b"".join([x for s in streams for x in (pad, s)]), np.uint8), np.array([len(s) for s in streams], np.int64), words


def positions(lengths: np.ndarray) -> np.ndarray:
    """Where, in the buffer of ``joined``, coded bytes stand (as opposed to padding)."""
    keep = np.ones(int(lengths.sum()) + ORDER * len(lengths), bool)
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    for k in range(ORDER):
        keep[starts + k] = False
    return np.flatnonzero(keep)


def grams(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position the ORDER bytes before it and its own, the last in the lowest byte."""
    wide = buffer.astype(np.uint64)
    out = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * k)
    return out[at - ORDER]


def tail(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes."""
    return keys & np.uint64((1 << (8 * n)) - 1)


class Trie:
    """Pretrained model. ``counts[k]`` holds (keys, counts) of the contexts of k bytes with their next symbol, k = 0..ORDER.

    Counts must not grow with k for the same suffix, and what is kept at k must be kept at k - 1 (a common count
    threshold does both). For each edge we keep log10 of its count; for each node the denominator when coding starts
    there, and, for an escape from it, the denominator of its suffix once the node's own symbols are excluded.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.edges, self.log_count, self.node_of, self.nodes = [], [], [], []
        self.start, self.escape, self.next_start, self.next_escape, self.direct = [], [], [], [], []
        totals, kinds = [], []
        for k in range(ORDER + 1):
            keys, n = (np.asarray(x) for x in counts[k])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order].astype(np.uint64), n[order].astype(np.float64)
            context, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(owner, n, len(context))
            kind = np.bincount(owner, minlength=len(context)).astype(np.float64)
            self.edges.append(Lookup(keys | _TAG[k]))
            self.nodes.append(Lookup(context | _TAG[k]))
            self.log_count.append(np.log10(n - 0.5))
            self.start.append(np.log10(total))
            self.escape.append(np.log10(kind / 2) - self.start[-1])
            self.direct.append(self.log_count[-1] - self.start[-1][owner])
            totals.append(total)
            kinds.append(kind)
            if k:
                below = self.edges[k - 1].find(tail(keys, k) | _TAG[k - 1])
                under = self.nodes[k - 1].find(tail(context, k - 1) | _TAG[k - 1])
                seen = np.where(below >= 0, counts_below[np.maximum(below, 0)], 0.0)
                left = np.maximum(totals[k - 1][under] - np.bincount(owner, seen, len(context)), 0.0)
                more = np.maximum(kinds[k - 1][under] - np.bincount(owner, (below >= 0).astype(float), len(context)), 0.0)
                self._exits(left, more)
            else:
                self.next_start.append(np.log10(np.maximum(256 - kind, 1)))
                self.next_escape.append(np.zeros(len(context)))
            counts_below = n

    def _exits(self, left: np.ndarray, more: np.ndarray) -> None:
        """``left``: the counts and ``more``: the number of symbols that are not excluded; if none the escape is certain."""
        start = np.log10(np.where(more > 0, left, 1.0))
        self.next_start.append(start)
        self.next_escape.append(np.where(more > 0, np.log10(np.where(more > 0, more, 1.0) / 2) - start, 0.0))

    def code(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each position's byte after its context."""
        keys = keys.astype(np.uint64)
        edge = self.edges[ORDER].find(keys | _TAG[ORDER])
        hit = edge >= 0
        out = np.where(hit, self.direct[ORDER][edge], 0.0) if len(self.direct[ORDER]) else np.zeros(len(keys))
        left = np.flatnonzero(~hit)
        start = escape = np.full(len(left), np.nan)  # of the level at hand, if some symbols are excluded there
        for k in range(ORDER, -1, -1):
            if not len(left):
                return out
            own = keys[left]
            if k < ORDER:
                edge = self.edges[k].find(tail(own, k + 1) | _TAG[k])
                hit = edge >= 0
                if hit.any():
                    log_count, direct = self.log_count[k][edge[hit]], self.direct[k][edge[hit]]
                    out[left[hit]] += np.where(np.isnan(start[hit]), direct, log_count - start[hit])
                left, own, start, escape = left[~hit], own[~hit], start[~hit], escape[~hit]
            node = self.nodes[k].find((tail(own, k + 1) >> np.uint64(8)) | _TAG[k])
            known = node >= 0
            at = np.maximum(node, 0)
            if known.any():
                out[left] += np.where(known, np.where(np.isnan(escape), self.escape[k][at], escape), 0.0)
                start, escape = np.where(known, self.next_start[k][at], np.nan), np.where(known, self.next_escape[k][at], np.nan)
        out[left] -= np.where(np.isnan(start), math.log10(256), start)
        return out

    def arrays(self) -> int:
        return sum(x.nbytes for group in (self.log_count, self.start, self.escape, self.next_start, self.next_escape, self.direct) for x in group) + sum(t.slots.nbytes + t.at.nbytes for t in (*self.edges, *self.nodes))


class Adaptive:
    """Learns as it codes, one document from an empty trie; row by row, for single texts and as the check of ``Trie``."""

    def __init__(self, order: int = ORDER):
        self.order, self.seen = order, {}

    def probability(self, context: bytes, symbol: int) -> float:
        """log10, under method D with exclusion of the symbols of longer contexts."""
        excluded: set[int] = set()
        total = 0.0
        for k in range(min(self.order, len(context)), -1, -1):
            after = self.seen.get(context[len(context) - k :])
            if not after:
                continue
            open_ = {s: n for s, n in after.items() if s not in excluded}
            all_ = sum(open_.values())
            if symbol in open_:
                return total + math.log10((open_[symbol] - 0.5) / all_)
            if open_:
                total += math.log10(len(open_) / 2 / all_)
            excluded |= after.keys()
        return total - math.log10(256 - len(excluded))

    def learn(self, context: bytes, symbol: int, n: int = 1) -> None:
        for k in range(min(self.order, len(context)) + 1):
            after = self.seen.setdefault(context[len(context) - k :], {})
            after[symbol] = after.get(symbol, 0) + n

    def code(self, stream: bytes, learn: bool = True) -> float:
        total, padded = 0.0, END * self.order + stream
        for i in range(self.order, len(padded)):
            context = padded[i - self.order : i]
            total += self.probability(context, padded[i])
            if learn:
                self.learn(context, padded[i])
        return total
