"""All pairs of one component on arrays: distances, their counts and shares of shortest paths. Edges have no loops, and all
edges of a pair are one row with their number."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from vertexloom.local.kernels import strong_labels


class Rows:
    """Neighbours of each vertex (numbered from 0 in the order of ids), one row after the other."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, many: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, t = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.argsort(s, kind="stable")
        self.n, self.source, self.to, self.many = len(self.ids), s[order], t[order], many[order]
        self.count = np.bincount(s, minlength=self.n)
        self.first = np.cumsum(self.count) - self.count

    def part(self, k: int, of: int) -> range:
        """The numbers of part ``k`` of the vertices."""
        return range(self.n * k // of, self.n * (k + 1) // of)

    def out(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the vertices in ``front``, and the vertex of each."""
        count = self.count[front]
        skip = np.repeat(self.first[front] - np.cumsum(count) + count, count)
        return skip + np.arange(len(skip)), np.repeat(front, count)


def distances(g: Rows, roots: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each root the vertices that it reaches, itself included, and how far they are."""
    for root in roots:
        dist, front, d = np.full(g.n, -1), np.array([root]), 0
        dist[root] = 0
        while len(front):
            d += 1
            to = g.to[g.out(front)[0]]
            dist[to[dist[to] < 0]] = d
            front = np.flatnonzero(dist == d)
        reached = np.flatnonzero(dist >= 0)
        yield root, reached, dist[reached]


def counts(g: Rows, targets: range) -> np.ndarray:
    """[d - 1, v] is the number of ``targets`` at distance d from v. Targets are bits, 64 of them to a word."""
    from_, first = np.flatnonzero(g.count), g.first[g.count > 0]
    words = int(np.clip((1 << 22) // max(len(g.to), 1), 4, 128))
    out = []
    for low in range(targets.start, targets.stop, 64 * words):
        at = np.arange(low, min(low + 64 * words, targets.stop))
        seen = np.zeros((g.n, words), np.uint64)
        seen[at, (at - low) // 64] = np.uint64(1) << ((at - low) % 64).astype(np.uint64)
        d = 0
        while True:
            new = np.bitwise_or.reduceat(seen[g.to], first, axis=0) & ~seen[from_]
            found = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            if not found.any():
                break
            seen[from_] |= new
            if d == len(out):
                out.append(np.zeros(g.n, np.int64))
            out[d][from_] += found
            d += 1
    return np.array(out, np.int64).reshape(-1, g.n)


def shares(g: Rows, roots: range) -> tuple[np.ndarray, np.ndarray]:
    """Over paths from ``roots`` to all others: shares through each vertex as neither end, and through one edge of each row."""
    through, on = np.zeros(g.n), np.zeros(len(g.to))
    for root in roots:
        far, sigma, front, d, steps = np.full(g.n, -1), np.zeros(g.n), np.array([root]), 0, []
        far[root], sigma[root] = 0, 1.0
        while True:
            rows, s = g.out(front)
            to = g.to[rows]
            new = far[to] < 0
            if not new.any():
                break
            rows, s, to = rows[new], s[new], to[new]
            d += 1
            far[to] = d
            sigma += np.bincount(to, sigma[s] * g.many[rows], g.n)
            steps.append((rows, s, to))
            front = np.flatnonzero(far == d)
        delta = np.zeros(g.n)
        for rows, s, to in reversed(steps):
            c = sigma[s] / sigma[to] * (1 + delta[to])
            on[rows] += c
            delta += np.bincount(s, c * g.many[rows], g.n)
        delta[root] = 0
        through += delta
    return through, on


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the edges but the smallest of its component, and that."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    on = np.flatnonzero(label != np.arange(len(ids)))
    return ids[on], ids[label[on]]


def strong(g: Rows) -> np.ndarray:
    """The least vertex of each vertex's strongly connected component."""
    found = strong_labels(list(zip(g.source.tolist(), g.to.tolist(), strict=True)))
    return np.fromiter((found[v] for v in range(g.n)), np.int64, g.n)


def closure(g: Rows, roots: range, many: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From ``roots`` to what a path of one edge or more leads to, about ``many`` pairs at a time. What strongly connected
    components reach is found in the order that edges between them allow, for blocks of them as bits."""
    label = strong(g)
    parts, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(sizes)[:-1])
    between = np.unique(np.stack([of[g.source], of[g.to]], axis=1)[of[g.source] != of[g.to]], axis=0).reshape(-1, 2)
    n, after = len(parts), [[] for _ in parts]
    left, before = np.bincount(between[:, 0], minlength=n).tolist(), [[] for _ in parts]
    for s, t in between.tolist():
        after[s].append(t)
        before[t].append(s)
    order = [c for c in range(n) if not left[c]]
    for c in order:  # those that lead to none first; it grows
        for s in before[c]:
            left[s] -= 1
            if not left[s]:
                order.append(s)
    mine = np.arange(roots.start, roots.stop)
    own = [(int(c), mine[of[mine] == c]) for c in np.unique(of[mine])] if n < 64 else None
    if own is None:
        by = np.argsort(of[mine], kind="stable")
        own = [(int(of[x[0]]), x) for x in np.split(mine[by], np.flatnonzero(np.diff(of[mine[by]])) + 1) if len(x)]
    words = int(np.clip((1 << 23) // max(n, 1), 1, 128))
    for low in range(0, n, 64 * words):
        block = np.arange(low, min(low + 64 * words, n))
        seen = np.zeros((n, words), np.uint64)
        seen[block, (block - low) // 64] = np.uint64(1) << ((block - low) % 64).astype(np.uint64)
        for c in order:
            if after[c]:
                seen[c] |= np.bitwise_or.reduce(seen[after[c]], axis=0)
        for c, vs in own:
            hit = np.flatnonzero(np.unpackbits(seen[c].view(np.uint8), bitorder="little")) + low
            if sizes[c] == 1:
                hit = hit[hit != c]
            if not len(hit):
                continue
            to = np.concatenate([members[h] for h in hit])
            step = max(1, many // len(to))
            for k in range(0, len(vs), step):
                some = vs[k : k + step]
                for j in range(0, len(to), many):
                    yield np.repeat(some, len(to[j : j + many])), np.tile(to[j : j + many], len(some))


def first_fit(g: Rows) -> np.ndarray:
    """In the order of ``many``, then of numbers, the first colour that no neighbour has yet. Edges are both ways."""
    rank = np.zeros(g.n, g.many.dtype)
    rank[g.source] = g.many
    to, first, last, colour = g.to.tolist(), g.first.tolist(), (g.first + g.count).tolist(), [-1] * g.n
    for v in np.lexsort((np.arange(g.n), rank)).tolist():
        near, c = {colour[u] for u in to[first[v] : last[v]]}, 0
        while c in near:
            c += 1
        colour[v] = c
    return np.array(colour)


def extended(g: Rows, low: int, high: int, max_depth: int, many: int = 1 << 21) -> np.ndarray:
    """[d - 1, v] counts pairs of neighbours of v at distance d without it, for pairs (v, neighbour) of rows ``low`` to ``high``.
    Edges are both ways; about ``many`` steps of walks are held."""
    walks = np.ones(g.n)
    for _ in range(max_depth):
        walks = np.bincount(g.source, walks[g.to], g.n)
    bound = np.cumsum(walks[g.to[low:high]])
    keys, out, at = np.sort(g.source * g.n + g.to), np.zeros((max_depth, g.n), np.int64), low
    while at < high:
        done = bound[at - low - 1] if at > low else 0
        end = max(at + 1, low + int(np.searchsorted(bound, done + many)))
        v, s = g.source[at:end], g.to[at:end]
        pair, place = np.arange(len(v)), s
        seen = pair * g.n + place
        for d in range(max_depth):
            rows, pair = _step(g, place, pair)
            place = g.to[rows]
            fresh = np.unique((pair * g.n + place)[place != v[pair]])
            fresh = fresh[~np.isin(fresh, seen)]
            seen = np.concatenate([seen, fresh])
            pair, place = fresh // g.n, fresh % g.n
            want = v[pair] * g.n + place
            hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
            out[d] += np.bincount(v[pair[hit]], minlength=g.n)
        at = end
    return out


def _step(g: Rows, place: np.ndarray, with_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows from each place, and what goes with it."""
    count = g.count[place]
    return np.repeat(g.first[place] - np.cumsum(count) + count, count) + np.arange(int(count.sum())), np.repeat(with_, count)


def sweeps(g: Rows, source: int) -> tuple[int, int, int]:
    """Length and ends: from ``source`` to the farthest vertex (of equals, least ``many``, then number) while that grows."""
    k = np.full(g.n, np.iinfo(np.int64).max)
    k[g.source] = g.many
    at, best, ends = source, -1, (source, source)
    while True:
        _, reached, dist = next(distances(g, range(at, at + 1)))
        far = reached[dist == dist.max()]
        to = int(far[np.lexsort((far, k[far]))[0]])
        if dist.max() <= best:
            return best, *ends
        best, ends, at = int(dist.max()), (at, to), to


def trusts(g: Rows, source: int) -> Iterator[tuple[int, int, float]]:
    """d, u and w of each edge from u to d: the largest product (of ``many``, up to 1) of a path from ``source`` to u that avoids d.

    Best paths form a tree; only those to vertices below d pass it, and they are searched anew among these alone.
    """
    into, out = [[] for _ in range(g.n)], [[] for _ in range(g.n)]
    for s, t, c in zip(g.source.tolist(), g.to.tolist(), g.many.tolist(), strict=True):
        into[t].append((s, c))
        out[s].append((t, c))
    best, up, order, heap = {}, {}, [], [(-1.0, source, source)]
    while heap:
        w, v, parent = heapq.heappop(heap)
        if v in best:
            continue
        best[v], up[v] = -w, parent
        order.append(v)
        for t, c in out[v]:
            if t not in best:
                heapq.heappush(heap, (w * c, t, v))
    below = [[] for _ in range(g.n)]
    for v in order[1:]:
        below[up[v]].append(v)
    enter, leave, work, walk = {}, {}, [(source, 0)], []
    while work:
        v, done = work.pop()
        if done:
            leave[v] = len(walk)
            continue
        enter[v] = len(walk)
        walk.append(v)
        work.append((v, 1))
        work += [(t, 0) for t in below[v]]
    for d in range(g.n):
        if d == source or not into[d]:
            continue
        again = {}
        if d in best and any(u in best and enter[d] <= enter[u] < leave[d] for u, _ in into[d]):
            inside = set(walk[enter[d] + 1 : leave[d]])
            heap = [(-best[y] * c, x) for x in inside for y, c in into[x] if y in best and y != d and y not in inside]
            heapq.heapify(heap)
            while heap:
                w, v = heapq.heappop(heap)
                if v in again:
                    continue
                again[v] = -w
                for t, c in out[v]:
                    if t in inside and t not in again:
                        heapq.heappush(heap, (w * c, t))
        for u, _ in into[d]:
            if u in best and not (d in best and enter[d] <= enter[u] < leave[d]):
                yield d, u, best[u]
            elif u in again:
                yield d, u, again[u]


def hashed(values: np.ndarray, seed: int) -> np.ndarray:
    """Spark's xxhash64 of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.full(len(values), 42, np.uint64) + p5 + np.uint64(8)
        h = mixed(turn(h ^ (turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        h = h + p5 + np.uint64(4)
        h = mixed(turn(h ^ (np.uint64(seed & 0xFFFFFFFF) * p1), 23) * p2 + p3)
    return h.view(np.int64)


def matched(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which edges a greedy matching takes, first edges first; ends are numbers below ``n``."""
    taken, left, free = np.zeros(len(a), bool), np.arange(len(a)), np.ones(n, bool)
    for _ in range(64):
        if not len(left):
            return taken
        x, y = a[left], b[left]
        first = np.full(n, -1)
        first[np.stack([x, y], 1)[::-1].ravel()] = np.repeat(left[::-1], 2)  # the last one written, the smallest, stays
        won = left[(first[x] == left) & (first[y] == left)]
        taken[won], free[a[won]], free[b[won]] = True, False, False
        left = left[free[x] & free[y]]
    for k in left.tolist():  # long chains of edges, each waiting for the one before
        if free[a[k]] and free[b[k]]:
            taken[k], free[a[k]], free[b[k]] = True, False, False
    return taken


def coarsened(ids: np.ndarray, size: np.ndarray, src: np.ndarray, dst: np.ndarray, eid: np.ndarray, count: np.ndarray, first: tuple[np.ndarray, ...], seed: int, directed: bool, levels: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Coarser and coarser graphs of greedy matchings, where a block has the smaller id of its two ends: who (its number among the
    sorted ``ids``), level and block of each change of a vertex's block, and who, level and size of each change of a block's size.
    ``first`` orders the edges of the first level; then those of largest count, by hash."""
    n = len(ids)
    a, b, at, size, moves, grown = np.searchsorted(ids, src), np.searchsorted(ids, dst), np.arange(n), size.copy(), [], []
    for level in range(1, levels + 1):
        if not len(a):
            break
        order = np.lexsort(first[::-1])
        won = order[matched(a[order], b[order], n)]
        low, high = np.minimum(a[won], b[won]), np.maximum(a[won], b[won])
        into = np.arange(n)
        into[high] = low
        new = into[at]
        who = np.flatnonzero(new != at)
        moves.append((who, np.full(len(who), level), new[who]))
        size[low] += size[high]
        grown.append((low, np.full(len(low), level), size[low]))
        at, a, b = new, into[a], into[b]
        if not directed:
            a, b = np.minimum(a, b), np.maximum(a, b)
        apart = a != b
        a, b, eid, count = a[apart], b[apart], eid[apart], count[apart]
        if len(a):
            order = np.argsort(a * n + b, kind="stable")
            a, b, eid, count = a[order], b[order], eid[order], count[order]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, eid, count = a[starts], b[starts], np.minimum.reduceat(eid, starts), np.add.reduceat(count, starts)
        first = (-count, hashed(eid, seed + level), eid)

    def by_who(parts, kind):
        who, level, value = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.int64), (2, kind)))
        order = np.lexsort((level, who))
        return who[order], level[order], value[order]

    who, level, block = by_who(moves, np.int64)
    return (who, level, ids[block]), by_who(grown, np.float64)
