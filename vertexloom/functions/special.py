"""Closed forms over logarithms of factorials, plain Python on small numbers."""

from __future__ import annotations

import math


def lbinom(n: float, k: float) -> float:
    """ln C(n, k); 0 where a side vanishes."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if n > 0 and k > 0 and n > k else 0.0


def xlogx(x: float) -> float:
    return x * math.log(x) if x > 0 else 0.0


def partition_entropy(sizes: list[int], states: int | None = None) -> float:
    """ln C(B + N - 1, N) + ln N! - sum ln n_r! over the occupied blocks."""
    n, b = sum(sizes), states or sum(s > 0 for s in sizes)
    return lbinom(b + n - 1, n) + math.lgamma(n + 1) - sum(math.lgamma(s + 1) for s in sizes)


def model_entropy(blocks: int, vertices: int, edges: int, directed: bool = False) -> float:
    """ln C(B (B + 1) / 2 + E - 1, E), of B ** 2 if directed, and N ln B for the partition."""
    pairs = blocks**2 if directed else blocks * (blocks + 1) / 2
    return lbinom(pairs + edges - 1, edges) + (vertices * math.log(blocks) if blocks > 1 else 0.0)


def max_blocks(vertices: int, edges: int, directed: bool = False) -> int:
    """The most blocks that can be told apart: where the model's cost for an edge less ln B, the most that blocks can save
    on it, is least. It falls and then rises, so thirds of the range are compared; 2 at least, ``vertices`` at most."""

    def cost(b: int) -> float:
        return model_entropy(b, vertices, edges, directed) / edges - math.log(b)

    low, high = 1, max(2, int(edges))
    while high - low > 2:
        third = (high - low) // 3
        if cost(low + third) <= cost(high - third):
            high -= third
        else:
            low += third
    return min(int(vertices), max(2, min(range(low, high + 1), key=cost)))


def average_degree_limit(blocks: int, mutual: float, vertices: float = math.inf, directed: bool = False) -> float:
    """The average degree at which a partition of so much mutual information becomes visible.

    With finitely many vertices it is where the model's cost for an edge meets ``mutual`` times the edges, by bisection.
    """
    if math.isinf(vertices):
        return (math.log(blocks) if blocks > 1 else 0.0) / max(mutual, 1e-300) * (1 if directed else 2)

    def short(degree: float) -> bool:
        edges = vertices * degree / (1 if directed else 2)
        return model_entropy(blocks, vertices, edges, directed) / edges > edges * mutual

    low, high = 0.0, 1.0
    while short(high):
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if middle and short(middle) else (low, middle)
    return high


def fast_partitions(n: int, e: int) -> float:
    """The approximation 2 sqrt(zeta(2) e) of ln of the number of partitions."""
    return 2 * math.sqrt(math.pi**2 / 6 * e) if e > 0 else 0.0
