"""Integral min-cost flow for small planning networks (a few hundred arcs, any capacities).

The networks of this subpackage are built from counts, never from records, so their size is fixed by the number of
cells, sources or splits. Successive shortest paths with potentials; each augmentation fills at least one arc, so the
work follows the number of arcs, not the amount of flow.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable

INF = 1 << 60


class Network:
    """A directed network; arcs may have negative costs as long as no cycle of positive capacity is negative."""

    def __init__(self) -> None:
        self.ids: dict[Hashable, int] = {}
        self.heads: list[list[int]] = []
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def node(self, name: Hashable) -> int:
        if name not in self.ids:
            self.ids[name] = len(self.heads)
            self.heads.append([])
        return self.ids[name]

    def arc(self, a: Hashable, b: Hashable, cap: int, cost: int = 0) -> int:
        """Add an arc and return its handle for :meth:`flow`."""
        u, v, k = self.node(a), self.node(b), len(self.to)
        for x, y, c, w in ((u, v, int(cap), int(cost)), (v, u, 0, -int(cost))):
            self.heads[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def flow(self, handle: int) -> int:
        return self.cap[handle ^ 1]

    def send(self, source: Hashable, sink: Hashable, amount: int) -> tuple[int, int]:
        """Send up to ``amount`` units at least cost; returns (units sent, cost)."""
        s, t, n = self.node(source), self.node(sink), len(self.heads)
        potential = self._bellman_ford(s)
        sent = total = 0
        while sent < amount:
            dist, via, heap = [INF] * n, [-1] * n, [(0, s)]
            dist[s] = 0
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.heads[u]:
                    v = self.to[k]
                    if self.cap[k] > 0 and potential[v] < INF and (e := d + self.cost[k] + potential[u] - potential[v]) < dist[v]:
                        dist[v], via[v] = e, k
                        heapq.heappush(heap, (e, v))
            if dist[t] >= INF:
                break
            for v in range(n):
                if dist[v] < INF:
                    potential[v] += dist[v]
            push, v = amount - sent, t
            while v != s:
                push, v = min(push, self.cap[via[v]]), self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                total += push * self.cost[via[v]]
                v = self.to[via[v] ^ 1]
            sent += push
        return sent, total

    def _bellman_ford(self, s: int) -> list[int]:
        n = len(self.heads)
        dist = [INF] * n
        dist[s] = 0
        for _ in range(n):
            changed = False
            for u in range(n):
                if dist[u] < INF:
                    for k in self.heads[u]:
                        if self.cap[k] > 0 and dist[u] + self.cost[k] < dist[self.to[k]]:
                            dist[self.to[k]] = dist[u] + self.cost[k]
                            changed = True
            if not changed:
                break
        return dist


def apportion(shares: list[float], total: int) -> list[int]:
    """Integers near ``share * total`` that add up to the rounded sum, by largest remainder; ties go to the earlier."""
    exact = [s * total for s in shares]
    whole = [int(x) for x in exact]
    rest = round(sum(exact)) - sum(whole)
    for i in sorted(range(len(exact)), key=lambda i: (whole[i] - exact[i], i))[: max(0, rest)]:
        whole[i] += 1
    return whole


def slices(handle_caps: int, parts: int = 4) -> list[int]:
    """Cut a capacity into at most ``parts`` positive pieces, for convex costs."""
    step, out = max(1, -(-handle_caps // parts)), []
    while handle_caps > 0:
        out.append(min(step, handle_caps))
        handle_caps -= out[-1]
    return out
