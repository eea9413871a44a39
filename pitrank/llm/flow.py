"""Min-cost flow on small bipartite networks, by successive shortest paths."""
from __future__ import annotations

import math
from collections import deque


class Network:
    """Arcs with capacity and cost. Capacities may be fractions; costs are small integers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[float] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: float, cost: int) -> int:
        """An arc and, next to it, its reverse. Returns the arc's number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.head) - 2

    def flow_on(self, arc: int) -> float:
        return self.room[arc + 1]

    def _path(self, source: int, sink: int, tiny: float) -> list[int]:
        """Arcs of a cheapest path with room (label correcting, since reverse arcs have negative costs)."""
        best = [math.inf] * len(self.out)
        via = [-1] * len(self.out)
        best[source], queue, waiting = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in self.out[a]:
                b = self.head[e]
                if self.room[e] > tiny and best[a] + self.cost[e] < best[b]:
                    best[b], via[b] = best[a] + self.cost[e], e
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        path, at = [], sink
        while at != source:
            if via[at] < 0:
                return []
            path.append(via[at])
            at = self.head[via[at] ^ 1]
        return path

    def run(self, source: int, sink: int, tiny: float = 1e-6) -> None:
        while path := self._path(source, sink, tiny):
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def route(patterns: list[tuple[list[str], float]], targets: dict[str, float],
          copy_costs: list[int]) -> list[dict[str, float]]:
    """Words that each membership pattern gives to each of its sources.

    Pattern -> source arcs are free; every pattern may be used once per entry of ``copy_costs``, at that cost per word,
    so that repeating starts only where first copies do not suffice. Sources take up to their targets.
    """
    names = sorted(targets)
    net = Network(2 + len(patterns) + len(names))
    place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    arcs = []
    for i, (sources, size) in enumerate(patterns):
        for cost in copy_costs:
            net.add(0, 2 + i, size, cost)
        arcs.append({s: net.add(2 + i, place[s], math.inf, 0) for s in sources})
    for s in names:
        net.add(place[s], 1, targets[s], 0)
    net.run(0, 1)
    return [{s: net.flow_on(e) for s, e in of.items()} for of in arcs]
