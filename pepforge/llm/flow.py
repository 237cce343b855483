"""Maximum flow, which the minimum cut of a page and the mix of sources share."""

from __future__ import annotations


class Network:
    """Maximum flow by shortest augmenting paths with level graphs. Capacities are numbers; under 1e-9 is none."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, there: float, back: float = 0) -> int:
        """The new arc's number; the one after it leads back."""
        for x, y, c in ((a, b, there), (b, a, back)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
        return len(self.to) - 2

    def levels(self, source: int) -> list[int]:
        far = [-1] * len(self.arcs)
        far[source] = 0
        queue = [source]
        for a in queue:
            for e in self.arcs[a]:
                if self.room[e] > 1e-9 and far[self.to[e]] < 0:
                    far[self.to[e]] = far[a] + 1
                    queue.append(self.to[e])
        return far

    def fill(self, source: int, sink: int) -> list[int]:
        """Adds flow until no more fits; the levels that are left."""
        while (far := self.levels(source))[sink] >= 0:
            at = [0] * len(self.arcs)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    amount = min(self.room[e] for e in path)
                    first = len(path)
                    for k, e in enumerate(path):
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                        if self.room[e] <= 1e-9 and k < first:
                            first = k
                    a = self.to[path[first] ^ 1]  # goes on before the first arc that is full
                    del path[first:]
                    continue
                while at[a] < len(self.arcs[a]):
                    e = self.arcs[a][at[a]]
                    if self.room[e] > 1e-9 and far[self.to[e]] == far[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.arcs[a]):
                    path.append(self.arcs[a][at[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break
        return far

    def source_side(self, source: int, sink: int) -> list[bool]:
        """After the flow: what the source still reaches."""
        return [x >= 0 for x in self.fill(source, sink)]
