"""Two-label minimum cut by maximum flow (Dinic's algorithm on residual arcs)."""

from __future__ import annotations

from collections import deque


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    source[i] is paid where i is on the sink's side, sink[i] where it is on the source's, an edge's weight where its
    ends are apart. Nodes that either side suits equally well go to the sink's.
    """
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, ab: float, ba: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(ab)
        heads[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i in range(n):  # what flows straight through a node need not be searched for
        through = min(source[i], sink[i])
        if source[i] > through:
            arc(s, i, source[i] - through, 0.0)
        elif sink[i] > through:
            arc(i, t, sink[i] - through, 0.0)
    for a, b, w in edges:
        if w > 0 and a != b:
            arc(a, b, w, w)

    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for k in heads[x]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[x] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_arc = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(room[k] for k in path)
                for k in path:
                    room[k] -= flow
                    room[k ^ 1] += flow
                # go back to before the first arc that is full
                at = next(i for i, k in enumerate(path) if room[k] <= tiny)
                x = to[path[at] ^ 1]
                del path[at:]
                continue
            while next_arc[x] < len(heads[x]):
                k = heads[x][next_arc[x]]
                if room[k] > tiny and level[to[k]] == level[x] + 1:
                    break
                next_arc[x] += 1
            else:
                if x == s:
                    break
                level[x] = -1
                k = path.pop()
                x = to[k ^ 1]
                continue
            path.append(k)
            x = to[k]
