"""Minimum cut of a small labelling graph (helper for one page)."""

from __future__ import annotations

from collections import deque


def source_side(terminals: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stand on the source side of a minimum cut.

    ``terminals``: positive values are capacities from the source, negative ones to the sink. ``edges`` are undirected.
    A node whose terminal outweighs all its edges takes its own side in every minimum cut; such nodes are settled
    first, which leaves little or nothing to the flow. Nodes that the cut leaves open go to the sink side.
    """
    n = len(terminals)
    weight = list(terminals)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(weight[i]) > sum(near[i].values()):
            side[i] = weight[i] > 0
            for j, w in near[i].items():
                weight[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, inside in zip(left, _cut(left, weight, near)):
            side[i] = inside
    return [bool(x) for x in side]


def _cut(nodes: list[int], weight: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths in levels, then what the source still reaches."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if weight[i] > 0:
            room[source][i], room[i][source] = weight[i], 0.0
        elif weight[i] < 0:
            room[i][sink], room[sink][i] = -weight[i], 0.0
    tiny = 1e-12
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for j, r in room[i].items():
                if r > tiny and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if sink not in level:
            return [i in level for i in nodes]
        onward = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                first = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= tiny)
                del path[first + 1:]
                onward[path[-1]] = iter([j for j in room[path[-1]]])
                continue
            step = next((j for j in onward[i] if room[i][j] > tiny and level.get(j, -9) == level[i] + 1), None)
            if step is None:
                path.pop()
                if path:
                    level[i] = -9
            else:
                path.append(step)
