"""Small graphs, and sequential checkers to compare with."""

import heapq
import random
from collections import defaultdict, deque

from graphspark.graph import Graph

M1 = [(0, 0, 1, 4.0), (1, 0, 2, 1.0), (2, 2, 1, 2.0), (3, 1, 3, 5.0), (4, 3, 1, 1.0), (5, 3, 4, 3.0), (6, 5, 6, 1.0), (7, 2, 2, 7.0), (8, 0, 1, 6.0)]


def graph(spark, arcs, vertices):
    rows = [(s, d, float(w)) for s, d, w in arcs]
    return Graph(spark.range(vertices), spark.createDataFrame(rows, "src long, dst long, weight double"))


def m1(spark):
    return graph(spark, [(s, d, w) for _, s, d, w in M1], 8)


def random_arcs(seed, vertices, arcs):
    r = random.Random(seed)
    return [(r.randrange(vertices), r.randrange(vertices), r.randint(1, 20)) for _ in range(arcs)]


def column(df, name):
    return {r["id"]: r[name] for r in df.select("id", name).collect()}


def bfs(n, arcs, source):
    out = defaultdict(list)
    for s, d, _ in arcs:
        out[s].append(d)
    level, todo = {v: -1 for v in range(n)}, deque([source])
    level[source] = 1
    while todo:
        v = todo.popleft()
        for d in out[v]:
            if level[d] == -1:
                level[d] = level[v] + 1
                todo.append(d)
    return level


def dijkstra(n, arcs, source, infinity):
    out = defaultdict(list)
    for s, d, w in arcs:
        out[s].append((d, float(w)))
    dist, heap = {v: infinity for v in range(n)}, [(0.0, source)]
    dist[source] = 0.0
    while heap:
        x, v = heapq.heappop(heap)
        if x > dist[v]:
            continue
        for d, w in out[v]:
            if x + w < dist[d]:
                dist[d] = x + w
                heapq.heappush(heap, (x + w, d))
    return dist


def widest(n, arcs, source, infinity):
    width = {v: 0.0 for v in range(n)}
    width[source] = infinity
    changed = True
    while changed:
        changed = False
        for s, d, w in arcs:
            x = min(width[s], float(w))
            if x > width[d]:
                width[d], changed = x, True
    return width


def components(n, arcs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, d, _ in arcs:
        a, b = find(s), find(d)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in range(n)}


def strong(n, arcs):
    reach = {v: {u for u, x in bfs(n, arcs, v).items() if x > 0} for v in range(n)}
    return {v: min(u for u in reach[v] if v in reach[u]) for v in range(n)}


def page_rank(n, arcs, iterations, damping=0.85):
    arcs = [(s, d) for s, d, _ in arcs if s != d]
    degree = defaultdict(int)
    for s, _ in arcs:
        degree[s] += 1
    rank = {v: 1 / n for v in range(n)}
    for _ in range(iterations):
        hanging = sum(rank[v] for v in range(n) if not degree[v])
        new = {v: (1 - damping) / n + damping * hanging / n for v in range(n)}
        for s, d in arcs:
            new[d] += damping * rank[s] / degree[s]
        rank = new
    return rank


def greedy_colours(n, arcs):
    around = defaultdict(set)
    for s, d, _ in arcs:
        if s != d:
            around[s].add(d)
            around[d].add(s)
    colour = {}
    for v in range(n):
        used = {colour[u] for u in around[v] if u < v}
        colour[v] = next(k for k in range(n) if k not in used)
    return colour


def edmonds_karp(n, arcs, source, sink):
    left = defaultdict(float)
    for s, d, w in arcs:
        if s != d:
            left[s, d] += w
    total = 0.0
    while True:
        parent, todo = {source: None}, deque([source])
        while todo and sink not in parent:
            v = todo.popleft()
            for u in range(n):
                if u not in parent and left[v, u] > 0:
                    parent[u] = v
                    todo.append(u)
        if sink not in parent:
            return total
        path, v = [], sink
        while parent[v] is not None:
            path.append((parent[v], v))
            v = parent[v]
        push = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= push
            left[b, a] += push
        total += push
