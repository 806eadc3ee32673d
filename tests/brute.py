"""Plain graph algorithms that the tests compare with."""

from __future__ import annotations

from collections import defaultdict


def neighbours(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def component_of(adj, start, without=()):
    seen, todo = {start}, [start]
    while todo:
        for w in adj[todo.pop()]:
            if w not in seen and w not in without:
                seen.add(w)
                todo.append(w)
    return seen


def components(edges, vertices=()):
    adj = neighbours(edges)
    out = {}
    for v in sorted({*vertices, *adj}):
        if v not in out:
            for w in component_of(adj, v):
                out[w] = v
    return out


def blocks(edges):
    """The smallest edge of each edge's block, by the stack of a depth-first search."""
    adj = neighbours(edges)
    order, low, out, stack = {}, {}, {}, []

    def close(until):
        own = []
        while True:
            own.append(stack.pop())
            if own[-1] == until:
                break
        own = {tuple(sorted(e)) for e in own}
        for e in own:
            out[e] = min(own)

    for root in sorted(adj):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        path = [(root, None, iter(sorted(adj[root])))]
        while path:
            v, parent, rest = path[-1]
            for w in rest:
                if w not in order:
                    stack.append((v, w))
                    order[w] = low[w] = len(order)
                    path.append((w, v, iter(sorted(adj[w]))))
                    break
                if w != parent and order[w] < order[v]:
                    stack.append((v, w))
                    low[v] = min(low[v], order[w])
            else:
                path.pop()
                if path:
                    up = path[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] >= order[up]:
                        close((up, v))
    return out


def articulation(edges):
    of = defaultdict(set)
    for (a, b), name in blocks(edges).items():
        of[a].add(name)
        of[b].add(name)
    return {v for v, names in of.items() if len(names) > 1}


def bridges(edges):
    count = defaultdict(list)
    for e, name in blocks(edges).items():
        count[name].append(e)
    return {own[0] for own in count.values() if len(own) == 1}
