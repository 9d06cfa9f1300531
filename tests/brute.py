"""Slow, plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from itertools import product


def spread(values):
    if len(values) < 2:
        return None
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))


def packet_stats(packets, starts, size):
    """{(window, ip): {role: (count, sum, min, max, mean, spread, gaps...)}} by scanning every window."""
    out = {}
    for k, start in enumerate(starts):
        inside = [p for p in packets if start <= p[2] < start + size]
        for role, column in (("Source", 0), ("Destination", 1)):
            by_ip = defaultdict(list)
            for p in inside:
                by_ip[p[column]].append((p[2], p[3]))
            for ip, seen in by_ip.items():
                times = sorted(t for t, _ in seen)
                sizes = [s for _, s in seen]
                gaps = [(b - a) / 1e6 for a, b in zip(times, times[1:])]
                out.setdefault((k, ip), {})[role] = (
                    len(sizes), sum(sizes), min(sizes), max(sizes), sum(sizes) / len(sizes), spread(sizes),
                    min(gaps) if gaps else None, max(gaps) if gaps else None,
                    sum(gaps) / len(gaps) if gaps else None, spread(gaps),
                )
    return out


def betweenness(edges):
    """All-pairs definition over one breadth-first search per node."""
    nodes = sorted({x for e in edges for x in e})
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    dist, paths = {}, {}
    for s in nodes:
        d, p, queue = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    queue.append(w)
                if d[w] == d[v] + 1:
                    p[w] += p[v]
        dist[s], paths[s] = d, p
    score = dict.fromkeys(nodes, 0.0)
    for s, v, t in product(nodes, repeat=3):
        if len({s, v, t}) == 3 and t in dist[s] and v in dist[s] and t in dist[v]:
            if dist[s][v] + dist[v][t] == dist[s][t]:
                score[v] += paths[s][v] * paths[v][t] / paths[s][t]
    n = len(nodes)
    return {v: score[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v in nodes}


def eigenvector(edges, steps=100, tolerance=1e-6):
    nodes = sorted({x for e in edges for x in e})
    x = {v: 1.0 / len(nodes) for v in nodes}
    for _ in range(steps):
        y = dict(x)
        for a, b in edges:
            y[b] += x[a]
        norm = math.sqrt(sum(v * v for v in y.values()))
        y = {k: v / norm for k, v in y.items()}
        moved = sum(abs(y[k] - x[k]) for k in nodes)
        x = y
        if moved < len(nodes) * tolerance:
            return x
    return dict.fromkeys(nodes, 0.0)


def agreement(pairs):
    """Accuracy, homogeneity, completeness, v-measure, adjusted Rand, adjusted mutual information."""
    n = len(pairs)
    cell, a, b = defaultdict(int), defaultdict(int), defaultdict(int)
    for c, k in pairs:
        cell[c, k] += 1
        a[c] += 1
        b[k] += 1

    def entropy(counts):
        return -sum(v / n * math.log(v / n) for v in counts.values())

    def choose2(v):
        return v * (v - 1) / 2

    hc, hk = entropy(a), entropy(b)
    mi = max(0.0, sum(v / n * math.log(v * n / (a[c] * b[k])) for (c, k), v in cell.items()))
    hom = mi / hc if hc else 1.0
    com = mi / hk if hk else 1.0
    vm = 2 * hom * com / (hom + com) if hom + com else 0.0
    together = sum(choose2(v) for v in cell.values())
    pa, pb = sum(map(choose2, a.values())), sum(map(choose2, b.values()))
    emi = 0.0
    for x, y in product(a.values(), b.values()):
        for k in range(max(1, x + y - n), min(x, y) + 1):
            chance = math.comb(y, k) * math.comb(n - y, x - k) / math.comb(n, x)
            emi += k / n * math.log(n * k / (x * y)) * chance
    single = not hc and not hk
    chance = pa * pb / choose2(n)
    ari = 1.0 if single or (pa + pb) / 2 == chance else (together - chance) / ((pa + pb) / 2 - chance)
    room = (hc + hk) / 2 - emi
    ami = 1.0 if single else (mi - emi) / room if abs(room) > 1e-12 else 0.0
    return (sum(c == k for c, k in pairs) / n, hom, com, vm, ari, ami)
