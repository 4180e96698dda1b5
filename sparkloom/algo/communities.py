"""Exact sequential community algorithms, for ``kernels.run``: fn(sorted ids, sorted (eid, src, dst, w)) gives (id, community_id) rows.

Those that draw at random take the draws from a fixed seed and the nodes' order, so reruns agree. Communities are numbered by their smallest node.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np

from sparkloom.algo.kernels import _hops, _number, louvain, simple
from sparkloom.algo.structure import blocks

MAX_SPECTRAL = 4_096


def _quality(adj: dict, label: dict) -> float:
    m = sum(map(len, adj.values())) / 2
    inner, total = Counter(), Counter()
    for v, near in adj.items():
        total[label[v]] += len(near)
        inner[label[v]] += sum(label[u] == label[v] for u in near) / 2
    return sum(inner[c] / m - (total[c] / (2 * m)) ** 2 for c in total) if m else 0.0


def _parts(adj: dict, among: set) -> list[list]:
    out, left = [], set(among)
    for v in sorted(among):
        if v in left:
            found = sorted(_hops({x: [u for u in adj[x] if u in among] for x in among}, v))
            left -= set(found)
            out.append(found)
    return out


def leiden(nodes, edges):
    """Louvain's communities, split where they aren't connected and then moved once more, until nothing changes: every community is connected."""
    adj, label = simple(nodes, edges), dict(louvain()(nodes, edges))
    m2 = sum(map(len, adj.values()))
    for _ in range(20):
        groups, before = defaultdict(set), dict(label)
        for v, c in label.items():
            groups[c].add(v)
        label, tot = {}, Counter()
        for found in (p for c in sorted(groups) for p in _parts(adj, groups[c])):
            for v in found:
                label[v] = found[0]
                tot[found[0]] += len(adj[v])
        for v in nodes:
            links = Counter(label[u] for u in adj[v])
            tot[label[v]] -= len(adj[v])
            gain = lambda c, links=links, v=v: links[c] - tot[c] * len(adj[v]) / max(1, m2)
            best = max(sorted(links), key=gain, default=label[v])
            if gain(best) > gain(label[v]) + 1e-12:
                label[v] = best
            tot[label[v]] += len(adj[v])
        if _number(label) == _number(before):
            break
    groups = defaultdict(set)
    for v, c in label.items():
        groups[c].add(v)
    return _number({v: p[0] for c in groups for p in _parts(adj, groups[c]) for v in p})


def speaker_listener(nodes, edges, sweeps: int = 100, least: float = 0.05):
    """Each listener remembers the label that its neighbours say most; a node's label is the one it remembers most, if at least ``least`` of its memory."""
    adj, rnd = {v: sorted(x) for v, x in simple(nodes, edges).items()}, random.Random(0)
    memory = {v: [v] for v in nodes}
    for _ in range(sweeps):
        order = list(nodes)
        rnd.shuffle(order)
        for v in order:
            if adj[v]:
                said = Counter(rnd.choice(memory[u]) for u in adj[v])
                memory[v].append(min(said, key=lambda c, said=said: (-said[c], c)))
    label = {}
    for v in nodes:
        c = Counter(memory[v])
        top = min(c, key=lambda x, c=c: (-c[x], x))
        label[v] = top if c[top] >= least * len(memory[v]) else v
    return _number(label)


def _edge_betweenness(adj: dict) -> Counter:
    out: Counter = Counter()
    for s in adj:
        order, up, paths, far = [s], defaultdict(list), {s: 1.0}, {s: 0}
        for v in order:
            for u in adj[v]:
                if u not in far:
                    far[u], paths[u] = far[v] + 1, 0.0
                    order.append(u)
                if far[u] == far[v] + 1:
                    paths[u] += paths[v]
                    up[u].append(v)
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in up[u]:
                x = paths[v] / paths[u] * (1 + share[u])
                share[v] += x
                out[min(u, v), max(u, v)] += x / 2
    return out


def girvan_newman(nodes, edges):
    """Takes the edge of most shortest paths away, time after time; the level of highest modularity is kept."""
    whole = simple(nodes, edges)
    adj, best, level = {v: set(x) for v, x in whole.items()}, None, -1
    while True:
        parts = _parts(adj, set(nodes))
        if len(parts) != level:
            level, label = len(parts), {v: p[0] for p in parts for v in p}
            q = _quality(whole, label)
            if best is None or q > best[0] + 1e-12:
                best = (q, label)
        loads = _edge_betweenness(adj)
        if not loads:
            return _number(best[1])
        a, b = min(loads, key=lambda e: (-round(loads[e], 9), e))
        adj[a].discard(b)
        adj[b].discard(a)


def fastgreedy(nodes, edges):
    """Merges the two linked communities that gain most modularity, down to one a component; the best level is kept."""
    adj = simple(nodes, edges)
    m2 = sum(map(len, adj.values()))
    e = {v: {u: 1 / m2 for u in x} for v, x in adj.items()} if m2 else {v: {} for v in nodes}
    a, label = {v: len(adj[v]) / max(1, m2) for v in nodes}, {v: v for v in nodes}
    q = -sum(x * x for x in a.values())
    best, merges, top = q, [], 0
    while True:
        gains = [(-(2 * (x - a[i] * a[j])), i, j) for i in e for j, x in e[i].items() if i < j]
        if not gains:
            break
        gain, i, j = min(gains)
        for k, x in e.pop(j).items():
            e[k].pop(j)
            if k != i:
                e[i][k] = e[k][i] = e[i].get(k, 0.0) + x
        a[i] += a.pop(j)
        merges.append((i, j))
        q -= gain
        if q > best + 1e-12:
            best, top = q, len(merges)
    for i, j in merges[:top]:
        label = {v: i if c == j else c for v, c in label.items()}
    return _number(label)


def infomap(directed: bool, teleport: float = 0.15):
    """Two-level map equation: nodes move to the neighbouring module that shortens the code most."""

    def fn(nodes, edges):
        place = {v: i for i, v in enumerate(nodes)}
        n, w = len(nodes), defaultdict(float)
        for _, s, t, x in edges:
            if s != t:
                w[place[s], place[t]] += x
                if not directed:
                    w[place[t], place[s]] += x
        out = np.zeros(n)
        for (s, _), x in w.items():
            out[s] += x
        p = np.full(n, 1 / max(1, n))
        for _ in range(200 if w else 0):
            new = np.zeros(n)
            for (s, t), x in w.items():
                new[t] += p[s] * x / out[s]
            lost = p[out == 0].sum()
            new = (1 - teleport) * (new + lost / n) + teleport / n if directed else new + lost / n
            if not directed:
                new = out / out.sum()
            if np.abs(new - p).sum() < 1e-12:
                break
            p = new
        flow = {k: p[k[0]] * x / out[k[0]] for k, x in w.items()}
        near = defaultdict(set)
        for s, t in flow:
            near[s].add(t)
            near[t].add(s)
        label = list(range(n))
        log = lambda x: x * np.log2(x) if x > 1e-15 else 0.0

        def code() -> float:
            leave, inside = defaultdict(float), defaultdict(float)
            for v in range(n):
                inside[label[v]] += p[v]
            for (s, t), x in flow.items():
                if label[s] != label[t]:
                    leave[label[s]] += x
            q = sum(leave.values())
            return log(q) - 2 * sum(log(leave[c]) for c in inside) + sum(log(leave[c] + inside[c]) for c in inside) - sum(map(log, p))

        now, moved = code(), True
        while moved:
            moved = False
            for v in range(n):
                for c in sorted({label[u] for u in near[v]} - {label[v]}):
                    old, label[v] = label[v], c
                    new = code()
                    if new < now - 1e-10:
                        now, moved = new, True
                    else:
                        label[v] = old
        return _number({nodes[v]: label[v] for v in range(n)})

    return fn


def leading_eigenvector(nodes, edges):
    """Halves by the signs of the modularity matrix's first eigenvector, as long as that gains."""
    if len(nodes) > MAX_SPECTRAL:
        raise ValueError(f"over {MAX_SPECTRAL} nodes")
    adj, at = simple(nodes, edges), {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for v, near in adj.items():
        a[at[v], [at[u] for u in near]] = 1
    k, m2 = a.sum(1), a.sum()
    label, todo = dict.fromkeys(nodes, 0), [list(range(len(nodes)))] if m2 else []
    names = iter(range(1, 2 * len(nodes) + 1))
    while todo:
        g = todo.pop()
        b = a[np.ix_(g, g)] - np.outer(k[g], k[g]) / m2
        b -= np.diag(b.sum(1))
        value, vector = np.linalg.eigh(b)
        s = np.where(vector[:, -1] >= 0, 1, -1)
        if value[-1] <= 1e-9 or s @ b @ s <= 1e-9 or abs(s.sum()) == len(s):
            continue
        halves = [[v for v, x in zip(g, s) if x == sign] for sign in (1, -1)]
        name = next(names)
        for v in halves[1]:
            label[nodes[v]] = name
        todo += halves
    return _number(label) if m2 else [(v, i) for i, v in enumerate(nodes)]


def walktrap(nodes, edges, steps: int = 4):
    """Ward merges of linked communities by the distance of their ``steps``-step walks; the level of highest modularity is kept."""
    if len(nodes) > MAX_SPECTRAL:
        raise ValueError(f"over {MAX_SPECTRAL} nodes")
    adj, at = simple(nodes, edges), {v: i for i, v in enumerate(nodes)}
    a = np.eye(len(nodes))
    for v, near in adj.items():
        a[at[v], [at[u] for u in near]] = 1
    d = a.sum(1)
    p = np.linalg.matrix_power(a / d[:, None], steps) / np.sqrt(d)
    size, mean = dict.fromkeys(range(len(nodes)), 1), {i: p[i] for i in range(len(nodes))}
    near = {at[v]: {at[u] for u in x} for v, x in adj.items()}
    gap = lambda i, j: size[i] * size[j] / (size[i] + size[j]) * float(((mean[i] - mean[j]) ** 2).sum())
    todo = {(i, j): gap(i, j) for i in near for j in near[i] if i < j}
    label = {v: at[v] for v in nodes}
    best = (_quality(adj, label), dict(label))
    while todo:
        i, j = min(todo, key=lambda e: (todo[e], e))
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        for k in near.pop(j):
            near[k].discard(j)
            todo.pop((min(j, k), max(j, k)))
            if k != i:
                near[k].add(i)
                near[i].add(k)
        for k in near[i]:
            todo[min(i, k), max(i, k)] = gap(i, k)
        label = {v: i if c == j else c for v, c in label.items()}
        q = _quality(adj, label)
        if q > best[0] + 1e-12:
            best = (q, dict(label))
    return _number(best[1])


def spinglass(nodes, edges, spins: int = 25, hot: float = 1.0, cold: float = 0.01, cool: float = 0.99):
    """Potts annealing of modularity."""
    if len(nodes) > MAX_SPECTRAL:
        raise ValueError(f"over {MAX_SPECTRAL} nodes")
    adj, rng = simple(nodes, edges), np.random.default_rng(0)
    m2 = max(1, sum(map(len, adj.values())))
    spin = {v: int(s) for v, s in zip(nodes, rng.integers(0, spins, len(nodes)))}
    total = np.zeros(spins)
    for v in nodes:
        total[spin[v]] += len(adj[v])
    t = hot
    while t > cold:
        for v in nodes:
            total[spin[v]] -= len(adj[v])
            links = np.zeros(spins)
            for u in adj[v]:
                links[spin[u]] += 1
            gain = (links - total * len(adj[v]) / m2) / t
            chance = np.exp(gain - gain.max())
            spin[v] = int(rng.choice(spins, p=chance / chance.sum()))
            total[spin[v]] += len(adj[v])
        t *= cool
    groups = defaultdict(set)
    for v, s in spin.items():
        groups[s].add(v)
    return _number({v: p[0] for g in groups.values() for p in _parts(adj, g) for v in p})


def max_k_cut(nodes, edges, k: int = 2):
    """Single nodes move to the side with fewest links, parallels counted, until none gains; the first node is on side 0."""
    w: dict = {v: Counter() for v in nodes}
    for _, a, b, _ in edges:
        if a != b:
            w[a][b] += 1
            w[b][a] += 1
    side, moved = dict.fromkeys(nodes, 0), True
    while moved:
        moved = False
        for v in nodes:
            links = Counter({c: 0 for c in range(k)})
            for u, x in w[v].items():
                links[side[u]] += x
            c = min(range(k), key=lambda c, links=links: (links[c], c))
            if links[c] < links[side[v]]:
                side[v], moved = c, True
    names = {side[nodes[0]]: 0} if nodes else {}
    return [(v, names.setdefault(side[v], len(names))) for v in nodes]


def biconnected(nodes, edges):
    """A node's community is the first block that it is in, blocks in the order of their nodes; nodes in none are alone."""
    first: dict = {}
    for i, block in enumerate(sorted(sorted(b) for b in blocks(simple(nodes, edges)))):
        for v in block:
            first.setdefault(v, i)
    return _number({v: ("block", first[v]) if v in first else ("alone", v) for v in nodes})


def celf(directed: bool, seeds: int = 10, chance: float = 0.1, samples: int = 100):
    """Greedy seeds of greatest spread over sampled live edges, with lazy gains; score is the marginal spread of a seed when chosen, 0 for the rest."""

    def fn(nodes, edges):
        rng = np.random.default_rng(0)
        pairs = [(a, b) for _, a, b, _ in edges] + ([] if directed else [(b, a) for _, a, b, _ in edges])
        worlds = []
        for _ in range(samples):
            live = defaultdict(list)
            for (a, b), keep in zip(pairs, rng.random(len(pairs)) < chance):
                if keep:
                    live[a].append(b)
            worlds.append(live)
        reached = [set() for _ in worlds]
        spread = lambda v: sum(len(set(_hops(live, v)) - got) for live, got in zip(worlds, reached)) / samples
        queue, score, k = [(-spread(v), v, 0) for v in nodes], dict.fromkeys(nodes, 0.0), 0
        queue.sort()
        while queue and k < seeds:
            gain, v, at = queue.pop(0)
            if at == k:
                score[v], k = -gain, k + 1
                for live, got in zip(worlds, reached):
                    got |= set(_hops(live, v))
            else:
                queue.append((-spread(v), v, k))
                queue.sort()
        return sorted(score.items())

    return fn
