"""Exact sequential algorithms. Each runs as one grouped-map task over a projection whose size is checked first, or as tasks of whole components."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.algo.native import roots
from sparkloom.plans.lineage import cut

MAX_NODES, MAX_EDGES = 1_000_000, 5_000_000


def _rows(n: DataFrame, e: DataFrame, weight: str | None) -> DataFrame:
    """kind (0: node, 1: edge), eid, src, dst, w: both frames in one."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return e.select(F.lit(1).alias("kind"), "eid", "src", "dst", w.alias("w")).unionByName(n.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("eid"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("w")))


def _applied(fn, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(frame.src[frame.kind == 0].tolist())
        edges = sorted(frame[frame.kind == 1][["eid", "src", "dst", "w"]].itertuples(index=False, name=None))
        return pd.DataFrame(fn(nodes, edges), columns=names)

    return apply


def run(n: DataFrame, e: DataFrame, fn, schema: str, weight: str | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """fn(sorted ids, sorted [(eid, src, dst, w)]) -> rows. More than the bound is an error: nothing is left out."""
    if n.limit(MAX_NODES + 1).count() > MAX_NODES or e.limit(max_edges + 1).count() > max_edges:
        raise ValueError("the projection is larger than a sequential algorithm takes")
    return _rows(n, e, weight).groupBy(F.lit(0).alias("_g")).applyInPandas(_applied(fn, schema), schema)


def by_component(n: DataFrame, e: DataFrame, fn, schema: str, weight: str | None = None, together: int = 100_000) -> DataFrame:
    """As ``run``, for an ``fn`` whose rows of a graph are its components' rows. A task holds whole components, small ones up to some ``together`` nodes and
    edges, and the bound is on a component, whatever the size of the graph."""
    e = cut(e)
    rows = _rows(n, e, weight).join(roots(n, e).select(F.col("id").alias("src"), F.col("l").alias("_l")), "src")
    rows = cut(rows)
    sizes = cut(rows.groupBy("_l").agg(F.count_if(F.col("kind") == 0).alias("v"), F.count_if(F.col("kind") == 1).alias("m")))
    if sizes.where((F.col("v") > MAX_NODES) | (F.col("m") > MAX_EDGES)).limit(1).count():
        raise ValueError("a component is larger than a sequential algorithm takes")
    large = F.broadcast(sizes.where(F.col("v") + F.col("m") >= together).select("_l", F.lit(True).alias("_alone")))  # a row for ``together`` rows at most
    parts = 1 + rows.count() // together
    rows = rows.join(large, "_l", "left").withColumn("_g", F.when(F.col("_alone"), F.col("_l")).otherwise(F.pmod(F.xxhash64("_l"), F.lit(parts))))
    return rows.groupBy("_alone", "_g").applyInPandas(_applied(fn, schema), schema)


def adjacency(nodes, edges, directed, distinct=False) -> dict:
    out = {v: [] for v in nodes}
    for _, a, b, w in edges:
        out[a].append(b)
        if not directed and a != b:
            out[b].append(a)
    return {v: sorted(set(x) - {v}) if distinct else sorted(x) for v, x in out.items()}


def simple(nodes, edges) -> dict:
    return {v: set(x) for v, x in adjacency(nodes, edges, False, True).items()}


def _hops(adj, s):
    d, q = {s: 0}, deque([s])
    while q:
        v = q.popleft()
        for u in adj[v]:
            if u not in d:
                d[u] = d[v] + 1
                q.append(u)
    return d


def closeness(directed, harmonic):
    def fn(nodes, edges):
        adj, n = adjacency(nodes, edges, directed, True), len(nodes)
        for s in nodes:
            d = _hops(adj, s)
            r, total = len(d) - 1, sum(d.values())
            yield s, (sum(1 / x for x in d.values() if x) / (n - 1) if n > 1 else 0.0) if harmonic else (r * r / ((n - 1) * total) if total else 0.0)

    return lambda nodes, edges: list(fn(nodes, edges))


def betweenness(directed):
    def fn(nodes, edges):
        adj, n, score = adjacency(nodes, edges, directed), len(nodes), dict.fromkeys(nodes, 0.0)
        for s in nodes:
            order, before, paths, d, q = [], defaultdict(list), defaultdict(float), {s: 0}, deque([s])
            paths[s] = 1.0
            while q:
                v = q.popleft()
                order.append(v)
                for u in adj[v]:
                    if u not in d:
                        d[u] = d[v] + 1
                        q.append(u)
                    if d[u] == d[v] + 1:
                        paths[u] += paths[v]
                        before[u].append(v)
            share = defaultdict(float)
            for u in reversed(order):
                for v in before[u]:
                    share[v] += paths[v] / paths[u] * (1 + share[u])
                if u != s:
                    score[u] += share[u]
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return [(v, x * scale) for v, x in score.items()]

    return fn


def _number(label: dict) -> list:
    ids: dict = {}
    return [(v, ids.setdefault(label[v], len(ids))) for v in sorted(label)]


def label_propagation(nodes, edges):
    adj, label = simple(nodes, edges), {v: v for v in nodes}
    for _ in range(100):
        moved = False
        for v in nodes:
            if adj[v]:
                c = defaultdict(int)
                for u in adj[v]:
                    c[label[u]] += 1
                top = max(c.values())
                new = label[v] if c.get(label[v]) == top else min(x for x, k in c.items() if k == top)
                moved |= new != label[v]
                label[v] = new
        if not moved:
            break
    return _number(label)


def louvain(one_level=False):
    def fn(nodes, edges):
        w = {v: defaultdict(float) for v in nodes}
        for v, near in simple(nodes, edges).items():
            for u in near:
                w[v][u] = 1.0
        loop, member = dict.fromkeys(nodes, 0.0), {v: v for v in nodes}
        total = sum(sum(x.values()) for x in w.values())
        while total:
            k = {v: sum(w[v].values()) + loop[v] for v in w}
            com, tot, any_move = {v: v for v in w}, dict(k), False
            while True:
                moved = False
                for v in sorted(w):
                    own = com[v]
                    links = defaultdict(float)
                    for u, x in w[v].items():
                        links[com[u]] += x
                    tot[own] -= k[v]
                    best, gain = own, links[own] - tot[own] * k[v] / total
                    for c in sorted(links):
                        g = links[c] - tot[c] * k[v] / total
                        if g > gain + 1e-12:
                            best, gain = c, g
                    tot[best] += k[v]
                    com[v] = best
                    moved |= best != own
                any_move |= moved
                if not moved:
                    break
            member = {v: com[c] for v, c in member.items()}
            if not any_move or one_level:
                break
            nw, nl = defaultdict(lambda: defaultdict(float)), defaultdict(float)
            for v in w:
                nl[com[v]] += loop[v]
                for u, x in w[v].items():
                    if com[u] == com[v]:
                        nl[com[v]] += x
                    else:
                        nw[com[v]][com[u]] += x
            w, loop = {c: nw[c] for c in set(com.values())}, nl
        return _number(member)

    return fn


def spanning_tree(largest):
    def fn(nodes, edges):
        up = {v: v for v in nodes}

        def root(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        out = []
        for w, a, b, i in sorted((-w if largest else w, min(a, b), max(a, b), i) for i, a, b, w in edges):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((i, a, b, -w if largest else w))
        return out

    return fn


def topological_sort(nodes, edges):
    adj, need = adjacency(nodes, edges, True), dict.fromkeys(nodes, 0)
    for _, _, b, _ in edges:
        need[b] += 1
    ready, out = [v for v in nodes if not need[v]], []
    heapq.heapify(ready)
    while ready:
        v = heapq.heappop(ready)
        out.append((v, len(out)))
        for u in adj[v]:
            need[u] -= 1
            if not need[u]:
                heapq.heappush(ready, u)
    if len(out) < len(nodes):
        raise ValueError("the graph has a cycle")
    return out


def coloring(by_degree):
    def fn(nodes, edges):
        adj, color = simple(nodes, edges), {}
        for v in sorted(nodes, key=lambda v: (-len(adj[v]), v)) if by_degree else nodes:
            used = {color[u] for u in adj[v] if u in color}
            color[v] = next(c for c in range(len(nodes) + 1) if c not in used)
        return [(v, color[v]) for v in nodes]

    return fn


def edge_coloring(nodes, edges):
    used, out = defaultdict(set), []
    for i, a, b, _ in edges:
        c = next(c for c in range(len(edges) + 1) if c not in used[a] and c not in used[b])
        used[a].add(c)
        used[b].add(c)
        out.append((i, c))
    return out


def _low_link(nodes, edges):
    adj = defaultdict(list)
    for i, a, b, _ in edges:
        if a != b:
            adj[a].append((b, i))
            adj[b].append((a, i))
    num, low, cuts, bridges = {}, {}, set(), []
    for s in nodes:
        if s in num:
            continue
        num[s] = low[s] = len(num)
        stack, kids = [(s, None, iter(adj[s]))], 0
        while stack:
            v, came, it = stack[-1]
            for u, i in it:
                if i == came:
                    continue
                if u in num:
                    low[v] = min(low[v], num[u])
                else:
                    num[u] = low[u] = len(num)
                    kids += v == s
                    stack.append((u, i, iter(adj[u])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] >= num[p] and p != s:
                        cuts.add(p)
                    if low[v] > num[p]:
                        bridges.append(came)
        if kids > 1:
            cuts.add(s)
    return cuts, bridges


def articulation_points(nodes, edges):
    return [(v,) for v in sorted(_low_link(nodes, edges)[0])]


def bridges(nodes, edges):
    found = set(_low_link(nodes, edges)[1])
    return [(i, a, b) for i, a, b, _ in edges if i in found]


def dfs(source):
    def fn(nodes, edges):
        adj, out, seen, stack = adjacency(nodes, edges, True), [], set(), [(source, 0)]
        while stack:
            v, d = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            out.append((v, d, len(out)))
            stack += [(u, d + 1) for u in reversed(adj[v]) if u not in seen]
        return out

    return fn


def longest_path(nodes, edges):
    order = [v for v, _ in topological_sort(nodes, edges)]
    back = defaultdict(list)
    for _, a, b, w in edges:
        back[b].append(a)
    best = {}
    for v in order:
        options = [(-len(best[u]), best[u]) for u in back[v]]
        best[v] = [*(min(options)[1] if options else []), v]
    path = min(best.values(), key=lambda p: (-len(p), p)) if best else []
    return [(float(max(0, len(path) - 1)), ",".join(map(str, path)))]


def max_flow(source, target, view="value"):
    """Edmonds-Karp over edges with capacities w: the value, or the source side of the smallest cut."""

    def fn(nodes, edges):
        cap = {v: defaultdict(float) for v in nodes}
        for _, a, b, w in edges:
            cap[a][b] += w
            cap[b][a] += 0.0
        flow = 0.0
        while True:
            up, q = {source: None}, deque([source])
            while q and target not in up:
                v = q.popleft()
                for u in sorted(cap[v]):
                    if u not in up and cap[v][u] > 1e-12:
                        up[u] = v
                        q.append(u)
            if target not in up:
                return [(flow,)] if view == "value" else [(v, v in up) for v in nodes]
            path, v = [], target
            while up[v] is not None:
                path.append((up[v], v))
                v = up[v]
            push = min(cap[a][b] for a, b in path)
            for a, b in path:
                cap[a][b] -= push
                cap[b][a] += push
            flow += push

    return fn


def bipartite_matching(nodes, edges):
    """Augmenting paths from the lowest left node; sides by two-colouring from the lowest node of each component."""
    adj, side = simple(nodes, edges), {}
    for s in nodes:
        if s not in side:
            side[s], q = 0, deque([s])
            while q:
                v = q.popleft()
                for u in adj[v]:
                    if u not in side:
                        side[u] = 1 - side[v]
                        q.append(u)
                    elif side[u] == side[v]:
                        raise ValueError("the graph is not bipartite")
    mate: dict = {}  # of right nodes; match: of left nodes
    match: dict = {}
    for s in nodes:
        if side[s]:
            continue
        up, q, end = {}, deque([s]), None
        while q and end is None:
            v = q.popleft()
            for u in sorted(adj[v]):
                if u not in up:
                    up[u] = v
                    if u not in mate:
                        end = u
                        break
                    q.append(mate[u])
        while end is not None:
            v, before = up[end], match.get(up[end])
            mate[end], match[v] = v, end
            end = before
    return sorted(match.items())


TRIADS = "003 012 102 021D 021U 021C 111D 111U 030T 030C 201 120D 120U 120C 210 300".split()


def _triad_kind(m: tuple) -> str:
    """Of the six arcs ab, ba, ac, ca, bc, cb, by its mutual, asymmetric and null dyads and how the asymmetric arcs meet."""
    ab, ba, ac, ca, bc, cb = m
    dyads = [(ab, ba), (ac, ca), (bc, cb)]
    mutual, none = sum(x and y for x, y in dyads), sum(not x and not y for x, y in dyads)
    asym = 3 - mutual - none
    code = f"{mutual}{asym}{none}"
    out = [sum(x) for x in ((ab and not ba, ac and not ca), (ba and not ab, bc and not cb), (ca and not ac, cb and not bc))]
    into = [sum(x) for x in ((ba and not ab, ca and not ac), (ab and not ba, cb and not bc), (ac and not ca, bc and not cb))]
    if code == "021":
        return code + ("D" if 2 in out else "U" if 2 in into else "C")
    if code == "111":
        both = [ab and ba, ac and ca, bc and cb].index(True)
        loose = (2, 1, 0)[both]  # the node outside the mutual dyad
        return code + ("D" if into[loose] == 0 and out[loose] == 1 else "U")
    if code == "030":
        return code + ("C" if out == [1, 1, 1] else "T")
    if code == "120":
        loose = (2, 1, 0)[[ab and ba, ac and ca, bc and cb].index(True)]
        return code + ("D" if out[loose] == 2 else "U" if into[loose] == 2 else "C")
    return code


def triad_census(nodes, edges):
    arcs = {(a, b) for _, a, b, _ in edges if a != b}
    adj, n, count = simple(nodes, edges), len(nodes), dict.fromkeys(TRIADS, 0)
    seen = set()
    for a in nodes:
        for b in adj[a]:
            if a < b:
                near = (adj[a] | adj[b]) - {a, b}
                count["102" if (a, b) in arcs and (b, a) in arcs else "012"] += n - len(near) - 2
                for c in near:
                    t = tuple(sorted((a, b, c)))
                    if t not in seen:
                        seen.add(t)
                        x, y, z = t
                        count[_triad_kind(((x, y) in arcs, (y, x) in arcs, (x, z) in arcs, (z, x) in arcs, (y, z) in arcs, (z, y) in arcs))] += 1
    count["003"] = n * (n - 1) * (n - 2) // 6 - sum(count.values())
    return [(t, count[t]) for t in TRIADS]


def euler(form, directed):
    """Whether a circuit or path over every edge exists."""

    def fn(nodes, edges):
        out, into, adj = defaultdict(int), defaultdict(int), defaultdict(set)
        for _, a, b, _ in edges:
            out[a] += 1
            into[b] += 1
            adj[a].add(b)
            adj[b].add(a)
        if not edges:
            return [(True,)]
        active = sorted(adj)
        joined = len(_hops(adj, active[0])) == len(active)
        if directed:
            off = sorted(out[v] - into[v] for v in active if out[v] != into[v])
            return [(joined and (not off or form == "path" and off == [-1, 1]),)]
        odd = sum((out[v] + into[v]) % 2 for v in active)
        return [(joined and (odd == 0 or form == "path" and odd == 2),)]

    return fn


def chromatic_number(nodes, edges):
    adj = simple(nodes, edges)
    order = sorted(nodes, key=lambda v: (-len(adj[v]), v))

    def fits(k):
        color: dict = {}

        def place():
            free = [v for v in order if v not in color]
            if not free:
                return True
            v = max(free, key=lambda v: (len({color[u] for u in adj[v] if u in color}), len(adj[v]), -v))
            used = {color[u] for u in adj[v] if u in color}
            for c in range(min(k, max(color.values(), default=-1) + 2)):
                if c not in used:
                    color[v] = c
                    if place():
                        return True
                    del color[v]
            return False

        return place()

    return [(next(k for k in range(len(nodes) + 1) if fits(k)),)]


def find_cycles(nodes, edges):
    adj, out = {v: sorted(set(x)) for v, x in adjacency(nodes, edges, True).items()}, []
    for s in nodes:
        stack = [(s, (s,))]
        while stack:
            v, path = stack.pop()
            for u in adj[v]:
                if u == s:
                    out.append(path)
                elif u > s and u not in path:
                    stack.append((u, (*path, u)))
    return [(",".join(map(str, p)), len(p)) for p in sorted(out)]
