"""Algorithms against brute force on small random graphs, and answers known in closed form."""

import random
from itertools import combinations, permutations

import numpy as np
import pytest

from sparkloom import algo
from sparkloom.algo import communities as C
from sparkloom.algo import structure as S
from sparkloom.algo import vectors as V
from sparkloom.graph import PropertyGraph


def made(n, p, seed, directed=False):
    rnd = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(n) if (a != b if directed else a < b) and rnd.random() < p]
    return list(range(n)), [(i, a, b, float(rnd.randint(1, 9))) for i, (a, b) in enumerate(pairs)]


def graph(spark, nodes, edges, **more):
    rows = [(v, *(more[k][v] for k in more)) for v in nodes]
    kinds = "".join(f", {k} array<double>" for k in more)
    return PropertyGraph({"P": spark.createDataFrame(rows, "id long" + kinds)}, {"K": spark.createDataFrame([(i, a, b, w, 1.0 + i % 3) for i, a, b, w in edges], "eid long, src long, dst long, w double, c double")})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TWO = (list(range(8)), [(i, a, b, 1.0) for i, (a, b) in enumerate([*combinations(range(4), 2), *combinations(range(4, 8), 2), (3, 4)])])


@pytest.mark.parametrize("f", [C.leiden, C.speaker_listener, C.girvan_newman, C.fastgreedy, C.infomap(False), C.leading_eigenvector, C.walktrap, C.spinglass])
def test_communities(f):
    got = dict(f(*TWO))
    assert [got[v] for v in range(8)] == [0] * 4 + [1] * 4 and f([], []) == []


def test_cuts_blocks_and_seeds():
    assert dict(C.max_k_cut(list(range(4)), [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 0, 1.0)])) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert dict(C.biconnected(list(range(6)), [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 0, 1.0), (3, 2, 3, 1.0), (4, 3, 4, 1.0)])) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}
    score = dict(C.celf(True, seeds=1, chance=1.0)(list(range(4)), [(0, 0, 1, 1.0), (1, 1, 2, 1.0)]))
    assert score == {0: 3.0, 1: 0.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("seed", range(12))
def test_against_brute_force(seed):
    nodes, edges = made(7, 0.45, seed)
    sets = [c for k in range(4) for c in combinations(edges, k) if len({v for e in c for v in e[1:3]}) == 2 * k]
    assert len(S.max_cardinality_matching(nodes, edges)) == max(map(len, sets))
    assert sum(e[3] for e in S.max_weight_matching(nodes, edges)) == max(sum(e[3] for e in c) for c in sets)
    links = {(a, b) for _, a, b, _ in edges}
    same = sum(all(((min(p[a], p[b]), max(p[a], p[b])) in links) == ((a, b) in links) for a, b in combinations(nodes, 2)) for p in permutations(nodes))
    assert S.automorphisms(False)(nodes, edges) == [(same,)]
    nodes, edges = made(6, 0.5, seed, True)
    out = {}
    for _, a, b, w in edges:
        out[a, b] = w
    simple_paths = sorted((sum(out[x, y] for x, y in zip(p, p[1:])), p) for k in range(2, 7) for p in permutations(nodes, k) if p[0] == 0 and p[-1] == 5 and all((x, y) in out for x, y in zip(p, p[1:])))
    assert [(c, tuple(map(int, p.split(",")))) for _, c, p in S.yens(0, 5, 4, True)(nodes, edges)] == simple_paths[:4]
    cuts = min(sum(w for _, a, b, w in edges if a in side and b not in side) for k in range(5) for side in ({0, *c} for c in combinations(range(1, 5), k)))
    flow = S.flow_edges(0, 5, False)(nodes, edges)
    assert sum(f * ((a == 0) - (b == 0)) for _, a, b, f in flow) == cuts == sum(e[3] for e in S.flow_edges(0, 5, True)(nodes, edges))
    assert S.min_cost_flow(0, 5, {e[0]: 1.0 for e in edges})(nodes, edges)[0][0] == cuts


@pytest.mark.parametrize("seed", range(6))
def test_trees(seed):
    nodes, edges = made(6, 0.6, seed)
    trees = sorted(sum(e[3] for e in c) for c in combinations(edges, 5) if S._tree(nodes, c) is not None)
    assert [w for _, w, _ in S.k_spanning_trees(5)(nodes, edges)] == trees[:5]
    if trees:
        keep = [sum(e[3] for e in t) for k in range(3, 7) for c in combinations(nodes, k) if {0, 2, 5} <= set(c) and (t := S._tree(c, [e for e in edges if e[1] in c and e[2] in c])) is not None]
        assert sum(e[3] for e in S.steiner([0, 2, 5])(nodes, edges)) == min(keep)
        tree = S.gomory_hu(nodes, edges)
        assert min(c for _, _, c in tree) == min(sum(w for _, a, b, w in edges if (a in side) != (b in side)) for k in range(1, 6) for side in map(set, combinations(nodes, k)))
    assert sum(e[3] for e in S.prize_steiner({v: 100.0 for v in nodes})(nodes, edges)) <= sum(e[3] for e in edges)


def test_planar_and_euler():
    k = lambda n: (list(range(n)), [(i, a, b, 1.0) for i, (a, b) in enumerate(combinations(range(n), 2))])
    assert S.is_planar(*k(4)) == [(True,)] and S.is_planar(*k(5)) == [(False,)]
    k33 = [(i, a, b, 1.0) for i, (a, b) in enumerate((a, b) for a in range(3) for b in range(3, 6))]
    assert S.is_planar(list(range(6)), k33) == [(False,)] and S.is_planar(list(range(6)), k33[:-1]) == [(True,)]
    grid = [(i, a, b, 1.0) for i, (a, b) in enumerate([(5 * r + c, 5 * r + c + 1) for r in range(5) for c in range(4)] + [(5 * r + c, 5 * r + c + 5) for r in range(4) for c in range(5)])]
    assert S.is_planar(list(range(25)), grid) == [(True,)]
    assert S.euler_trail("circuit", True)([0, 1, 2], [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 0, 1.0)]) == [("0,1,2,0", "0,1,2")]
    assert S.euler_trail("path", False)([0, 1, 2], [(0, 0, 1, 1.0), (1, 1, 2, 1.0)]) == [("0,1,2", "0,1")]
    with pytest.raises(ValueError):
        S.euler_trail("circuit", False)([0, 1, 2], [(0, 0, 1, 1.0), (1, 1, 2, 1.0)])
    assert S.longest_weighted([0, 1, 2], [(0, 0, 1, 2.0), (1, 1, 2, 3.0), (2, 0, 2, 4.0)]) == [(5.0, "0,1,2")]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    x[:15] += 9
    nodes, edges = list(range(30)), made(30, 0.1, 3, True)[1]
    g = graph(spark, nodes, edges, v=[[float(a) for a in r] for r in x])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = sorted((i, j) for i in nodes for j in sorted((j for j in nodes if j != i and s[i, j] >= 0), key=lambda j: (-s[i, j], j))[:3])
    assert sorted((r.id1, r.id2) for r in V.cosine_pairs(g.nodes["P"], "v", 3, 0.0, block=8).collect()) == want
    assert algo.similar(g, "cosine", vector="v").count() == 30 * 29
    near = {(a, b) for _, a, b, _ in edges}
    assert {(r.id1, r.id2) for r in algo.similar(g, "filtered_knn", vector="v", k=50).collect()} == {(a, b) for a, b in near if s[a, b] >= 0}
    for by in ("k_means", "hdbscan"):
        got = dict(rows(algo.cluster(g, by, vector="v", **({"k": 2} if by == "k_means" else {}))))
        assert len({got[i] for i in range(15)}) == 1 and (by == "hdbscan" or got[0] != got[29])
    g = PropertyGraph({"P": g.nodes["P"].selectExpr("*", "v[0] AS x")}, g.edges)
    assert algo.analyze(g, "graphsage", features=["x"], dim=4).count() == 30
    for by, more in (("fast_random_projection", {"dim": 8}), ("hashgnn", {"dim": 8}), ("node2vec", {"dim": 4, "length": 4, "count": 2})):
        got = algo.analyze(g, by, directed=False, **more).collect()
        assert len(got) == 30 and all(len(r.embedding) == more["dim"] for r in got)


def test_shortest_and_write_back(spark):
    nodes, edges = made(8, 0.3, 5, True)
    g = graph(spark, nodes, edges)
    d = np.full((8, 8), np.inf)
    for _, a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k in nodes:
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    got = {(r.source, r.target): r.cost for r in algo.paths(g, "floyd_warshall", weight="w").collect()}
    assert got == {(a, b): d[a, b] for a in nodes for b in nodes if a != b and d[a, b] < np.inf}
    assert rows(algo.paths(g, "astar", *max(got), weight="w").select("cost")) == [(got[max(got)],)]
    ranked = algo.write_property(g, algo.rank(g, "degree"), "score")
    assert ranked.nodes["P"].columns == ["id", "score"] and ranked.nodes["P"].where("score IS NULL").count() == 0
    part = algo.cluster(g, "components")
    assert algo.analyze(g, "modularity", partition=part).count() == 1 and algo.analyze(g, "conductance", partition=part).count() >= 1
