"""Queries at sizes that one task doesn't take: results are those of the plain algorithms."""

import random

import numpy as np
import pytest
from test_algorithms import graph, made, rows

from sparkloom import algo
from sparkloom.algo import kernels as K
from sparkloom.algo import packed
from sparkloom.algo import structure as S
from sparkloom.algo import vectors
from sparkloom.cypher import execute
from sparkloom.cypher.lower import Lowering
from sparkloom.cypher.parser import Parser
from sparkloom.graph import PropertyGraph
from sparkloom.sources.tables import table_graph

WHOLE = {
    "articulation_points": K.articulation_points,
    "bridges": K.bridges,
    "dag_longest_path": K.longest_path,
    "dag_longest_path_weighted": S.longest_weighted,
    "edge_coloring": K.edge_coloring,
    "has_euler_path": K.euler("path", True),
    "has_euler_circuit": K.euler("circuit", True),
    "is_planar": S.is_planar,
    "k1_coloring": K.coloring(True),
    "maximum_spanning_tree": K.spanning_tree(True),
}


@pytest.mark.parametrize("by", WHOLE)
def test_larger_than_a_task(spark, monkeypatch, by):
    """Three copies of a graph, of more nodes and edges than the bound, which holds for a component."""
    nodes, edges = made(16, 0.12, 4)
    more = [16 * k + v for k in range(3) for v in nodes], [(100 * k + i, 16 * k + a, 16 * k + b, w) for k in range(3) for i, a, b, w in edges]
    want = sorted(WHOLE[by](*more))
    monkeypatch.setattr(K, "MAX_NODES", 40), monkeypatch.setattr(K, "MAX_EDGES", 40)
    assert rows(algo.analyze(graph(spark, *more), by, weight=None if by == "dag_longest_path" else "w", directed=True)) == want


@pytest.fixture(scope="module")
def dense(spark):
    """A graph with loops, parallel and two-way edges and a hub, and its undirected matrix."""
    nodes, edges = made(50, 0.08, 9, True)
    edges += [(1000 + v, v, 25, 1.0) for v in range(0, 50, 2)] + [(2000, 3, 3, 1.0), (2001, *edges[0][1:])]
    a = np.zeros((50, 50), int)
    for _, s, d, _ in edges:
        a[s, d] = a[d, s] = s != d
    return graph(spark, nodes, edges), edges, a


@pytest.fixture
def many_ranges(monkeypatch):
    for name, size in (("ROW", 100), ("CHUNK", 40), ("ROWS", 2), ("WEDGES", 30)):
        monkeypatch.setattr(packed, name, size)


def test_triangle_count_by_ranges(dense, many_ranges):
    g, _, a = dense
    assert packed.lists(g.edges["K"]).rows.count() > 3
    assert algo.analyze(g, "triangle_count").collect()[0][0] == np.trace(a @ a @ a) // 6


def test_codec():
    rng = np.random.default_rng(2)
    for x in (np.empty(0, np.int64), np.array([-5]), rng.integers(-(2**63), 2**63 - 1, 1000), np.sort(rng.integers(0, 10**6, 1000))):
        assert (packed.dec(packed.enc(x)) == x).all()
    far = np.array([2**62, -(2**62), 2**62, 5]), np.array([1, 2**62, 1, -7])
    assert list(zip(*(x.tolist() for x in packed.ordered(*far, True)))) == sorted(set(zip(*(x.tolist() for x in far))))


def peeled(a):
    core, left, k = np.zeros(len(a), int), set(range(len(a))), 0
    while left:
        low = [v for v in left if sum(a[v, u] for u in left) <= k]
        for v in low:
            core[v] = k
        left -= set(low)
        k += not low
    return core


def led(edges, size, hub):
    m = np.zeros((size, size))
    for _, s, d, _ in edges:
        m[s, d] += 1
    h = np.ones(size)
    for _ in range(20):
        x = m.T @ h
        x /= np.linalg.norm(x)
        h = m @ x
        h /= np.linalg.norm(h)
    return h if hub else x


def test_k_core_by_ranges(dense, many_ranges):
    g, _, a = dense
    assert rows(algo.rank(g, "k_core")) == list(enumerate(peeled(a).astype(float)))


@pytest.mark.parametrize("hub", [True, False])
def test_hits_by_ranges(dense, many_ranges, hub):
    g, edges, _ = dense
    got = rows(algo.rank(g, "hits_hub" if hub else "hits_authority"))
    assert np.allclose([s for _, s in got], led(edges, 50, hub), atol=1e-9)


def common(a, x):
    k = a.sum(0)
    w = (a * np.array([x(v) for v in k])) @ a
    return (w * (a == 0) * (1 - np.eye(len(a)))).sum(1)


def united(a):
    k = a.sum(0)
    return ((k[:, None] + k[None] - a @ a) * (a == 0) * (1 - np.eye(len(a)))).sum(1)


def clustered(a):
    k, t = a.sum(0), np.diag(a @ a @ a)
    return np.where(k > 1, t / np.maximum(1, k * (k - 1)), 0.0)


NEAR = {
    "adamic_adar": lambda a: common(a, lambda k: 1 / np.log(k) if k > 1 else 0.0),
    "clustering_coefficient": clustered,
    "common_neighbors": lambda a: common(a, lambda k: 1.0),
    "resource_allocation": lambda a: common(a, lambda k: 1 / k if k else 0.0),
    "total_neighbors": united,
    "triangles": lambda a: np.diag(a @ a @ a) / 2,
}


@pytest.mark.parametrize("by", NEAR)
def test_neighbours_by_ranges(dense, many_ranges, by):
    g, _, a = dense
    assert np.allclose([s for _, s in rows(algo.rank(g, by, directed=False))], NEAR[by](a))


def test_filtered_node_similarity_by_ranges(dense, many_ranges):
    g, edges, _ = dense
    to = {v: {d for _, s, d, _ in edges if s == v} for v in range(50)}
    want = []
    for v in to:
        found = sorted((-len(to[v] & to[u]) / len(to[v] | to[u]), u) for u in to[v] - {v} if to[v] & to[u])
        want += [(v, u, -s) for s, u in found[:3]]
    assert rows(algo.similar(g, "filtered_node_similarity", k=3)) == sorted(want)


def test_projection_vectors_are_rows(spark, monkeypatch):
    """No table has a row for a place of a vector."""
    nodes, edges = made(40, 0.1, 3, True)
    written, table = [], vectors.scratch.table
    monkeypatch.setattr(vectors.scratch, "table", lambda df, name: written.append(out := table(df, name)) or out)
    monkeypatch.setattr(vectors.scratch, "drop", lambda *tables: None)
    got = algo.analyze(graph(spark, nodes, edges), "fast_random_projection", directed=False, dim=32).collect()
    assert len(got) == 40 and any(any(r.embedding) for r in got)
    assert written and max(df.count() for df in written) <= 2 * len(edges)


@pytest.mark.parametrize("query", ["(a:Part)-[:CO_BUY]->(b)-[:CO_BUY]->(c), (a)-[:CO_BUY]->(c)", "(a)<-[:CO_BUY]-(b:Part), (b)<-[:CO_BUY]-(c:Part)-[:CO_BUY]->(a)", "(a:Part)-[:CO_BUY]->(b)-[:CO_BUY]->(c), (c)-[:CO_BUY]->(a)", "(a:Part)-[:CO_BUY]->(b)-[:CO_BULK]->(c), (a)-[:CO_BUY]->(c)"])
def test_closed_patterns(spark, tmp_path, query):
    """Lines of parts that the table lacks, without keys and twice: the joins' count, and no joins where all ends are parts of one type."""
    rnd = random.Random(5)
    lines = [(rnd.choice([None, *range(30)]), rnd.choice([None, *range(15)]), float(rnd.choice([1, 45]))) for _ in range(150)]
    spark.createDataFrame(lines + lines[:20], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "p", "b", "t", 1, 1.0) for k in range(12)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    g = table_graph(spark, str(tmp_path))
    query = f"MATCH {query} RETURN count(*) AS n"
    joined = PropertyGraph({"Part": g.nodes["Part"]}, {k: g.edges[k] for k in ("CO_BUY", "CO_BULK")}, g.ends)
    assert execute(g, query).collect() == execute(joined, query).collect()
    assert (Lowering(g, {}, {}, 9).triangles(Parser(query).query()[0][0]) is None) == ("CO_BULK" in query or "(c)-" in query)
