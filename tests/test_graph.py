"""Micro graphs with answers known in closed form."""

import math

import pytest

from sparkloom import algo
from sparkloom.algo import kernels as K
from sparkloom.cypher import execute
from sparkloom.cypher.parser import CypherError, Parser
from sparkloom.graph import PropertyGraph
from sparkloom.operators import writes


def graph(spark, n, edges):
    return PropertyGraph(
        {"P": spark.createDataFrame([(i, f"n{i}", 10 * i) for i in range(n)], "id long, name string, age int")},
        {"K": spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "eid long, src long, dst long")},
    )


@pytest.fixture(scope="module")
def chain(spark):
    return graph(spark, 3, [(0, 1), (1, 2)])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_patterns(chain):
    assert rows(execute(chain, "MATCH (a:P)-[:K]->(b:P) RETURN a.name AS a, b.name AS b")) == [("n0", "n1"), ("n1", "n2")]
    assert rows(execute(chain, "MATCH (a:P)-[:K*]->(b) RETURN a.name AS a, count(*) AS n")) == [("n0", 2), ("n1", 1)]
    assert rows(execute(chain, "MATCH (a:P) WHERE NOT (a)-[:K]->() RETURN a.name AS a")) == [("n2",)]
    found = execute(chain, "MATCH (a:P) OPTIONAL MATCH (a)-[:K]->(b:P) WHERE b.age > 10 RETURN a.name AS a, b.name AS b ORDER BY a").collect()
    assert [tuple(r) for r in found] == [("n0", None), ("n1", "n2"), ("n2", None)]
    assert execute(chain, "MATCH (a)-[:K]-(b)-[:K]-(c) RETURN count(*) AS n").first().n == 2


def test_undirected_loop_counts_once(spark):
    assert execute(graph(spark, 1, [(0, 0)]), "MATCH (a)-[:K]-(b) RETURN count(*) AS n").first().n == 1


def test_values(chain):
    got = execute(chain, "RETURN 5 / 2 AS a, -7 % 3 AS b, [1,2,3][-1] AS c, [1,2,3][0..2] AS d, 'a' + 'b' AS e, toFloat('NaN') AS f, size(range(5, 1)) AS g, $p AS h", {"p": 4}).first()
    assert (got.a, got.b, got.c, list(got.d), got.e, got.f, got.g, got.h) == (2, -1, 3, [1, 2], "ab", None, 0, 4)
    assert execute(chain, "MATCH (n:P) RETURN sum(n.age) AS s, count(*) + 1 AS c").first() == (30, 4)


@pytest.mark.parametrize("text", ["", "MATCH (a", "RETURN 1 +", "MATCH (a) RETURN b", "MATCH (a) RETURN nope(a)", "RETURN $missing"])
def test_errors(chain, text):
    with pytest.raises(CypherError):
        execute(chain, text)


def test_parser_precedence():
    assert Parser("RETURN 1 + 2 * 3 = 7 AND NOT false AS x").query()[0][0][0].items[0].expr[0] == "and"


def test_ranks(chain):
    nodes, edges = [0, 1, 2], [(0, 0, 1, 1.0), (1, 1, 2, 1.0)]
    assert dict(K.betweenness(True)(nodes, edges))[1] == 0.5 and dict(K.betweenness(False)(nodes, edges))[1] == 1.0
    assert [round(x, 6) for _, x in K.closeness(True, False)(nodes, edges)] == [round(2 / 3, 6), 0.5, 0.0]
    assert [x for _, x in K.closeness(False, True)(nodes, edges)] == [0.75, 1.0, 0.75]
    got = {r.id: r.score for r in algo.rank(chain, "degree").collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.0}
    assert math.isclose(sum(r.score for r in algo.rank(chain, "pagerank").collect()), 1.0, abs_tol=1e-6)


def test_clusters_and_paths(spark):
    g = graph(spark, 5, [(0, 1), (1, 2), (2, 0), (3, 4)])
    assert rows(algo.cluster(g, "components")) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    assert rows(algo.cluster(g, "strongly_connected", directed=True)) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]
    assert rows(algo.paths(g, "bfs", 0)) == [(1, 1), (2, 2)]
    assert rows(algo.paths(g, "dijkstra", 0)) == [(0, 1, 1.0, "0,1"), (0, 2, 2.0, "0,1,2")]
    assert len(rows(algo.paths(g, "transitive_closure"))) == 10
    assert algo.analyze(g, "triangle_count").first()[0] == 1 and algo.analyze(g, "is_dag").first()[0] is False
    assert algo.analyze(g, "transitivity").first()[0] == 1.0


def test_kernels():
    nodes = list(range(4))
    square = [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 2, 3, 1.0), (3, 3, 0, 1.0)]
    assert K.chromatic_number(nodes, square) == [(2,)] and len(K.bipartite_matching(nodes, square)) == 2
    assert K.bridges(nodes, square[:3]) == [(0, 0, 1), (1, 1, 2), (2, 2, 3)] and K.articulation_points(nodes, square) == []
    assert K.find_cycles(nodes, square) == [("0,1,2,3", 4)] and K.euler("circuit", True)(nodes, square) == [(True,)]
    assert K.max_flow(0, 2)(nodes, square) == [(1.0,)] and len(K.spanning_tree(False)(nodes, square)) == 3
    census = dict(K.triad_census(nodes, square))
    assert sum(census.values()) == 4 and census["021C"] == 4


def test_writes(spark, chain):
    g = writes.create_nodes(chain, "P", spark.createDataFrame([(9, "new", 1)], "id long, name string, age int"))
    assert execute(g, "MATCH (n:P) RETURN count(*) AS n").first().n == 4
    gone = chain.nodes["P"].where("id = 1").select("id")
    with pytest.raises(ValueError):
        writes.delete_nodes(chain, "P", gone)
    assert execute(writes.delete_nodes(chain, "P", gone, detach=True), "MATCH ()-[r:K]->() RETURN count(r) AS n").first().n == 0
    assert [r.change for r in writes.difference(chain.nodes["P"], g.nodes["P"]).collect()] == ["added"]
