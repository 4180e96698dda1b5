"""Expressions, paths and writes on micro graphs."""

import datetime

import pytest

from sparkloom.cypher import execute, run
from sparkloom.cypher.parser import CypherError
from sparkloom.graph import PropertyGraph


@pytest.fixture(scope="module")
def chain(spark):
    return PropertyGraph(
        {"P": spark.createDataFrame([(i, f"n{i}", 10 * i) for i in range(3)], "id long, name string, age int")},
        {"K": spark.createDataFrame([(0, 0, 1, 5), (1, 1, 2, 6)], "eid long, src long, dst long, since int")},
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_expressions(chain):
    got = execute(chain, """RETURN [x IN [1, 2] | x / 2] AS a, [x IN ['a', 'bc'] | size(x)] AS b, [x IN ['a'] | x + 'b'] AS c, single(x IN [1, null] WHERE x = 1) AS d, 1 = 'a' AS e, 1 <> 'a' AS f,
        1 < 'a' AS g, 'abc' =~ ('a' + '.*') AS h, round(1.256, 2) AS i, 2 IN ['a', 2] AS j, [y IN [[1, 2], [3]] | [x IN y | x * 2]] AS k, reduce(s = 0, x IN [1, 2, 3] | s + x / 2) AS l, none(x IN [1] WHERE x > 1) AS m""").first()
    assert (got.a, got.b, got.c, got.d, got.e, got.f, got.g, got.h, got.i, got.j, got.k, got.l, got.m) == ([0, 1], [1, 2], ["ab"], None, False, True, None, True, 1.26, True, [[2, 4], [6]], 2, True)
    assert rows(execute(chain, "MATCH (n:P) RETURN n.age AS a ORDER BY a LIMIT 1 + 1")) == [(0,), (10,)] and execute(chain, "UNWIND null AS x RETURN x").count() == 0


def test_paths(chain):
    got = execute(chain, "MATCH p = (a:P {name: 'n0'})-[:K*1..2]->(b) RETURN size(nodes(p)) AS n, [x IN nodes(p) | x.name] AS names, length(p) AS l")
    assert rows(got) == [(2, ["n0", "n1"], 1), (3, ["n0", "n1", "n2"], 2)]
    assert rows(execute(chain, "MATCH p = (a:P {name: 'n2'})-[:K*2]-(b) RETURN [x IN nodes(p) | x.name] AS names")) == [(["n2", "n1", "n0"],)]
    assert rows(execute(chain, "MATCH ()-[r:K]->() RETURN startNode(r).name AS a, endNode(r).name AS b, r.since AS s")) == [("n0", "n1", 5), ("n1", "n2", 6)]
    assert rows(execute(chain, "MATCH (a:P) WITH a.age AS age, a MATCH (b:P) WHERE EXISTS { (b)-[:K]->(c) WHERE c.age > age } RETURN age, b.name AS b")) == [(0, "n0"), (0, "n1"), (10, "n1")]
    assert rows(execute(chain, "MATCH (a:P) RETURN a.name AS a, COUNT { (a)-[:K]-() } AS n, [(a)-[:K]->(b) | b.name] AS t")) == [("n0", 1, ["n1"]), ("n1", 2, ["n2"]), ("n2", 1, [])]


def test_temporals(chain):
    day = datetime.date
    got = execute(chain, """WITH date('2020-01-31') AS d, datetime('2020-02-29T10:00:00') AS t RETURN d + duration({months: 1}) AS a, date.truncate('quarter', t) AS b, duration.between(d, date('2020-02-29')).days AS c,
        duration('P1Y2M3DT4H5M6S').months AS e, (duration('PT90S') * 2).minutes AS f, date({year: 2020, week: 1}) AS g, date({year: 2020, ordinalDay: 60}) AS h, date.truncate('decade', d) AS i, duration.inSeconds(d, t).seconds AS j,
        localtime('10:20:30.5').nanosecond AS k, localtime('09:00') < localtime('10:00') AS l, date('2020-02-30') AS m, (t - duration({hours: 11})).day AS n, datetime.fromepoch(1, 5000).microsecond AS o, date({date: d, day: 2}) AS p""").first()
    assert (got.a, got.b, got.c, got.e, got.f, got.g, got.h, got.i) == (day(2020, 2, 29), day(2020, 1, 1), 29, 14, 3, day(2019, 12, 30), day(2020, 2, 29), day(2020, 1, 1))
    assert (got.j, got.k, got.l, got.m, got.n, got.o, got.p) == (29 * 86400 + 36000, 500_000_000, True, None, 28, 5, day(2020, 1, 2))
    assert execute(chain, "RETURN date() = date.transaction() AS a, localdatetime() IS NOT NULL AS b").first() == (True, True)


def test_create_and_set(chain):
    out = run(chain, "MATCH (a:P {name: 'n2'}) CREATE (a)-[r:K {since: 9}]->(b:P {name: 'new', age: 3})-[:L]->(:Q {x: 1.5}) RETURN b.name AS b, r.since AS s")
    assert rows(out.rows) == [("new", 9)] and out.counters == {"nodes_created": 2, "relationships_created": 2, "properties_set": 4, "labels_added": 2}
    assert rows(execute(out.graph, "MATCH (a)-[:K]->(b:P {age: 3})-[:L]->(c:Q) RETURN a.name AS a, c.x AS x")) == [("n2", 1.5)] and chain.nodes["P"].count() == 3
    out = run(out.graph, "MATCH (a:P) WHERE a.age > 5 SET a.age = a.age + 1, a:Old, a += {tag: 't'} RETURN a.age AS age, labels(a) AS l, a.tag AS t")
    assert rows(out.rows) == [(11, ["Old", "P"], "t"), (21, ["Old", "P"], "t")] and out.counters["labels_added"] == 2
    assert rows(execute(out.graph, "MATCH (a:P:Old)-[:K]->(b) RETURN a.name AS a, b.name AS b")) == [("n1", "n2"), ("n2", "new")]
    out = run(out.graph, "MATCH (a:Old) REMOVE a.tag, a:Old RETURN a.tag AS t")
    assert rows(out.rows) == [(None,), (None,)] and out.counters == {"properties_set": 2, "labels_removed": 2} and execute(out.graph, "MATCH (a:P) RETURN count(*) AS n").first().n == 4
    out = run(out.graph, "MATCH (a:P {name: 'new'}) SET a = {name: 'other'} RETURN a.age AS age, a.name AS n")
    assert rows(out.rows) == [(None, "other")]
    out = run(out.graph, "MATCH ()-[r:K]->() WHERE r.since > 5 SET r.since = $n", {"n": 1})
    assert rows(execute(out.graph, "MATCH ()-[r:K]->() RETURN r.since AS s")) == [(1,), (1,), (5,)]
    with pytest.raises(CypherError):
        run(chain, "MATCH (a:P) SET a.age = 'text'")


def test_merge(chain):
    out = run(chain, "UNWIND ['n1', 'x', 'x', 'y'] AS w MERGE (a:P {name: w}) ON CREATE SET a.age = 100 ON MATCH SET a.age = a.age + 1 RETURN w, a.age AS age")
    assert rows(out.rows) == [("n1", 11), ("x", 100), ("x", 100), ("y", 100)] and out.counters["nodes_created"] == 2
    out = run(out.graph, "MATCH (a:P {name: 'x'}), (b:P) WHERE b.name IN ['y', 'n0'] MERGE (a)-[r:K]->(b) ON CREATE SET r.since = 7 RETURN b.name AS b, r.since AS s")
    assert rows(out.rows) == [("n0", 7), ("y", 7)] and out.counters["relationships_created"] == 2
    again = run(out.graph, "MATCH (a:P {name: 'x'}), (b:P {name: 'y'}) MERGE (a)-[r:K]-(b) RETURN r.since AS s")
    assert rows(again.rows) == [(7,)] and not again.counters


def test_delete(chain):
    with pytest.raises(CypherError):
        run(chain, "MATCH (a:P {name: 'n1'}) DELETE a")
    out = run(chain, "MATCH (a:P {name: 'n1'}) DETACH DELETE a")
    assert out.counters == {"nodes_deleted": 1, "relationships_deleted": 2} and out.rows is None
    out = run(chain, "MATCH ()-[r:K {since: 5}]->() DELETE r")
    assert out.counters == {"relationships_deleted": 1} and execute(out.graph, "MATCH (a)-[:K]->(b) RETURN a.name AS a").first().a == "n1"
    with pytest.raises(CypherError):
        execute(chain, "CREATE (n)")


def test_percentile_disc(chain):
    """Ints are counted by Spark's own function, longs and fractions that the data give are picked from the sorted values; both agree."""
    each = "UNWIND range(1, 9) AS x WITH toFloat(x * x) AS f, x % 2 AS k, x"
    for p, even, odd in ((0, 4, 1), (0.25, 4, 9), (0.5, 16, 25), (0.75, 36, 49), (1, 64, 81)):
        got = rows(execute(chain, f"{each} RETURN k, percentileDisc(f, {p}) AS f, percentileDisc(x * x, {p}) + 1 AS l, count(*) AS n"))
        assert got == [(0, even, even + 1, 4), (1, odd, odd + 1, 5)]
    assert rows(execute(chain, "MATCH (a:P) RETURN percentileDisc(a.age, 0.5) AS a, percentileDisc(a.age, $p) AS b", {"p": 0.9})) == [(10, 20)]
    assert rows(execute(chain, "MATCH (a:P) WHERE a.age > 99 RETURN percentileDisc(a.age, 0.5) AS a")) == [(None,)]
