import pytest

from sparkloom.cypher import execute
from sparkloom.graph import PropertyGraph
from sparkloom.operators import lifecycle as L


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph({"P": spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, age int")}, {"K": spark.createDataFrame([(0, 1, 2)], "eid long, src long, dst long")})


def test_import(spark, graph):
    people = spark.createDataFrame([("x", "P", "new"), ("y", "Q", "other")], "key string, label string, name string")
    links = spark.createDataFrame([("x", "y", None, "L", 1.5), ("x", None, 1, "K", None)], "source_key string, target_key string, target_id long, rel_type string, w double")
    got, receipts = L.bulk_import(graph, people, links)
    assert receipts.count() == 4 and {r.entity_kind for r in receipts.collect()} == {"node", "relationship"}
    assert [tuple(r) for r in execute(got, "MATCH (a:P)-[r:L]->(b:Q) RETURN a.name AS a, b.name AS b, r.w AS w").collect()] == [("new", "other", 1.5)]
    assert execute(got, "MATCH (a:P {name: 'new'})-[:K]->(b:P) RETURN b.name AS b").first().b == "a" and got.nodes["P"].count() == 3
    bad = spark.createDataFrame([("x", "P"), ("x", "P"), ("z", None)], "key string, label string")
    with pytest.raises(L.ImportRejected) as error:
        L.bulk_import(graph, bad, spark.createDataFrame([("x", "nowhere", "L")], "source_key string, target_key string, rel_type string"))
    assert {r.reason for r in error.value.problems.collect()} == {"a node needs a label", "the key is there twice", "the target isn't there"}


def test_checkpoints(spark, graph, tmp_path):
    kept = L.Checkpoints(spark, f"file://{tmp_path}/kept")
    kept.save(graph, "one")
    changed = graph.with_nodes("P", graph.nodes["P"].where("id = 2").withColumn("age", graph.nodes["P"].age + 1))
    kept.save(changed, "two")
    assert kept.names() == ["one", "two"] and kept.load("one").nodes["P"].count() == 2
    assert sorted(tuple(r) for r in kept.diff("one", "two").collect()) == [("node", "P", 1, "removed"), ("node", "P", 2, "changed")]
    with pytest.raises(ValueError):
        kept.save(graph, "one")
    kept.delete("one")
    assert kept.names() == ["two"]


def test_catalog(spark, graph):
    found = {(r.name, r.property): (r.entities, r.present) for r in L.inventory(graph).collect()}
    assert found == {("P", "name"): (2, 2), ("P", "age"): (2, 1), ("K", None): (1, 1)}
    assert "Parsed" not in L.explain(graph, "MATCH (a:P) RETURN a.name AS n") and "Scan" in L.explain(graph, "MATCH (a:P) RETURN a.name AS n")
    assert L.lookup(graph, "P", name="b").first().id == 2 and L.lookup(graph, "P", nope=1).count() == 0
    assert L.functions(spark).where("name = 'duration.between'").count() == 1 and L.algorithms(spark).where("verb = 'paths'").count() > 15
    assert L.to_arrow(graph.nodes["P"]).num_rows == 2 and [len(p) for p in L.pages(graph.nodes["P"], 1)] == [1, 1]
