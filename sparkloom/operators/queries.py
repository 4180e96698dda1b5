"""The registered graph queries over the star-schema tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom import algo
from sparkloom.cypher import execute, run
from sparkloom.cypher.lower import Procedure
from sparkloom.graph import PropertyGraph, union
from sparkloom.operators import lifecycle, oracles, search, writes
from sparkloom.sources.tables import read, table_graph

FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.mktsegment AS seg, count(*) AS n ORDER BY n DESC, seg"
C, O, L, P = "customer", "orders", "lineitem", "part"
JOIN = "customer JOIN orders ON o_custkey = c_custkey"
#: name: (query, SQL)
CYPHER = {
    "flagship_segments": (FLAGSHIP, f"SELECT c_mktsegment AS seg, count(*) AS n FROM {JOIN} WHERE o_totalprice > 100000 GROUP BY 1"),
    "scan_node_label": ("MATCH (n:Part) RETURN n.key AS k, n.brand AS brand", "SELECT p_partkey AS k, p_brand AS brand FROM part"),
    "scan_edge_typed": ("MATCH ()-[r:CONTAINS]->() RETURN r.quantity AS q, count(*) AS n", "SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1"),
    "scan_edge_any": ("MATCH (a:Customer)-[r]->(b) RETURN type(r) AS t, count(*) AS n", "SELECT 'PLACED' AS t, count(*) AS n FROM orders UNION ALL SELECT 'IN_NATION', count(*) FROM customer"),
    "expand_out": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS c, o.key AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders"),
    "expand_in": ("MATCH (p:Part)<-[r:CONTAINS]-(o:Order) RETURN p.brand AS b, sum(r.quantity) AS q", "SELECT p_brand AS b, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "expand_two_hops": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS n, count(o) AS k", f"SELECT n_name AS n, count(*) AS k FROM {JOIN} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "expand_multitype": ("MATCH (o:Order)-[r:CONTAINS|FULFILLED_BY]->(x) RETURN type(r) AS t, count(*) AS n", "SELECT unnest(['CONTAINS', 'FULFILLED_BY']) AS t, count(*) AS n FROM lineitem GROUP BY 1"),
    "filter_property_map": ("MATCH (o:Order {status: 'F'}) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.key AS k, count(o) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "exists_semi": ("MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 } RETURN c.key AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "exists_anti": ("MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-(:Order) RETURN p.key AS k", "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "pattern_comprehension": ("MATCH (r:Region) RETURN r.name AS name, size([(n:Nation)-[:IN_REGION]->(r) | n.key]) AS k", "SELECT r_name AS name, count(n_nationkey) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "cross_product": ("MATCH (a:Region), (b:Nation) RETURN a.name AS a, count(b) AS n", "SELECT r_name AS a, count(*) AS n FROM region, nation GROUP BY 1"),
    "with_chain": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n >= 10 RETURN n, count(*) AS customers", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 10 GROUP BY 1"),
    "agg_all": ("MATCH (p:Part) RETURN p.brand AS b, count(*) AS n, count(DISTINCT p.size) AS d, sum(p.size) AS s, round(avg(p.size) * 1000) AS a, min(p.retailprice) AS lo, max(p.retailprice) AS hi", "SELECT p_brand AS b, count(*) AS n, count(DISTINCT p_size) AS d, sum(p_size)::BIGINT AS s, round(avg(p_size) * 1000) AS a, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1"),
    "agg_percentile": ("MATCH (p:Part) RETURN percentileDisc(p.size, 0.5) AS d, percentileCont(p.size, 0.25) AS c", "SELECT quantile_disc(p_size, 0.5) AS d, quantile_cont(p_size, 0.25) AS c FROM part"),
    "agg_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, size(collect(n.key)) AS k, size(collect(DISTINCT n.name)) AS d", "SELECT r_name AS r, count(*) AS k, count(DISTINCT n_name) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_nested_arith": ("MATCH (p:Part) RETURN p.size AS s, p.size + count(*) * 2 AS x", "SELECT p_size AS s, p_size + count(*) * 2 AS x FROM part GROUP BY 1"),
    "sort_limit_skip": ("MATCH (o:Order) RETURN o.key AS k, o.totalprice AS p ORDER BY o.totalprice DESC, k SKIP 5 LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20 OFFSET 5"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.status AS s, o.priority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "union_all": ("MATCH (c:Customer) RETURN c.key AS k UNION ALL MATCH (s:Supplier) RETURN s.key AS k", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.key AS k UNION MATCH (s:Supplier) RETURN s.key AS k", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier"),
    "unwind": ("UNWIND [3, 1, null, 2] AS x RETURN x, x * 2 AS y", "SELECT x::BIGINT AS x, x * 2::BIGINT AS y FROM (SELECT unnest([3, 1, NULL, 2]) AS x)"),
    "case_expr": ("MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'mid' ELSE 'large' END AS c, count(*) AS n", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS c, count(*) AS n FROM part GROUP BY 1"),
    "predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'P' AND (p.size IN [1, 2, 3] XOR p.brand ENDS WITH '1') AND NOT p.type CONTAINS 'zz' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'P') AND ((p_size IN (1, 2, 3)) <> (p_brand LIKE '%1')) AND NOT contains(p_type, 'zz')"),
    "fn_strings": ("MATCH (n:Nation) RETURN n.key AS k, toUpper(n.name) AS u, substring(n.name, 1, 3) AS s, size(n.name) AS l, reverse(n.name) AS r, replace(n.name, 'A', 'x') AS x", "SELECT n_nationkey::BIGINT AS k, upper(n_name) AS u, substring(n_name, 2, 3) AS s, length(n_name) AS l, reverse(n_name) AS r, replace(n_name, 'A', 'x') AS x FROM nation"),
    "fn_numeric": ("MATCH (p:Part) RETURN p.key AS k, abs(p.size - 20) AS a, floor(p.retailprice) AS f, ceil(p.retailprice) AS c, p.size / 7 AS d, p.size % 7 AS m, toInteger('3.9') AS i", "SELECT p_partkey AS k, abs(p_size - 20)::BIGINT AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, (p_size // 7)::BIGINT AS d, (p_size % 7)::BIGINT AS m, 3::BIGINT AS i FROM part"),
    "fn_lists": ("UNWIND range(1, 6) AS i RETURN i, size([x IN range(1, i) WHERE x % 2 = 0]) AS evens, reduce(s = 0, x IN range(1, i) | s + x) AS total, head(range(i, 9)) AS h, all(x IN range(1, i) WHERE x < 4) AS small", "SELECT i::BIGINT AS i, i // 2 AS evens, i * (i + 1) // 2 AS total, i AS h, i < 4 AS small FROM range(1, 7) t(i)"),
    "fn_temporal": ("MATCH (o:Order) RETURN o.orderdate.year AS y, o.orderdate.month AS m, count(*) AS n", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY ALL"),
    "path_functions": ("MATCH p = (c:Customer)-[:PLACED]->(:Order)-[:CONTAINS]->(:Part) RETURN length(p) AS l, size(nodes(p)) AS v, count(*) AS n", "SELECT 2::BIGINT AS l, 3::BIGINT AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
}
CO = (
    "l AS (SELECT DISTINCT l_orderkey AS o, l_partkey * 16 + 4 AS p FROM lineitem), e AS MATERIALIZED (SELECT DISTINCT a.p AS src, b.p AS dst FROM l a JOIN l b USING (o) WHERE a.p < b.p), "
    "u AS MATERIALIZED (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), d AS MATERIALIZED (SELECT u, count(*) AS d FROM u GROUP BY 1), n AS MATERIALIZED (SELECT p_partkey * 16 + 4 AS id FROM part)"
)
#: The bulk purchases' graph: that of algorithms whose results or steps are quadratic, and of sequential ones.
BULK = CO.replace("FROM lineitem)", "FROM lineitem WHERE l_quantity >= 45)")
CYPHER |= {
    "expand_undirected": ("MATCH (a:Part)-[:CO_BUY]-(b:Part) RETURN a.key AS k, count(*) AS n", f"WITH {CO} SELECT (u - 4) // 16 AS k, d AS n FROM d"),
    "rel_unique": ("MATCH (a:Part)-[:CO_BUY]-(b)-[:CO_BUY]-(c) RETURN count(*) AS n", f"WITH {CO} SELECT sum(d * (d - 1))::BIGINT AS n FROM d"),
    "expand_bound_dst": ("MATCH (a:Part)-[:CO_BUY]->(b)-[:CO_BUY]->(c), (a)-[:CO_BUY]->(c) RETURN count(*) AS n", f"WITH {CO} SELECT count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"),
    "expand_varlen_1_3": ("MATCH (a:Part)-[r:CO_BULK*1..3]->(b) RETURN size(r) AS hops, count(*) AS n", f"WITH {BULK} SELECT 1::BIGINT AS hops, count(*) AS n FROM e UNION ALL SELECT 2, count(*) FROM e x JOIN e y ON x.dst = y.src UNION ALL SELECT 3, count(*) FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src"),
}


def _cypher(query: str):
    return lambda spark, sf_dir: execute(table_graph(spark, sf_dir), query)


def _rank(by: str, directed: bool, digits: int = 6, via: str = "CO_BUY"):
    return lambda spark, sf_dir: algo.rank(table_graph(spark, sf_dir), by, "Part", via, directed).select("id", F.round("score", digits).alias("score"))


def _of(verb, by: str, via: str = "CO_BUY", **options):
    return lambda spark, sf_dir: verb(table_graph(spark, sf_dir), by, label="Part", via=via, **options)


def _from_first(verb, by: str, *columns: str, **options):
    """From the bulk graph's smallest source."""

    def query(spark, sf_dir):
        graph = table_graph(spark, sf_dir)
        first = graph.edges["CO_BULK"].agg(F.min("src")).first()[0]
        return verb(graph, by, first, label="Part", via="CO_BULK", **options).select(*columns)

    return query


def _after(query: str, *writes: str):
    """A query's rows after ``writes`` have run."""

    def go(spark, sf_dir):
        graph = table_graph(spark, sf_dir)
        for w in writes:
            graph = run(graph, w).graph
        return execute(graph, query)

    return go


def _vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    near = rows.select("id", "label").alias("a").join(rows.select(F.col("id").alias("to"), F.col("label").alias("l")).alias("b"), (F.col("to") - F.col("id")).between(1, 5))
    return PropertyGraph({"Vec": rows}, {"NEXT": near.select(F.xxhash64("id", "to").alias("eid"), F.col("id").alias("src"), F.col("to").alias("dst"))})


def _similar(by: str, k: int = 5):
    return lambda spark, sf_dir: algo.similar(_vectors(spark, sf_dir), by, vector="v", k=k).withColumn("similarity", F.round("similarity", 5))


def write_counters(spark, sf_dir):
    out = run(table_graph(spark, sf_dir), "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) CREATE (n)-[:WITHIN {since: 1}]->(:Area {name: g.name}) SET n.seen = true, n:Member DELETE r")
    return spark.createDataFrame(sorted(out.counters.items()), "counter string, count long")


def catalog_inventory(spark, sf_dir):
    return lifecycle.inventory(table_graph(spark, sf_dir)).select("entity_kind", "name", "entities").distinct()


def generation_diff(spark, sf_dir):
    graph = table_graph(spark, sf_dir)
    new = run(graph, "MATCH (c:Customer) WHERE c.acctbal < 0 SET c.acctbal = 0.0").graph
    return lifecycle.graph_diff(PropertyGraph({"Customer": graph.nodes["Customer"]}, {}), PropertyGraph({"Customer": new.nodes["Customer"]}, {})).select("name", "entity", "change")


def bulk_import(spark, sf_dir):
    graph = table_graph(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.lit("Document").alias("label"), "lang", "source")
    langs = read(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("key"), F.lit("Language").alias("label"), F.col("lang").alias("name")).distinct()
    links = read(spark, sf_dir, "documents").where("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.concat(F.lit("d"), "doc_id").alias("source_key"), F.col("lang").alias("target_key"), F.lit("WRITTEN_IN").alias("rel_type"))
    got, _ = lifecycle.bulk_import(graph, union([docs, langs]), links)
    return execute(got, "MATCH (d:Document)-[:WRITTEN_IN]->(l:Language) RETURN l.name AS lang, count(d) AS n")


def call_procedure(spark, sf_dir):
    graph = table_graph(spark, sf_dir)
    sizes = spark.createDataFrame([(1, "tiny"), (50, "huge")], "size int, word string")
    return execute(graph, "MATCH (p:Part) CALL size.word(p.size) YIELD word RETURN word, count(*) AS n", procedures={"size.word": Procedure(["size"], ["word"], sizes)})


def find_text(spark, sf_dir):
    found = search.bm25(read(spark, sf_dir, "documents"), "idiot worthless nation", 20, "doc_id")
    return found.select("id", F.round("score", 4).alias("score"))


def find_vector(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    query = vectors.orderBy("vec_id").select("embedding").first()[0]
    return search.cosine(vectors, query, 20, "vec_id").select("id", F.round("score", 5).alias("score"))


def ledger_asof(spark, sf_dir):
    found = writes.as_of(read(spark, sf_dir, "events"), "user_id", "event_id", 5000, "event_id")
    return found.select("user_id", "event_id", "event_type")


def write_set_delete(spark, sf_dir):
    graph = table_graph(spark, sf_dir)
    graph = writes.set_property(graph, "Customer", "tier", F.lit("gold"), F.col("acctbal") > 5000)
    graph = writes.delete_nodes(graph, "Customer", graph.nodes["Customer"].where("acctbal < 0").select("id"), detach=True)
    return execute(graph, "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.tier AS tier, count(*) AS n")


KNOWN = {
    "rank_degree": (_rank("degree", False), f"WITH {CO} SELECT id, round(coalesce(d, 0) / (SELECT count(*) - 1 FROM n), 6) AS score FROM n LEFT JOIN d ON u = id"),
    "rank_triangles": (_rank("triangles", False), f"WITH {CO}, t AS (SELECT unnest([x.src, x.dst, y.dst]) AS u FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), k AS (SELECT u, count(*) AS t FROM t GROUP BY 1) SELECT id, coalesce(t, 0)::DOUBLE AS score FROM n LEFT JOIN k ON u = id"),
    "rank_preferential_attachment": (_rank("preferential_attachment", False), f"WITH {CO}, s AS (SELECT u.u, sum(d.d) AS s FROM u JOIN d ON d.u = u.v GROUP BY 1) SELECT id, coalesce(d * ((SELECT sum(d) FROM d) - d - s), 0)::DOUBLE AS score FROM n LEFT JOIN d ON d.u = id LEFT JOIN s ON s.u = id"),
    **{f"rank_{by}": (_rank(by, False), f"WITH {CO}, x AS (SELECT a.u AS a, b.u AS b, sum({w}) AS x FROM u a JOIN u b ON a.v = b.v AND a.u <> b.u JOIN d ON d.u = a.v GROUP BY 1, 2), y AS (SELECT a, sum(x) AS x FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.u = a AND u.v = b) GROUP BY 1) SELECT id, round(coalesce(x, 0)::DOUBLE, 6) AS score FROM n LEFT JOIN y ON a = id") for by, w in (("common_neighbors", "1"), ("adamic_adar", "1 / ln(d)"), ("resource_allocation", "1 / d"))},
    "analyze_triangle_count": (_of(algo.analyze, "triangle_count"), f"WITH {CO} SELECT count(*) AS triangles FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"),
    "analyze_dyad_census": (_of(algo.analyze, "dyad_census"), f"WITH {CO}, c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS a) SELECT 'mutual' AS dyad, 0::BIGINT AS count UNION ALL SELECT 'asymmetric', a FROM c UNION ALL SELECT 'null', n * (n - 1) // 2 - a FROM c"),
    "paths_transitive_closure": (_of(algo.paths, "transitive_closure", "CO_BULK"), f"WITH RECURSIVE {BULK}, r AS (SELECT src AS source, dst AS target FROM e UNION SELECT source, dst FROM r JOIN e ON target = src) SELECT source, target FROM r"),
    "cluster_components": (lambda spark, sf_dir: _of(algo.cluster, "components", "CO_BULK")(spark, sf_dir).groupBy("community_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).select("first", "size"), f"WITH RECURSIVE {BULK}, r AS (SELECT id AS a, id AS b FROM n UNION SELECT a, v FROM r JOIN u ON b = u), m AS (SELECT a, min(b) AS first FROM r GROUP BY 1) SELECT first, count(*) AS size FROM m GROUP BY 1"),
    "similar_node_similarity": (lambda spark, sf_dir: _of(algo.similar, "node_similarity")(spark, sf_dir).withColumn("similarity", F.round("similarity", 6)), f"WITH {CO}, k AS (SELECT src, count(*) AS d FROM e GROUP BY 1), s AS (SELECT a.src AS id1, b.src AS id2, count(*) AS c FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2), j AS (SELECT id1, id2, c / (x.d + y.d - c) AS similarity FROM s JOIN k x ON x.src = id1 JOIN k y ON y.src = id2) SELECT id1, id2, round(similarity, 6) AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY j.similarity DESC, id2) <= 10"),
    "call_procedure": (call_procedure, "SELECT CASE p_size WHEN 1 THEN 'tiny' ELSE 'huge' END AS word, count(*) AS n FROM part WHERE p_size IN (1, 50) GROUP BY 1"),
    "ledger_asof": (ledger_asof, "SELECT user_id, event_id, event_type FROM events WHERE event_id <= 5000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "write_set_delete": (write_set_delete, f"SELECT CASE WHEN c_acctbal > 5000 THEN 'gold' END AS tier, count(*) AS n FROM {JOIN} WHERE c_acctbal >= 0 GROUP BY 1"),
    "find_vector": (find_vector, "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round(greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], q))), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 20"),
}
ONE_FROM = "(SELECT min(src) FROM e)"
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
NEAR = f"SELECT a.vec_id AS id1, b.vec_id AS id2, {COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"
TOP = "SELECT id1, id2, round(greatest(-1, least(1, s)), 5) AS similarity FROM x"
KNOWN |= {
    "find_text": (find_text, oracles.BM25),
    "rank_total_neighbors": (_rank("total_neighbors", False), f"WITH {CO}, x AS (SELECT a.u AS a, b.u AS b, count(*) AS x FROM u a JOIN u b ON a.v = b.v AND a.u <> b.u GROUP BY 1, 2), y AS (SELECT a, sum(x) AS x FROM x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.u = a AND u.v = b) GROUP BY 1), s AS (SELECT u.u, sum(d.d) AS s FROM u JOIN d ON d.u = u.v GROUP BY 1), k AS (SELECT id, coalesce(d, 0) AS d FROM n LEFT JOIN d ON u = id) SELECT id, (d * ((SELECT count(*) FROM n) - 1 - d) + (SELECT sum(d) FROM k) - d - coalesce(s, 0) - coalesce(x, 0))::DOUBLE AS score FROM k LEFT JOIN s ON s.u = id LEFT JOIN y ON a = id"),
    "rank_clustering_coefficient": (_rank("clustering_coefficient", False), f"WITH {CO}, t AS (SELECT unnest([x.src, x.dst, y.dst]) AS u FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), k AS (SELECT u, count(*) AS t FROM t GROUP BY 1) SELECT id, round(CASE WHEN d > 1 THEN coalesce(2 * t / (d * (d - 1)), 0) ELSE 0 END::DOUBLE, 6) AS score FROM n LEFT JOIN k ON k.u = id LEFT JOIN d ON d.u = id"),
    "analyze_transitivity": (lambda spark, sf_dir: _of(algo.analyze, "transitivity")(spark, sf_dir).select(F.round("transitivity", 9).alias("transitivity")), f"WITH {CO} SELECT round(3 * (SELECT count(*) FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst) / (SELECT sum(d * (d - 1) // 2) FROM d), 9) AS transitivity"),
    "rank_pagerank": (_rank("pagerank", True), oracles.pagerank(CO)), "rank_article_rank": (_rank("article_rank", True), oracles.article_rank(CO)),
    "rank_hits_hub": (_rank("hits_hub", True), oracles.hits(CO, True)), "rank_hits_authority": (_rank("hits_authority", True), oracles.hits(CO, False)), "rank_eigenvector": (_rank("eigenvector", True, 5), oracles.eigenvector(CO)),
    "rank_closeness": (_rank("closeness", True, via="CO_BULK"), f"{oracles.hops(BULK)}, c AS (SELECT s, count(*) AS r, sum(d) AS d FROM h GROUP BY 1) SELECT id, round(coalesce(r * r / (((SELECT count(*) FROM n) - 1) * d), 0)::DOUBLE, 6) AS score FROM n LEFT JOIN c ON s = id"),
    "rank_harmonic_closeness": (_rank("harmonic_closeness", True, via="CO_BULK"), f"{oracles.hops(BULK)}, c AS (SELECT s, sum(1 / d) AS d FROM h GROUP BY 1) SELECT id, round(coalesce(d / ((SELECT count(*) FROM n) - 1), 0)::DOUBLE, 6) AS score FROM n LEFT JOIN c ON s = id"),
    "cluster_strongly_connected": (_of(algo.cluster, "strongly_connected", "CO_BULK", directed=True), f"WITH {BULK} SELECT id, row_number() OVER (ORDER BY id) - 1 AS community_id FROM n"),
    "analyze_triad_census": (_of(algo.analyze, "triad_census", "CO_BULK"), oracles.triads(BULK)),
    "analyze_is_dag": (_of(algo.analyze, "is_dag", "CO_BULK"), "SELECT true AS is_dag"),
    "analyze_topological_sort": (_of(algo.analyze, "topological_sort", "CO_BULK"), f"WITH {BULK} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM n"),
    "analyze_spanning_forest_size": (lambda spark, sf_dir: _of(algo.analyze, "minimum_spanning_tree", "CO_BULK")(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges")), f"WITH RECURSIVE {BULK}, r AS (SELECT id AS a, id AS b FROM n UNION SELECT a, v FROM r JOIN u ON b = u), m AS (SELECT a, min(b) AS first FROM r GROUP BY 1) SELECT (SELECT count(*) FROM n) - count(DISTINCT first) AS edges FROM m"),
    "paths_bfs": (_from_first(algo.paths, "bfs", "target", "hops"), f"{oracles.hops(BULK)} SELECT t AS target, d::BIGINT AS hops FROM h WHERE s = {ONE_FROM}"),
    "paths_dijkstra": (_from_first(algo.paths, "dijkstra", "source", "target", "cost"), f"{oracles.hops(BULK)} SELECT s AS source, t AS target, d::DOUBLE AS cost FROM h WHERE s = {ONE_FROM}"),
    "paths_bellman_ford": (_from_first(algo.paths, "bellman_ford", "source", "target", "cost"), f"{oracles.hops(BULK)} SELECT s AS source, t AS target, d::DOUBLE AS cost FROM h WHERE s = {ONE_FROM}"),
    "paths_dijkstra_all_pairs": (lambda spark, sf_dir: _of(algo.paths, "dijkstra_all_pairs", "CO_BULK")(spark, sf_dir).select("source", "target", "cost"), f"{oracles.hops(BULK)} SELECT s AS source, t AS target, d::DOUBLE AS cost FROM h"),
    "paths_floyd_warshall": (lambda spark, sf_dir: _of(algo.paths, "floyd_warshall", "CO_BULK")(spark, sf_dir).groupBy("cost").agg(F.count(F.lit(1)).alias("n")), f"{oracles.hops(BULK)} SELECT d::DOUBLE AS cost, count(*) AS n FROM h GROUP BY 1"),
    "similar_filtered_node_similarity": (lambda spark, sf_dir: _of(algo.similar, "filtered_node_similarity")(spark, sf_dir).withColumn("similarity", F.round("similarity", 6)), f"WITH {CO}, k AS (SELECT src, count(*) AS d FROM e GROUP BY 1), s AS (SELECT l.src AS id1, l.dst AS id2, count(*) AS c FROM e l JOIN e a ON a.src = l.src JOIN e b ON b.src = l.dst AND b.dst = a.dst GROUP BY 1, 2), j AS (SELECT id1, id2, c / (x.d + y.d - c) AS similarity FROM s JOIN k x ON x.src = id1 JOIN k y ON y.src = id2) SELECT id1, id2, round(similarity, 6) AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY j.similarity DESC, id2) <= 10"),
    "similar_knn": (_similar("knn"), f"WITH x AS ({NEAR} QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY s DESC, id2) <= 5) {TOP} WHERE s >= 0"),
    "similar_cosine": (_similar("cosine"), f"WITH x AS ({NEAR}) {TOP}"),
    "similar_filtered_knn": (_similar("filtered_knn", 2), f"WITH x AS ({NEAR} AND b.vec_id - a.vec_id BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY s DESC, id2) <= 2) {TOP} WHERE s >= 0"),
    "write_property": (lambda spark, sf_dir: execute(algo.write_property(g := table_graph(spark, sf_dir), algo.rank(g, "degree", "Part", "CO_BUY", False), "degree"), "MATCH (p:Part) RETURN p.brand AS b, count(p.degree) AS n"), "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1"),
    "write_create": (_after("MATCH (r:Region)<-[:IN_REGION]-(n)-[h:HAS]->(o:Office) RETURN r.name AS r, count(o) AS k, sum(h.rank) AS s", "MATCH (n:Nation) CREATE (n)-[:HAS {rank: n.key}]->(:Office {name: n.name + ' office'})"), "SELECT r_name AS r, count(*) AS k, sum(n_nationkey)::BIGINT AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "write_merge": (_after("MATCH (c:Customer)-[:IN_SEGMENT]->(s:Segment) RETURN s.name AS seg, s.made AS made, s.met AS met, count(c) AS n", "MATCH (c:Customer) WITH DISTINCT c.mktsegment AS seg MERGE (s:Segment {name: seg}) ON CREATE SET s.made = 1 ON MATCH SET s.met = 1", "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.made = 2 ON MATCH SET s.met = 2", "MATCH (c:Customer), (s:Segment) WHERE c.mktsegment = s.name MERGE (c)-[:IN_SEGMENT]->(s)"), "SELECT c_mktsegment AS seg, 1::BIGINT AS made, 2::BIGINT AS met, count(*) AS n FROM customer GROUP BY 1"),
    "write_set_forms": (_after("MATCH (s:Supplier) RETURN s.flag AS flag, 'Debtor' IN labels(s) AS debtor, count(s.note) AS notes, count(*) AS n", "MATCH (s:Supplier) WHERE s.acctbal < 0 SET s.flag = 'negative', s:Debtor, s += {note: s.name}"), "SELECT CASE WHEN s_acctbal < 0 THEN 'negative' END AS flag, s_acctbal < 0 AS debtor, count(CASE WHEN s_acctbal < 0 THEN 1 END) AS notes, count(*) AS n FROM supplier GROUP BY 1, 2"),
    "write_remove": (_after("MATCH (p:Part) RETURN p.brand AS b, count(*) AS n", "MATCH (p:Part) WHERE p.size < 10 REMOVE p.brand"), "SELECT CASE WHEN p_size >= 10 THEN p_brand END AS b, count(*) AS n FROM part GROUP BY 1"),
    "write_delete": (_after("MATCH (o:Order) OPTIONAL MATCH (o)-[r:CONTAINS]->() RETURN o.status AS s, count(DISTINCT o.key) AS o, count(r) AS n", "MATCH (o:Order) WHERE o.status = 'F' DETACH DELETE o", "MATCH (:Order {status: 'O'})-[r:CONTAINS]->() WHERE r.quantity > 25 DELETE r"), "SELECT o_orderstatus AS s, count(DISTINCT o_orderkey) AS o, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND NOT (o_orderstatus = 'O' AND l_quantity > 25) WHERE o_orderstatus <> 'F' GROUP BY 1"),
    "write_counters": (write_counters, "SELECT unnest(['labels_added', 'nodes_created', 'properties_set', 'relationships_created', 'relationships_deleted']) AS counter, unnest([2 * n, n, 3 * n, n, n]) AS count FROM (SELECT count(*) AS n FROM nation)"),
    "catalog_inventory": (catalog_inventory, " UNION ALL ".join(f"SELECT 'node' AS entity_kind, '{name}' AS name, count(*) AS entities FROM {table}" for name, table in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"))) + "".join(f" UNION ALL SELECT 'relationship', '{name}', {count}" for name, count in (("IN_REGION", "(SELECT count(*) FROM nation)"), ("IN_NATION", "(SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"), ("PLACED", "(SELECT count(*) FROM orders)"), ("CONTAINS", "(SELECT count(*) FROM lineitem)"), ("FULFILLED_BY", "(SELECT count(*) FROM lineitem)"), ("SUPPLIES", "(SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"), ("CO_BUY", f"(WITH {CO} SELECT count(*) FROM e)"), ("CO_BULK", f"(WITH {BULK} SELECT count(*) FROM e)")))),
    "generation_diff": (generation_diff, "SELECT 'Customer' AS name, c_custkey * 16 + 2 AS entity, 'changed' AS change FROM customer WHERE c_acctbal < 0"),
    "bulk_import": (bulk_import, "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1"),
}
#: More of the language: (query, SQL).
MORE_CYPHER = {
    "expand_out_top": ("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS c, o.key AS o ORDER BY o LIMIT 1000", "SELECT o_custkey AS c, o_orderkey AS o FROM orders ORDER BY o LIMIT 1000"),
    "expand_two_hops_top": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN n.name AS n, o.key AS o ORDER BY o LIMIT 500 + 500", f"SELECT n_name AS n, o_orderkey AS o FROM {JOIN} JOIN nation ON c_nationkey = n_nationkey ORDER BY o LIMIT 1000"),
    "fn_lambda": ("UNWIND range(1, 6) AS i RETURN i, reduce(s = 0, x IN [y IN range(1, i) | y / 2] | s + x) AS halves, size([w IN ['a', 'bcd'] | w + 'z'][1]) AS z, size([x IN ['a', 'bb'] WHERE size(x) < i]) AS n", "SELECT i::BIGINT AS i, list_sum([j // 2 for j in range(1, i + 1)])::BIGINT AS halves, 4::BIGINT AS z, CASE WHEN i > 2 THEN 2 WHEN i > 1 THEN 1 ELSE 0 END::BIGINT AS n FROM range(1, 7) t(i)"),
    "quantifiers_null": ("UNWIND [1, 2] AS i RETURN i, single(x IN [1, null] WHERE x = i) AS s, all(x IN [1, null] WHERE x = i) AS a, any(x IN [1, null] WHERE x = i) AS b, none(x IN [1, null] WHERE x = i) AS c", "SELECT i::BIGINT AS i, NULL::BOOLEAN AS s, CASE WHEN i = 2 THEN false END AS a, CASE WHEN i = 1 THEN true END AS b, CASE WHEN i = 1 THEN false END AS c FROM range(1, 3) t(i)"),
    "compare_types": ("UNWIND [1, 2] AS x RETURN x, x = 'a' AS e, x <> 'a' AS d, x < 'a' AS l, x IN ['a', 2] AS i", "SELECT x::BIGINT AS x, false AS e, true AS d, NULL::BOOLEAN AS l, x = 2 AS i FROM range(1, 3) t(x)"),
    "regex_column": ("MATCH (p:Part) WHERE p.name =~ ('.*' + p.brand) OR p.name =~ 'P.*' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE regexp_full_match(p_name, '.*' || p_brand) OR regexp_full_match(p_name, 'P.*')"),
    "path_varlen": ("MATCH p = (a:Part)-[:CO_BULK*1..2]->(b:Part) RETURN size(nodes(p)) AS v, length(p) AS l, count(*) AS n", f"WITH {BULK} SELECT 2::BIGINT AS v, 1::BIGINT AS l, count(*) AS n FROM e UNION ALL SELECT 3, 2, count(*) FROM e x JOIN e y ON x.dst = y.src"),
    "path_nodes": ("MATCH p = (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN o.key AS k, reduce(s = 0, x IN nodes(p) | s + x.key) AS s", f"SELECT o_orderkey AS k, o_custkey + o_orderkey AS s FROM {JOIN} WHERE o_totalprice > 300000"),
    "start_end_node": ("MATCH ()-[r:IN_REGION]->() RETURN startNode(r).name AS a, endNode(r).name AS b", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "map_from_outer": ("MATCH (c:Customer) WITH DISTINCT c.mktsegment AS seg MATCH (d:Customer {mktsegment: seg}) RETURN seg, count(d) AS n", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1"),
    "count_subquery": ("MATCH (c:Customer) RETURN COUNT { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 } AS n, count(*) AS k", f"SELECT n, count(*) AS k FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1) GROUP BY 1"),
    "null_tests": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c, o WHERE o IS NULL RETURN count(c) AS n, count(o) AS m", "SELECT count(*) AS n, 0::BIGINT AS m FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "subscripts": ("UNWIND range(0, 3) AS i RETURN i, [10, 20, 30][i] AS x, [10, 20, 30][-1] AS y, size([10, 20, 30][1..i]) AS z, {a: i, b: 'k'}.a AS m", "SELECT i::BIGINT AS i, CASE WHEN i < 3 THEN 10 * (i + 1) END::BIGINT AS x, 30::BIGINT AS y, greatest(0, least(i, 3) - 1)::BIGINT AS z, i::BIGINT AS m FROM range(0, 4) t(i)"),
    "agg_on_empty": ("MATCH (p:Part) WHERE p.size < 0 RETURN count(*) AS n, sum(p.size) AS s, max(p.size) AS m, size(collect(p.key)) AS c", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, NULL::INT AS m, 0::BIGINT AS c"),
    "to_values": ("MATCH (n:Nation) RETURN toString(n.key) AS s, toBoolean('TRUE') AS b, coalesce(null, n.name) AS c, toFloat('1.5') AS f, round(n.key / 7.0, 2) AS r", "SELECT n_nationkey::VARCHAR AS s, true AS b, n_name AS c, 1.5::DOUBLE AS f, round(n_nationkey / 7.0::DOUBLE, 2) AS r FROM nation"),
    "temporal_truncate": ("MATCH (o:Order) RETURN date.truncate('quarter', o.orderdate) AS q, date.truncate('decade', o.orderdate) AS d, count(*) AS n", "SELECT date_trunc('quarter', o_orderdate)::DATE AS q, date_trunc('decade', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1, 2"),
    "temporal_duration": ("MATCH (o:Order) RETURN duration.inMonths(date('1980-06-15'), date(o.orderdate)).months AS m, count(*) AS n", "SELECT datesub('month', DATE '1980-06-15', o_orderdate::DATE) AS m, count(*) AS n FROM orders GROUP BY 1"),
    "temporal_arithmetic": ("MATCH (o:Order) RETURN date(o.orderdate) + duration({months: 1, days: 2}) AS d, count(*) AS n", "SELECT (o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 2 DAY)::DATE AS d, count(*) AS n FROM orders GROUP BY 1"),
    "temporal_construct": ("UNWIND range(1, 53) AS w RETURN w, date({year: 2020, week: w}) AS a, date({year: 2021, ordinalDay: w}) AS b, duration({days: w, hours: 25}).seconds AS s", "SELECT w::BIGINT AS w, DATE '2019-12-30' + 7 * (w::INT - 1) AS a, DATE '2020-12-31' + w::INT AS b, 90000::BIGINT AS s FROM range(1, 54) t(w)"),
}
MORE = {
    "expand_varlen_unbounded": _cypher("MATCH (a:Part)-[:CO_BULK*]->(b) RETURN count(*) AS n"),
    "rank_k_core": _rank("k_core", False), **{f"rank_{by}": _rank(by, directed, via="CO_BULK") for by, directed in (("betweenness", True), ("celf", True))},
    **{f"cluster_{by}": _of(algo.cluster, by, "CO_BULK") for by in ("label_propagation", "louvain", "k_core_decomposition", "leiden", "speaker_listener", "modularity_optimization", "biconnected", "approximate_max_k_cut")},
    "cluster_k_means": lambda spark, sf_dir: algo.cluster(_vectors(spark, sf_dir), "k_means", vector="v"), "cluster_hdbscan": lambda spark, sf_dir: algo.cluster(_vectors(spark, sf_dir), "hdbscan", vector="v"),
    **{f"analyze_{by}": _of(algo.analyze, by, "CO_BULK") for by in ("minimum_spanning_tree", "maximum_spanning_tree", "dag_longest_path", "dag_longest_path_weighted", "node_coloring", "k1_coloring", "edge_coloring", "articulation_points", "bridges", "has_euler_path", "has_euler_circuit", "is_planar", "max_cardinality_matching")},
    **{f"analyze_{by}": _of(algo.analyze, by, "CO_BULK", directed=False, dim=16) for by in ("fast_random_projection", "hashgnn")},
    "paths_random_walk": _from_first(algo.paths, "random_walk", "walk", "step", "id"), "paths_dfs": _from_first(algo.paths, "dfs", "id", "depth", "position"),
}

QUERIES = {**{k: _cypher(q) for k, (q, _) in (CYPHER | MORE_CYPHER).items()}, **{k: f for k, (f, _) in KNOWN.items()}, **MORE}
SQL = {**{k: s for k, (_, s) in (CYPHER | MORE_CYPHER).items()}, **{k: s for k, (_, s) in KNOWN.items()}}
