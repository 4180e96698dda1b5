"""The verbs and their catalogs: which algorithm ``by`` names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.algo import communities as C
from sparkloom.algo import kernels as K
from sparkloom.algo import native as N
from sparkloom.algo import structure as S
from sparkloom.algo import vectors as V
from sparkloom.graph import PropertyGraph

SCORE, GROUP = "id long, score double", "id long, community_id long"
_kernel = lambda make, schema: lambda n, e, directed: K.run(n, e, make(directed), schema)


def _longest(found: DataFrame) -> DataFrame:
    """Of the components' longest paths the longest, ties to the smaller ids."""
    at = F.split("path", ",").cast("array<long>")
    return found.agg(F.min(F.struct((-F.col("cost")).alias("_k"), at.alias("_p"), "cost", "path")).alias("m")).where("m IS NOT NULL").select("m.cost", "m.path")


RANK = {
    "pagerank": N.pagerank, "degree": N.degree, "eigenvector": N.eigenvector, "article_rank": N.article_rank, "clustering_coefficient": N.clustering, "triangles": N.triangles, "k_core": N.k_core,
    "hits_hub": lambda n, e, d: N._hits(n, e, d, True), "hits_authority": lambda n, e, d: N._hits(n, e, d, False), "preferential_attachment": N.preferential_attachment, "adamic_adar": N.adamic_adar,
    "common_neighbors": N.common_neighbors, "resource_allocation": N.resource_allocation, "total_neighbors": N.total_neighbors, "betweenness": _kernel(K.betweenness, SCORE),
    "celf": _kernel(C.celf, SCORE), "closeness": _kernel(lambda d: K.closeness(d, False), SCORE), "harmonic_closeness": _kernel(lambda d: K.closeness(d, True), SCORE),
}
CLUSTER = {
    "components": N.components, "strongly_connected": N.strongly_connected, "k_core_decomposition": lambda n, e, d: N.k_core(n, e, d).select("id", F.col("score").cast("long").alias("community_id")),
    "label_propagation": _kernel(lambda d: K.label_propagation, GROUP), "louvain": _kernel(lambda d: K.louvain(), GROUP), "modularity_optimization": _kernel(lambda d: K.louvain(True), GROUP),
    **{name: _kernel(lambda d, f=f: f, GROUP) for name, f in (("leiden", C.leiden), ("speaker_listener", C.speaker_listener), ("girvan_newman", C.girvan_newman), ("fastgreedy", C.fastgreedy), ("biconnected", C.biconnected),
       ("leading_eigenvector", C.leading_eigenvector), ("walktrap", C.walktrap), ("spinglass", C.spinglass), ("approximate_max_k_cut", C.max_k_cut))}, "infomap": _kernel(C.infomap, GROUP),
}
ANALYZE = {
    "minimum_spanning_tree": lambda n, e, w, d: K.by_component(n, e, K.spanning_tree(False), "eid long, src long, dst long, weight double", w),
    "maximum_spanning_tree": lambda n, e, w, d: K.by_component(n, e, K.spanning_tree(True), "eid long, src long, dst long, weight double", w),
    "is_dag": lambda n, e, w, d: N.is_dag(n, e, d), "topological_sort": lambda n, e, w, d: K.run(n, e, K.topological_sort, "id long, position long"),
    "dag_longest_path": lambda n, e, w, d: _longest(K.by_component(n, e, K.longest_path, "cost double, path string")), "find_cycles": lambda n, e, w, d: K.run(n, e, K.find_cycles, "cycle string, length long"),
    "node_coloring": lambda n, e, w, d: K.by_component(n, e, K.coloring(False), "id long, color long"), "k1_coloring": lambda n, e, w, d: K.by_component(n, e, K.coloring(True), "id long, color long"),
    "edge_coloring": lambda n, e, w, d: K.by_component(n, e, K.edge_coloring, "eid long, color long"), "chromatic_number": lambda n, e, w, d: K.run(n, e, K.chromatic_number, "chromatic_number long", max_edges=5_000),
    "max_bipartite_matching": lambda n, e, w, d: K.run(n, e, K.bipartite_matching, "left long, right long"), "articulation_points": lambda n, e, w, d: K.by_component(n, e, K.articulation_points, "id long"),
    "bridges": lambda n, e, w, d: K.by_component(n, e, K.bridges, "eid long, src long, dst long"), "triangle_count": lambda n, e, w, d: N.triangle_count(n, e),
    "transitivity": lambda n, e, w, d: N.transitivity(n, e), "dyad_census": lambda n, e, w, d: N.dyad_census(n, e), "triad_census": lambda n, e, w, d: K.run(n, e, K.triad_census, "triad string, count long"),
    "has_euler_circuit": lambda n, e, w, d: N.euler(n, e, "circuit", d), "has_euler_path": lambda n, e, w, d: N.euler(n, e, "path", d),
}
#: Clusters of the nodes' vectors: (nodes with their properties, vector, options).
VECTOR_CLUSTER = {"k_means": V.k_means, "hdbscan": V.hdbscan}
ANALYZE |= {
    "minimum_k_spanning_tree": lambda n, e, w, d, k=3: K.run(n, e, S.k_spanning_trees(k), "rank long, weight double, edges string", w), "dag_longest_path_weighted": lambda n, e, w, d: _longest(K.by_component(n, e, S.longest_weighted, "cost double, path string", w)),
    "max_cardinality_matching": lambda n, e, w, d: K.run(n, e, S.max_cardinality_matching, "eid long, src long, dst long"), "max_weight_matching": lambda n, e, w, d: K.run(n, e, S.max_weight_matching, "eid long, src long, dst long, weight double", w),
    "euler_circuit": lambda n, e, w, d: K.run(n, e, S.euler_trail("circuit", d), "nodes string, edges string"), "euler_path": lambda n, e, w, d: K.run(n, e, S.euler_trail("path", d), "nodes string, edges string"),
    "is_planar": lambda n, e, w, d: K.by_component(n, e, S.is_planar, "found boolean").agg(F.coalesce(F.bool_and("found"), F.lit(True)).alias("found")), "count_automorphisms": lambda n, e, w, d: K.run(n, e, S.automorphisms(d), "automorphisms long"),
    "modularity": lambda n, e, w, d, partition=None: N.modularity(n, e, partition, w), "conductance": lambda n, e, w, d, partition=None: N.conductance(n, e, partition, w),
    "node2vec": lambda n, e, w, d, **o: V.node2vec(n, e, directed=d, **o), "fast_random_projection": lambda n, e, w, d, **o: V.fast_random_projection(n, e, directed=d, **o), "hashgnn": lambda n, e, w, d, **o: V.hashgnn(n, e, directed=d, **o),
}
FLOW = "eid long, src long, dst long, flow double"


def _costs(e: DataFrame, cost: str) -> dict:
    """Of edges that a kernel will hold as well."""
    return dict(e.select("eid", F.col(cost).cast("double")).limit(K.MAX_EDGES).collect())


PATHS = {
    "bfs": lambda n, e, s, t, w, d: N.bfs(n, e, s, d), "dfs": lambda n, e, s, t, w, d: K.run(n, e, K.dfs(s), "id long, depth long, position long"),
    "dijkstra": lambda n, e, s, t, w, d: N.shortest(n, e, s, w, d, target=t), "delta_stepping": lambda n, e, s, t, w, d: N.shortest(n, e, s, w, d, target=t), "bellman_ford": lambda n, e, s, t, w, d: N.shortest(n, e, s, w, d, True, t),
    "astar": lambda n, e, s, t, w, d: N.shortest(n, e, s, w, d, target=t), "dijkstra_all_pairs": lambda n, e, s, t, w, d: N.shortest(n, e, None, w, d), "floyd_warshall": lambda n, e, s, t, w, d: N.shortest(n, e, None, w, d, True),
    "transitive_closure": lambda n, e, s, t, w, d: N.transitive_closure(n, e, d), "random_walk": lambda n, e, s, t, w, d: N.random_walk(n, e, s), "yens": lambda n, e, s, t, w, d, k=3: K.run(n, e, S.yens(s, t, k, d), "rank long, cost double, path string", w),
    "max_flow": lambda n, e, s, t, w, d: K.run(n, e, K.max_flow(s, t), "flow double", w), "min_cut": lambda n, e, s, t, w, d: K.run(n, e, K.max_flow(s, t, "cut"), "id long, source_side boolean", w),
    "max_flow_edges": lambda n, e, s, t, w, d: K.run(n, e, S.flow_edges(s, t, False), FLOW, w), "min_cut_edges": lambda n, e, s, t, w, d: K.run(n, e, S.flow_edges(s, t, True), "eid long, src long, dst long, capacity double", w),
    "min_cost_max_flow": lambda n, e, s, t, w, d, cost=None: K.run(n, e, S.min_cost_flow(s, t, _costs(e, cost)), "flow double, cost double", w), "min_cost_max_flow_edges": lambda n, e, s, t, w, d, cost=None: K.run(n, e, S.min_cost_flow(s, t, _costs(e, cost), "edges"), FLOW, w),
    "gomory_hu_tree": lambda n, e, s, t, w, d: K.run(n, e, S.gomory_hu, "source long, target long, capacity double", w), "min_steiner_tree": lambda n, e, s, t, w, d, terminals=(): K.run(n, e, S.steiner(list(terminals)), "eid long, src long, dst long, weight double", w),
    "prize_collecting_steiner_tree": lambda n, e, s, t, w, d, prizes=None: K.run(n, e, S.prize_steiner(dict(prizes or {})), "eid long, src long, dst long, weight double", w),
}
SIMILAR = {"node_similarity": lambda n, e, k: N.node_similarity(n, e, k), "filtered_node_similarity": lambda n, e, k: N.node_similarity(n, e, k, True)}
#: By the nodes' vectors: (nodes with their properties, edges, vector, k).
VECTOR_SIMILAR = {"knn": lambda n, e, v, k: V.cosine_pairs(n, v, k, 0.0), "cosine": lambda n, e, v, k: V.cosine_pairs(n, v), "filtered_knn": V.filtered_knn}


def _by(catalog: dict, by: str):
    if by not in catalog:
        raise ValueError(f"by is one of {', '.join(sorted(catalog))}")
    return catalog[by]


def rank(graph: PropertyGraph, by: str, label: str | None = None, via: str | None = None, directed: bool = True) -> DataFrame:
    """id, score"""
    return _by(RANK, by)(*graph.projection(label, via), directed)


def cluster(graph: PropertyGraph, by: str, label: str | None = None, via: str | None = None, directed: bool = False, vector: str | None = None, **options) -> DataFrame:
    """id, community_id"""
    if by in VECTOR_CLUSTER:
        return VECTOR_CLUSTER[by](graph.node_frame([label] if label else None), vector, **options)
    return _by(CLUSTER, by)(*graph.projection(label, via), directed)


def similar(graph: PropertyGraph, by: str, label: str | None = None, via: str | None = None, k: int = 10, vector: str | None = None) -> DataFrame:
    """id1, id2, similarity"""
    if by in VECTOR_SIMILAR:
        return VECTOR_SIMILAR[by](graph.node_frame([label] if label else None), graph.projection(label, via)[1], vector, k)
    return _by(SIMILAR, by)(*graph.projection(label, via), k)


def paths(graph: PropertyGraph, by: str, source: int | None = None, target: int | None = None, label: str | None = None, via: str | None = None, weight: str | None = None, directed: bool = True, **options) -> DataFrame:
    return _by(PATHS, by)(*graph.projection(label, via), source, target, weight, directed, **options)


def analyze(graph: PropertyGraph, by: str, label: str | None = None, via: str | None = None, weight: str | None = None, directed: bool = True, features: list[str] | None = None, **options) -> DataFrame:
    if by == "graphsage":
        return V.graphsage(graph.node_frame([label] if label else None), graph.projection(label, via)[1], features, **options)
    return _by(ANALYZE, by)(*graph.projection(label, via), weight, directed, **options)


def write_property(graph: PropertyGraph, found: DataFrame, name: str) -> PropertyGraph:
    """The graph with a rank's score or a cluster's community_id as property ``name`` of its nodes; other nodes keep what they have."""
    value = next(c for c in found.columns if c != "id")
    new = found.select("id", F.col(value).alias("_v"))
    for label, frame in graph.nodes.items():
        old = F.col(name) if name in frame.columns else F.lit(None)
        both = frame.join(new, "id", "left")
        graph = graph.with_nodes(label, both.withColumn(name, F.coalesce("_v", old)).drop("_v"))
    return graph
