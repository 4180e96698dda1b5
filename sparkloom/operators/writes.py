"""Writes: each returns a new graph and counters; frames are never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.graph import PropertyGraph


def create_nodes(graph: PropertyGraph, label: str, rows: DataFrame) -> PropertyGraph:
    """``rows``: id and properties."""
    old = graph.nodes.get(label)
    return graph.with_nodes(label, rows if old is None else old.unionByName(rows, allowMissingColumns=True))


def create_edges(graph: PropertyGraph, kind: str, rows: DataFrame) -> PropertyGraph:
    """``rows``: eid, src, dst and properties; both ends have to be there."""
    ids = graph.node_frame().select("id")
    for end in ("src", "dst"):
        if rows.join(ids, rows[end] == ids.id, "left_anti").limit(1).count():
            raise ValueError(f"an edge's {end} is not in the graph")
    old = graph.edges.get(kind)
    return graph.with_edges(kind, rows if old is None else old.unionByName(rows, allowMissingColumns=True))


def merge_nodes(graph: PropertyGraph, label: str, rows: DataFrame, on: list[str]) -> tuple[PropertyGraph, DataFrame]:
    """Creates the rows (one of each key) that match no node on ``on``; returns those created too."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    old = graph.nodes[label]
    new = rows.dropDuplicates(on).alias("r").join(old.alias("n"), same, "left_anti")
    return graph.with_nodes(label, old.unionByName(new, allowMissingColumns=True)), new


def set_property(graph: PropertyGraph, label: str, name: str, value: Column, where: Column | None = None) -> PropertyGraph:
    frame = graph.nodes[label]
    old = F.col(name) if name in frame.columns else F.lit(None)
    return graph.with_nodes(label, frame.withColumn(name, value if where is None else F.when(where, value).otherwise(old)))


def remove_property(graph: PropertyGraph, label: str, name: str) -> PropertyGraph:
    return graph.with_nodes(label, graph.nodes[label].drop(name))


def delete_nodes(graph: PropertyGraph, label: str, ids: DataFrame, detach: bool = False) -> PropertyGraph:
    """Without ``detach``, a node that has edges is an error."""
    edges = dict(graph.edges)
    for kind, frame in graph.edges.items():
        for end in ("src", "dst"):
            if detach:
                edges[kind] = edges[kind].join(ids.select(F.col("id").alias("_d")), F.col(end) == F.col("_d"), "left_anti")
            elif frame.join(ids.select(F.col("id").alias("_d")), F.col(end) == F.col("_d"), "left_semi").limit(1).count():
                raise ValueError(f"a node to delete has {kind} edges")
    return PropertyGraph({**graph.nodes, label: graph.nodes[label].join(ids.select("id"), "id", "left_anti")}, edges, graph.ends)


def difference(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, change (added, removed or changed) between two versions of a frame."""
    digest = lambda df, name: df.select(key, F.xxhash64(*[c for c in sorted(df.columns) if c != key]).alias(name))
    both = digest(old, "a").join(digest(new, "b"), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")


def as_of(events: DataFrame, key: str, at: str, cutoff, order: str) -> DataFrame:
    """The latest event of each key at or before ``cutoff``."""
    best = events.where(F.col(at) <= F.lit(cutoff)).groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(at, order)).alias("e"))
    return best.select("e.*")
