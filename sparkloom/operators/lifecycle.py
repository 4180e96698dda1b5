"""Graphs as they are stored and described: bulk import with receipts, checkpoints by name, portable folders, the catalog, and results as Arrow or pages."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import AGGREGATES, SCALARS, TEMPORAL
from sparkloom.functions.temporal import TYPED
from sparkloom.graph import PropertyGraph, union
from sparkloom.plans.lineage import cut


class ImportRejected(ValueError):
    """Nothing was imported; ``problems`` has a row for each rejected input row: row_ordinal, entity_kind, reason."""

    def __init__(self, problems: DataFrame):
        super().__init__("rows of the import were rejected")
        self.problems = problems


@dataclass
class ImportSession:
    """Collects nodes and relationships, checks all of them, and publishes them at once.

    Node rows: key (unique among the session's), label, properties; relationship rows: source_key, target_key, rel_type, properties. Relationships
    reach nodes of the session by their keys, or nodes of the graph by ``source_id`` and ``target_id``.
    """

    graph: PropertyGraph
    nodes: list[DataFrame] = field(default_factory=list)
    edges: list[DataFrame] = field(default_factory=list)

    def add_nodes(self, rows: DataFrame) -> ImportSession:
        self.nodes.append(rows)
        return self

    def add_edges(self, rows: DataFrame) -> ImportSession:
        self.edges.append(rows)
        return self

    def publish(self) -> tuple[PropertyGraph, DataFrame]:
        """The new graph, and receipts: row_ordinal, entity_kind, entity_id, label, rel_type, source_id, target_id, operation_id."""
        first = (self.graph.node_frame().agg(F.max("id")).first()[0] or 0) + 1
        empty = self.graph.node_frame().select(F.lit("").alias("key"), F.lit("").alias("label")).limit(0)
        # Numbered once, in a checkpoint, as ids go both into nodes and relationships.
        nodes = cut(union([empty, *self.nodes]).withColumn("row_ordinal", F.monotonically_increasing_id()))
        nodes = nodes.withColumn("id", F.col("row_ordinal") + first)
        twice = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        bad = [
            nodes.where("label IS NULL OR label = ''").select("row_ordinal", F.lit("node").alias("entity_kind"), F.lit("a node needs a label").alias("reason")),
            nodes.where("key IS NULL").select("row_ordinal", F.lit("node"), F.lit("a node needs a key")),
            nodes.join(twice, "key", "left_semi").select("row_ordinal", F.lit("node"), F.lit("the key is there twice")),
        ]
        edges = None
        if self.edges:
            e = union(self.edges)
            for c in ("source_id", "target_id"):
                e = e if c in e.columns else e.withColumn(c, F.lit(None).cast("long"))
            for c in ("source_key", "target_key"):
                e = e if c in e.columns else e.withColumn(c, F.lit(None).cast("string"))
            e = cut(e.withColumn("row_ordinal", F.monotonically_increasing_id()))
            known = self.graph.node_frame().select(F.col("id").alias("_id"))
            for side, out in (("source", "src"), ("target", "dst")):
                new = nodes.select(F.col("key").alias(f"{side}_key"), F.col("id").alias(f"_{out}"))
                e = e.join(new, f"{side}_key", "left").join(known, F.col(f"{side}_id") == F.col("_id"), "left").withColumn(out, F.coalesce(f"_{out}", "_id")).drop(f"_{out}", "_id")
            edges = cut(e)
            bad += [
                edges.where("rel_type IS NULL OR rel_type = ''").select("row_ordinal", F.lit("relationship"), F.lit("a relationship needs a type")),
                edges.where("src IS NULL").select("row_ordinal", F.lit("relationship"), F.lit("the source isn't there")),
                edges.where("dst IS NULL").select("row_ordinal", F.lit("relationship"), F.lit("the target isn't there")),
            ]
        problems = cut(bad[0].toDF("row_ordinal", "entity_kind", "reason"))
        for b in bad[1:]:
            problems = problems.unionByName(b.toDF("row_ordinal", "entity_kind", "reason"))
        problems = cut(problems.distinct())
        if problems.limit(1).count():
            raise ImportRejected(problems)
        graph, operation = self.graph, str(uuid.uuid4())
        drop = lambda df, *names: df.drop(*names, *(c for c in df.columns if c in ("row_ordinal",)))
        for (label,) in nodes.select("label").distinct().collect():
            rows = drop(nodes.where(F.col("label") == label), "key", "label")
            old = graph.nodes.get(label)
            graph = graph.with_nodes(label, rows if old is None else old.unionByName(rows, allowMissingColumns=True))
        none = F.lit(None).cast("long")
        receipts = nodes.select("row_ordinal", F.lit("node").alias("entity_kind"), F.col("id").alias("entity_id"), "label", F.lit(None).cast("string").alias("rel_type"), none.alias("source_id"), none.alias("target_id"))
        if edges is not None:
            for (kind,) in edges.select("rel_type").distinct().collect():
                old = graph.edges.get(kind)
                base = (old.agg(F.max("eid")).first()[0] or 0) + 1 if old is not None else 0
                rows = drop(edges.where(F.col("rel_type") == kind).withColumn("eid", F.col("row_ordinal") + base), "rel_type", "source_key", "target_key", "source_id", "target_id")
                graph = graph.with_edges(kind, rows if old is None else old.unionByName(rows, allowMissingColumns=True))
                receipts = receipts.unionByName(edges.where(F.col("rel_type") == kind).select("row_ordinal", F.lit("relationship").alias("entity_kind"), (F.col("row_ordinal") + base).alias("entity_id"), F.lit(None).cast("string").alias("label"), "rel_type", F.col("src").alias("source_id"), F.col("dst").alias("target_id")))
        return graph, receipts.withColumn("operation_id", F.lit(operation))


def bulk_import(graph: PropertyGraph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[PropertyGraph, DataFrame]:
    session = ImportSession(graph)
    if nodes is not None:
        session.add_nodes(nodes)
    if edges is not None:
        session.add_edges(edges)
    return session.publish()


def lookup(graph: PropertyGraph, label: str | None = None, **properties) -> DataFrame:
    """Nodes by label and values of properties; null asks for null."""
    df = graph.node_frame([label] if label else None)
    for k, v in properties.items():
        if k not in df.columns:
            return df.limit(0)
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df


# Folders


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def export_graph(graph: PropertyGraph, folder: str) -> dict:
    """A Parquet folder for each label set and type, with a manifest of names, schemas and counts that is written last, so a folder without it is not whole."""
    spark = next(iter(graph.nodes.values())).sparkSession
    found: dict = {"format": 1, "nodes": [], "edges": []}
    for kind, frames in (("nodes", graph.nodes), ("edges", graph.edges)):
        for i, (name, frame) in enumerate(sorted(frames.items())):
            path = f"{kind}/{i:05d}"
            frame.write.mode("overwrite").parquet(f"{folder}/{path}")
            found[kind].append({"name": name, "path": path, "rows": spark.read.parquet(f"{folder}/{path}").count(), "schema": frame.schema.jsonValue()})
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return found


def import_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """A graph that ``export_graph`` wrote; counts that differ from the manifest's are an error."""
    from pyspark.sql.types import StructType

    found = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    got: dict = {"nodes": {}, "edges": {}}
    for kind in got:
        for x in found[kind]:
            frame = spark.read.schema(StructType.fromJson(x["schema"])).parquet(f"{folder}/{x['path']}")
            if frame.count() != x["rows"]:
                raise ValueError(f"{x['name']} has not as many rows as the manifest says")
            got[kind][x["name"]] = frame
    return PropertyGraph(got["nodes"], got["edges"])


class Checkpoints:
    """Versions of a graph by name in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, graph: PropertyGraph, name: str) -> None:
        if name in self.names():
            raise ValueError(f"{name} is there already")
        export_graph(graph, f"{self.folder}/{name}")

    def names(self) -> list[str]:
        fs, path = _fs(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "manifest/_SUCCESS"))) if fs.exists(path) else []

    def load(self, name: str) -> PropertyGraph:
        if name not in self.names():
            raise ValueError(f"no checkpoint {name}")
        return import_graph(self.spark, f"{self.folder}/{name}")

    def delete(self, name: str) -> None:
        fs, path = _fs(self.spark, f"{self.folder}/{name}")
        fs.delete(path, True)

    def diff(self, old: str, new: str) -> DataFrame:
        return graph_diff(self.load(old), self.load(new))


def graph_diff(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """entity_kind, name, entity, change (added, removed or changed) between two graphs; properties are compared, their order isn't."""

    def digests(frames: dict, key: str, kind: str, out: str) -> DataFrame | None:
        parts = []
        for name, frame in frames.items():
            values = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(frame.columns) if c != key))) if len(frame.columns) > 1 else F.lit("")
            parts.append(frame.select(F.lit(kind).alias("entity_kind"), F.lit(name).alias("name"), F.col(key).alias("entity"), F.md5(values).alias(out)))
        return union(parts) if parts else None

    rows = []
    for key, kind, a, b in (("id", "node", old.nodes, new.nodes), ("eid", "relationship", old.edges, new.edges)):
        x, y = digests(a, key, kind, "a"), digests(b, key, kind, "b")
        if x is None and y is None:
            continue
        if x is None or y is None:
            x = x if x is not None else y.withColumnRenamed("b", "a").limit(0)
            y = y if y is not None else x.withColumnRenamed("a", "b").limit(0)
        rows.append(x.join(y, ["entity_kind", "name", "entity"], "full"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return union(rows).select("entity_kind", "name", "entity", change.alias("change")).where("change IS NOT NULL")


# Catalog


def inventory(graph: PropertyGraph) -> DataFrame:
    """entity_kind, name, property, type, entities, present: the labels, types and properties, and how many entities have them."""
    out = []
    for kind, frames, fixed in (("node", graph.nodes, {"id"}), ("relationship", graph.edges, {"eid", "src", "dst"})):
        for name, frame in sorted(frames.items()):
            props = [(c, t) for c, t in frame.dtypes if c not in fixed]
            counts = frame.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, (c, _) in enumerate(props)))
            each = F.array(*(F.struct(F.lit(c).alias("property"), F.lit(t).alias("type"), F.col(f"_c{i}").alias("present")) for i, (c, t) in enumerate(props))) if props else F.array(F.struct(F.lit(None).cast("string").alias("property"), F.lit(None).cast("string").alias("type"), F.col("_n").alias("present")))
            out.append(counts.select(F.lit(kind).alias("entity_kind"), F.lit(name).alias("name"), F.col("_n").alias("entities"), F.explode(each).alias("p")).select("entity_kind", "name", "p.property", "p.type", "entities", "p.present"))
    return union(out)


def functions(spark: SparkSession) -> DataFrame:
    """name, kind of what queries may call."""
    rows = [(n, "scalar") for n in {*SCALARS, *TYPED}] + [(n, "aggregate") for n in AGGREGATES] + [(n, "accessor") for n in TEMPORAL]
    return spark.createDataFrame(sorted(rows), "name string, kind string")


def algorithms(spark: SparkSession) -> DataFrame:
    """verb, name of the algorithms."""
    from sparkloom.algo import verbs

    found = {"rank": verbs.RANK, "cluster": {**verbs.CLUSTER, **verbs.VECTOR_CLUSTER}, "similar": {**verbs.SIMILAR, **verbs.VECTOR_SIMILAR}, "paths": verbs.PATHS, "analyze": {**verbs.ANALYZE, "graphsage": None}}
    return spark.createDataFrame([(v, n) for v, c in found.items() for n in sorted(c)], "verb string, name string")


def explain(graph: PropertyGraph, query: str, params: dict | None = None, mode: str = "formatted") -> str:
    """The plan of a query that reads, as text."""
    from sparkloom.cypher import execute

    df = execute(graph, query, params)
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


# Results


def to_arrow(df: DataFrame, most: int = 1_000_000):
    """The result as an Arrow table; more rows than ``most`` are an error, as the driver holds them."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows")
    return df.toArrow()


def pages(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """The rows, ``size`` at a time, one partition after another, so the driver holds a partition's rows at most."""
    page: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page
