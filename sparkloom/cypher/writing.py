"""Queries that write: each gives a new graph, the rows, and counters of what changed.

Clauses run in order. Rows are checkpointed before a write, so that what is created for a row is created once, whatever is computed anew. Null
rows of an OPTIONAL MATCH are left alone by SET, REMOVE and DELETE.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.cypher.lower import WRITES, Change, Create, CypherError, Delete, Lowering, Match, Merge, Node, Parser, Path, Project
from sparkloom.graph import PropertyGraph, union
from sparkloom.plans.lineage import cut

FIXED = ("id", "labels", "eid", "src", "dst", "rel_type")


@dataclass
class Outcome:
    graph: PropertyGraph
    rows: DataFrame | None
    #: nodes_created, nodes_deleted, relationships_created, relationships_deleted, properties_set, labels_added and labels_removed; zeros are left out.
    counters: Counter = field(default_factory=Counter)


class Writing(Lowering):
    def __init__(self, *args):
        super().__init__(*args)
        self.counters: Counter = Counter()

    def run(self, clauses: list, spark) -> DataFrame | None:
        df = None
        for c in clauses:
            if not isinstance(c, WRITES):
                df = self.clause(df, c, spark)
                continue
            df = cut(df if df is not None else spark.range(1).select(F.lit(1).alias("_one")))
            df = {Create: self.create_all, Merge: self.merge, Change: self.change, Delete: self.delete}[type(c)](df, c)
        return df if isinstance(clauses[-1], Project) and clauses[-1].final else None

    # Entities of rows

    def is_node(self, df: DataFrame, var: str) -> bool:
        if var not in df.columns:
            raise CypherError(f"variable {var} is not defined")
        kind = df.schema[var].dataType
        if not isinstance(kind, T.StructType) or not {"id", "eid"} & set(kind.names):
            raise CypherError(f"{var} is neither a node nor a relationship")
        return "eid" not in kind.names

    def again(self, df: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Rows with their nodes and relationships as the graph has them now; those deleted stay as they were."""
        for var in df.columns:
            kind = df.schema[var].dataType
            if var.startswith("_") or only is not None and var not in only or not isinstance(kind, T.StructType) or not {"id", "eid"} & set(kind.names):
                continue
            node = "eid" not in kind.names
            frame = self.entity(self.graph.node_frame() if node else self.graph.edge_frame(), "_now")
            key = lambda c, node=node: [c.id] if node else [c.rel_type, c.eid]
            old = df.withColumnRenamed(var, "_old")
            on = [a == b for a, b in zip(key(F.col("_old")), key(F.col("_now")))]
            columns = [F.col("_now").alias(var) if c == var else F.col(f"`{c}`") for c in df.columns]
            df = old.join(frame, on, "left").select(*columns)
        return df

    def put_nodes(self, labels: list[str], rows: DataFrame) -> None:
        self.graph = self.put(self.graph.with_nodes, self.graph.nodes, ":".join(sorted(labels)), rows)

    def put_edges(self, kind: str, rows: DataFrame) -> None:
        self.graph = self.put(self.graph.with_edges, self.graph.edges, kind, rows)

    def put(self, to, frames: dict, name: str, rows: DataFrame) -> PropertyGraph:
        old = frames.get(name)
        if old is None:
            return to(name, rows)
        kinds = dict(old.dtypes)
        bad = [c for c, k in rows.dtypes if c in kinds and k != kinds[c] and "void" not in (k, kinds[c]) and (k, kinds[c]) not in (("bigint", "int"), ("bigint", "double"), ("int", "double"))]
        if bad:
            raise CypherError(f"{name}.{bad[0]} has values of type {kinds[bad[0]]}")
        return to(name, old.unionByName(rows.select(*(F.col(c).cast(kinds.get(c, k)) if k != "void" else F.col(c) for c, k in rows.dtypes)), allowMissingColumns=True))

    # CREATE and MERGE

    def create_all(self, df: DataFrame, c: Create) -> DataFrame:
        for path in c.paths:
            df = self.create(df, path)
        return df

    def top(self, frame: DataFrame, key: str) -> int:
        return (frame.agg(F.max(key)).first()[0] or 0) + 1

    def values(self, df: DataFrame, props: tuple | None) -> dict[str, Column]:
        return {k: self.expr(v, df) for k, v in self.entries(props)} if props else {}

    def create(self, df: DataFrame, path: Path) -> DataFrame:
        nodes, links = path.items[::2], path.items[1::2]
        names = [n.var or self.fresh("n") for n in nodes]
        for r in links:
            if len(r.types) != 1 or r.way == "both" or r.span:
                raise CypherError("a relationship to create has one type and a direction")
        made = [i for i, n in enumerate(names) if n not in df.columns and n not in names[:i]]
        start, k = self.top(self.graph.node_frame(), "id"), len(made)
        slot = F.monotonically_increasing_id()
        df = cut(df.withColumns({f"_id_{names[i]}": F.lit(start).cast("long") + slot * k + j for j, i in enumerate(made)}))
        n_rows = df.count()
        for i in made:
            props = self.values(df, nodes[i].props)
            rows = df.select(F.col(f"_id_{names[i]}").alias("id"), *(v.alias(p) for p, v in props.items()))
            self.put_nodes(nodes[i].labels, rows)
            self.counted(rows, props)
            self.counters["nodes_created"] += n_rows
            self.counters["labels_added"] += n_rows * len(set(nodes[i].labels))
        end = lambda n: F.col(f"_id_{n}") if f"_id_{n}" in df.columns else F.col(f"`{n}`").id
        for j, r in enumerate(links):
            var = r.var or self.fresh("r")
            if var in df.columns:
                raise CypherError(f"{var} is a relationship already")
            first = self.top(self.graph.edges[r.types[0]], "eid") if r.types[0] in self.graph.edges else 0
            a, b = (names[j], names[j + 1]) if r.way == "out" else (names[j + 1], names[j])
            df = cut(df.withColumn(f"_eid_{var}", F.lit(first).cast("long") + slot))
            props = self.values(df, r.props)
            rows = df.select(F.col(f"_eid_{var}").alias("eid"), end(a).alias("src"), end(b).alias("dst"), *(v.alias(p) for p, v in props.items()))
            self.put_edges(r.types[0], rows)
            self.counted(rows, props)
            self.counters["relationships_created"] += n_rows
            df = df.withColumn(var, F.struct(F.col(f"_eid_{var}").alias("eid"), end(a).alias("src"), end(b).alias("dst"), F.lit(r.types[0]).alias("rel_type"))).drop(f"_eid_{var}")
        new = [names[i] for i in made]
        df = df.withColumns({n: F.struct(F.col(f"_id_{n}").alias("id"), F.array().cast("array<string>").alias("labels")) for n in new}).drop(*(f"_id_{n}" for n in new))
        return self.again(df, [n for n in new if not n.startswith("_")] + [r.var for r in links if r.var])

    def counted(self, rows: DataFrame, props: dict) -> None:
        if props:
            self.counters["properties_set"] += sum(rows.agg(*(F.count(p).alias(p) for p in props)).first())

    def merge(self, df: DataFrame, c: Merge) -> DataFrame:
        """Rows that match keep all their matches; of the others, one for each different pattern to create creates it."""
        nodes, links = c.path.items[::2], c.path.items[1::2]
        items = [Node(n.var or self.fresh("m"), n.labels, n.props) if k % 2 == 0 else n for k, n in enumerate(c.path.items)]
        for r in links:
            r.var = r.var or self.fresh("m")
        path = Path(c.path.var, items)
        new = [x.var for x in items if x.var not in df.columns]
        props = {f"_p{k}_{p}": v for k, x in enumerate(items) if x.var in new for p, v in self.values(df, x.props).items()}
        bound = {f"_b_{x.var}": F.col(f"`{x.var}`").id for x in nodes if x.var and x.var in df.columns}
        base = cut(df.withColumns(props | bound | {"_row": F.monotonically_increasing_id()}))
        # Undirected patterns match both ways and are created in the direction written.
        found = cut(self.match(base, Match([path], None)))
        missing = base.join(found.select("_row"), "_row", "left_anti")
        keys = [*props, *bound]
        one = missing.dropDuplicates(keys) if keys else missing.limit(1)
        for r in links:
            r.way = "out" if r.way == "both" else r.way
        created = cut(self.create(one, path)) if one.limit(1).count() else None
        slim = lambda d: [F.struct(F.col(v).id.alias("id"), F.array().cast("array<string>").alias("labels")).alias(v) if "eid" not in d.schema[v].dataType.names else F.struct(F.col(v).eid.alias("eid"), F.col(v).src.alias("src"), F.col(v).dst.alias("dst"), F.col(v).rel_type.alias("rel_type")).alias(v) for v in new]
        own = [F.col(f"`{x}`") for x in df.columns]
        out = found.select(*own, *slim(found), F.lit(False).alias("_made"))
        if created is not None:
            made = created.select(*(F.col(k).alias(f"{k}_") for k in keys), *slim(created))
            on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
            out = out.unionByName(missing.join(made, on if on else F.lit(True)).select(*own, *new, F.lit(True).alias("_made")))
        out = cut(self.again(cut(out), new))
        for made, changes in ((True, c.on_create), (False, c.on_match)):
            if changes:
                self.change(out.where(F.col("_made") == made), Change(changes))
        out = self.again(out) if c.on_create or c.on_match else out
        return out.drop("_made", *(n for n in new if n.startswith("_")))

    # SET, REMOVE and DELETE

    def change(self, df: DataFrame, c: Change) -> DataFrame:
        for kind, var, *rest in c.items:
            node = self.is_node(df, var)
            ent = F.col(f"`{var}`")
            rows = df.where(ent.isNotNull())
            if kind in ("label", "unlabel"):
                if not node:
                    raise CypherError("relationships have no labels")
                self.relabel(rows.select(ent.id.alias("id")).distinct(), rest[0], kind == "label")
            else:
                if kind == "prop":
                    found, e = self.prepare(rows, rest[1])
                    values = {rest[0]: self.expr(e, found)}
                    rows = found
                elif kind == "unprop":
                    values = {rest[0]: F.lit(None)}
                else:
                    values = self.map_values(rows, rest[0])
                self.assign(rows, var, node, values, kind == "replace", kind == "unprop")
            df = cut(self.again(df))
        return df

    def map_values(self, df: DataFrame, e: tuple) -> dict[str, Column]:
        if e[0] in ("map", "param"):
            return {k: self.expr(v, df) for k, v in self.entries(e)}
        kind = self.kind_of(e, df, {})
        if not isinstance(kind, T.StructType):
            raise CypherError("a map is needed here")
        return {n: self.expr(e, df).getField(n) for n in kind.names if n not in FIXED}

    def assign(self, df: DataFrame, var: str, node: bool, values: dict[str, Column], clear: bool, remove: bool) -> None:
        ent = F.col(f"`{var}`")
        key = [ent.id.alias("_key")] if node else [ent.eid.alias("_key"), ent.rel_type.alias("_type")]
        # Of several rows of an entity, one decides: that of the greatest values.
        new = df.select(*key, F.struct(*(v.alias(k) for k, v in values.items()), F.lit(1).alias("_set")).alias("_v"))
        new = cut(new.groupBy("_key", *(["_type"] if not node else [])).agg(F.max("_v").alias("_v")))
        frames = self.graph.nodes if node else self.graph.edges
        where = [r[0] for r in new.join(self.graph.node_frame().select(F.col("id").alias("_key"), F.concat_ws(":", "labels").alias("_type")), "_key").select("_type").distinct().collect()] if node else [r[0] for r in new.select("_type").distinct().collect()]
        for name in where:
            frame, key_name = frames[name], "id" if node else "eid"
            hit = new if node else new.where(F.col("_type") == name).drop("_type")
            both = frame.join(hit, frame[key_name] == F.col("_key"), "left")
            mine, kinds, out = F.col("_v").isNotNull(), dict(frame.dtypes), []
            for c in frame.columns:
                if c in values:
                    v = F.col("_v").getField(c)
                    if "void" not in (got := new.schema["_v"].dataType[c].dataType.simpleString(), kinds[c]) and got != kinds[c] and {got, kinds[c]} - {"int", "bigint", "double", "smallint", "float"}:
                        raise CypherError(f"{name}.{c} has values of type {kinds[c]}")
                    out.append(F.when(mine, v if kinds[c] == "void" else v.cast(kinds[c])).otherwise(F.col(c)).alias(c))
                elif clear and c not in FIXED:
                    out.append(F.when(~mine, F.col(c)).alias(c))
                else:
                    out.append(F.col(c))
            out += [F.col("_v").getField(k).alias(k) for k in values if k not in frame.columns]
            removed = both.where(mine).agg(*(F.count(F.col(c)) for c in values if c in frame.columns)).first() if remove else ()
            self.counters["properties_set"] += sum(removed)
            frame = cut(both.select(*out))
            self.graph = self.graph.with_nodes(name, frame) if node else PropertyGraph(self.graph.nodes, {**self.graph.edges, name: frame}, self.graph.ends)
        if not remove:
            self.counters["properties_set"] += new.count() * len(values)

    def relabel(self, ids: DataFrame, labels: list[str], add: bool) -> None:
        ids = cut(ids)
        touched = self.graph.node_frame().join(ids, "id", "left_semi").select(F.concat_ws(":", "labels").alias("n")).distinct().collect()
        for (name,) in touched:
            old = set(filter(None, name.split(":")))
            new = old | set(labels) if add else old - set(labels)
            if new == old:
                continue
            frame = self.graph.nodes[name]
            moved = cut(frame.join(ids, "id", "left_semi"))
            self.counters["labels_added" if add else "labels_removed"] += moved.count() * len(new ^ old)
            self.graph = self.graph.with_nodes(name, frame.join(ids, "id", "left_anti"))
            self.put_nodes(sorted(new), moved)

    def delete(self, df: DataFrame, c: Delete) -> DataFrame:
        nodes, edges = [], []
        for e in c.exprs:
            kind = self.kind_of(e, df, {})
            x = self.expr(e, df)
            names = kind.names if isinstance(kind, T.StructType) else []
            if "eid" in names:
                edges.append(df.select(x.rel_type.alias("_type"), x.eid.alias("_key")))
            elif "rels" in names:
                edges.append(df.select(F.explode(x.rels).alias("r")).select(F.col("r.rel_type").alias("_type"), F.col("r.eid").alias("_key")))
                nodes.append(df.select(F.explode(x.nodes).alias("_key")))
            elif "id" in names:
                nodes.append(df.select(x.id.alias("_key")))
            else:
                raise CypherError("DELETE takes nodes, relationships and paths")
        graph = self.graph
        if edges:
            gone = cut(union(edges).where("_key IS NOT NULL").distinct())
            for (name,) in gone.select("_type").distinct().collect():
                own = gone.where(F.col("_type") == name)
                self.counters["relationships_deleted"] += graph.edges[name].join(own, F.col("eid") == F.col("_key"), "left_semi").count()
                graph = PropertyGraph(graph.nodes, {**graph.edges, name: cut(graph.edges[name].join(own, F.col("eid") == F.col("_key"), "left_anti"))}, graph.ends)
        if nodes:
            gone = cut(union(nodes).where("_key IS NOT NULL").distinct())
            left = {}
            for name, frame in graph.edges.items():
                kept = cut(frame.join(gone, F.col("src") == F.col("_key"), "left_anti").join(gone, F.col("dst") == F.col("_key"), "left_anti"))
                lost = frame.count() - kept.count()
                if lost and not c.detach:
                    raise CypherError(f"a node to delete has {name} relationships")
                self.counters["relationships_deleted"] += lost
                left[name] = kept if lost else frame
            held = {name: (frame, frame.join(gone, F.col("id") == F.col("_key"), "left_semi").count()) for name, frame in graph.nodes.items()}
            self.counters["nodes_deleted"] += sum(n for _, n in held.values())
            graph = PropertyGraph({name: cut(f.join(gone, F.col("id") == F.col("_key"), "left_anti")) if n else f for name, (f, n) in held.items()}, left, graph.ends)
        self.graph = graph
        return df


def run(graph: PropertyGraph, query: str, params: dict | None = None, procedures: dict | None = None, max_hops: int = 30) -> Outcome:
    """The new graph, the rows that the query returns, if any, and counters. ``graph`` itself is never changed, so a query that fails changes nothing."""
    spark = next(iter(graph.nodes.values())).sparkSession
    parts = Parser(query).query()
    if len(parts) > 1 and any(isinstance(c, WRITES) for clauses, _ in parts for c in clauses):
        raise CypherError("a query that writes has no UNION")
    low = Writing(graph, params or {}, procedures or {}, max_hops)
    rows = low.run(parts[0][0], spark)
    return Outcome(low.graph, rows, Counter({k: v for k, v in low.counters.items() if v}))
