"""Queries to DataFrame plans: patterns become joins, pattern predicates semi and anti joins, variable-length patterns frontier loops."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.cypher.parser import Call, Change, Create, CypherError, Delete, Item, Match, Merge, Node, Parser, Path, Project, Rel, Unwind
from sparkloom.functions import AGGREGATES, SCALARS, TEMPORAL, aggregate
from sparkloom.functions.temporal import TYPED, duration, duration_part, temporal_arithmetic
from sparkloom.graph import PropertyGraph, union
from sparkloom.plans.lineage import cut

COMPARE = {"=", "<>", "<", "<=", ">", ">="}


@dataclass
class Procedure:
    """A fixture table for CALL: rows are joined on the input columns."""

    inputs: list[str]
    outputs: list[str]
    rows: DataFrame


def parts(e) -> list:
    """Expressions directly inside ``e``."""
    return [x for x in e[1:] if isinstance(x, tuple) and x and isinstance(x[0], str)] + [y for x in e[1:] if isinstance(x, list) for y in x if isinstance(y, tuple) and y and isinstance(y[0], str)] if isinstance(e, tuple) else []


def has_aggregate(e) -> bool:
    return e[0] == "call" and e[1] in AGGREGATES or any(has_aggregate(x) for x in _children(e))


def _children(e) -> list:
    if e[0] == "map":
        return [v for _, v in e[1]]
    if e[0] == "case":
        return [x for x in (e[1], e[3]) if x] + [y for a in e[2] for y in a]
    if e[0] in ("lit", "param", "var", "pattern", "exists", "countsub", "col", "star"):
        return []
    return [x for x in e[1:] if isinstance(x, tuple) and x and isinstance(x[0], str)] + [y for x in e[1:] if isinstance(x, list) for y in x if isinstance(y, tuple)]


FAMILIES = ((T.NumericType, "number"), (T.StringType, "string"), (T.BooleanType, "boolean"), (T.ArrayType, "list"), (T.StructType, "map"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time"))


def family(kind: T.DataType) -> str | None:
    """The family of values within which equality can hold; None for null."""
    return next((name for types, name in FAMILIES if isinstance(kind, types)), None)


def unlike(a: T.DataType | None = None, b: T.DataType | None = None) -> bool:
    return None not in (a, b) and None not in (family(a), family(b)) and family(a) != family(b)


class Lowering:
    def __init__(self, graph: PropertyGraph, params: dict, procedures: dict[str, Procedure], max_hops: int = 30):
        self.graph, self.params, self.procedures, self.max_hops, self.ids = graph, params, procedures, max_hops, count()

    def fresh(self, kind: str) -> str:
        return f"_{kind}{next(self.ids)}"

    # Expressions

    def literal(self, v) -> Column:
        if isinstance(v, list):
            return F.array(*map(self.literal, v))
        if isinstance(v, dict):
            return F.struct(*(self.literal(x).alias(k) for k, x in v.items()))
        return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)

    def kind(self, df: DataFrame, c: Column) -> T.DataType:
        return df.select(c.alias("_t")).schema[0].dataType

    def kind_of(self, e: tuple, df: DataFrame, local: dict) -> T.DataType:
        """The type of an expression; the lambda variables in ``local`` (name: column, type) stand as typed nulls."""
        return self.kind(df, self.expr(e, df, {k: (F.lit(None).cast(t), t) for k, (_, t) in local.items()}))

    def element(self, e: tuple, df: DataFrame, local: dict) -> T.DataType:
        kind = self.kind_of(e, df, local)
        if not isinstance(kind, (T.ArrayType, T.NullType)):
            raise CypherError("a list is needed here")
        return kind.elementType if isinstance(kind, T.ArrayType) else kind

    def expr(self, e: tuple, df: DataFrame, local: dict | None = None) -> Column:
        local = local or {}
        go = lambda x: self.expr(x, df, local)
        op = e[0]
        if op == "lit":
            return self.literal(e[1])
        if op == "param":
            if e[1] not in self.params:
                raise CypherError(f"missing parameter ${e[1]}")
            return self.literal(self.params[e[1]])
        if op == "col":
            return F.col(e[1])
        if op == "var":
            if e[1] in local:
                return local[e[1]][0]
            if e[1] not in df.columns:
                raise CypherError(f"variable {e[1]} is not defined")
            return F.col(f"`{e[1]}`")
        if op == "prop":
            return self.prop(e, df, local)
        if op in ("and", "or"):
            return go(e[1]) & go(e[2]) if op == "and" else go(e[1]) | go(e[2])
        if op == "xor":
            return go(e[1]) != go(e[2])
        if op == "not":
            return ~go(e[1])
        if op in COMPARE:
            return self.compare(op, e[1], e[2], df, local)
        if op == "=~":
            return F.rlike(go(e[1]), F.concat(F.lit("^(?:"), go(e[2]), F.lit(")$")))
        if op in ("isnull", "notnull"):
            return go(e[1]).isNull() if op == "isnull" else go(e[1]).isNotNull()
        if op == "in":
            if e[2][0] == "list" and all(x[0] == "lit" for x in e[2][1]):
                own = family(self.kind_of(e[1], df, local))
                fits = [x[1] for x in e[2][1] if own in (None, family(self.kind(df, self.literal(x[1])))) or x[1] is None]
                other = F.when(go(e[1]).isNotNull(), False)
                return go(e[1]).isin(*fits) if fits else other if e[2][1] else F.lit(False)
            if family(self.element(e[2], df, local)) not in (None, family(self.kind_of(e[1], df, local))):
                return F.when(go(e[1]).isNotNull() & go(e[2]).isNotNull(), False)
            return F.array_contains(go(e[2]), go(e[1]))
        if op in ("starts", "ends", "contains"):
            return {"starts": Column.startswith, "ends": Column.endswith, "contains": Column.contains}[op](go(e[1]), go(e[2]))
        if op in ("+", "-", "*", "/", "%", "^", "neg"):
            return self.arithmetic(e, df, local)
        if op == "list":
            return F.array(*map(go, e[1]))
        if op == "map":
            return F.struct(*(go(v).alias(k) for k, v in e[1]))
        if op == "index":
            base, i = go(e[1]), go(e[2])
            if isinstance(self.kind_of(e[1], df, local), T.ArrayType):
                return F.get(base, F.when(i < 0, F.size(base) + i).otherwise(i).cast("int"))
            return base.getField(e[2][1])
        if op == "slice":
            xs = go(e[1])
            edge = lambda x, other: other if x is None else F.when(go(x) < 0, F.greatest(F.size(xs) + go(x), F.lit(0))).otherwise(go(x))
            low, high = edge(e[2], F.lit(0)), edge(e[3], F.size(xs))
            return F.slice(xs, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        if op == "haslabel":
            base, names = go(e[1]), self.kind_of(e[1], df, local).names
            if "rel_type" in names:
                return base.getField("rel_type").isin(*e[2])
            out = F.array_contains(base.getField("labels"), e[2][0])
            for x in e[2][1:]:
                out = out & F.array_contains(base.getField("labels"), x)
            return out
        if op == "case":
            out = None
            for c, v in e[2]:
                test = go(c) if e[1] is None else self.compare("=", e[1], c, df, local)
                out = F.when(test, go(v)) if out is None else out.when(test, go(v))
            return out if e[3] is None else out.otherwise(go(e[3]))
        if op == "listcomp":
            _, var, source, where, out = e
            xs, kind = go(source), self.element(source, df, local)
            if where is not None:
                xs = F.filter(xs, lambda x: self.expr(where, df, {**local, var: (x, kind)}))
            return xs if out is None else F.transform(xs, lambda x: self.expr(out, df, {**local, var: (x, kind)}))
        if op == "quant":
            _, form, var, source, where = e
            kind = self.element(source, df, local)
            test = lambda x: self.expr(where, df, {**local, var: (x, kind)}).cast("boolean")
            xs = go(source)
            if form == "single":
                sure = F.size(F.filter(xs, test))
                return F.when(xs.isNull(), None).when(sure > 1, False).when(F.exists(xs, lambda x: test(x).isNull()), None).otherwise(sure == 1)
            return F.forall(xs, test) if form == "all" else F.exists(xs, test) if form == "any" else ~F.exists(xs, test)
        if op == "reduce":
            _, acc, first, var, source, step = e
            start, kind, each = go(first), self.kind_of(first, df, local), self.element(source, df, local)
            return F.aggregate(go(source), start, lambda a, x: self.expr(step, df, {**local, acc: (a, kind), var: (x, each)}).cast(kind))
        if op == "call":
            return self.call(e, df, local)
        raise CypherError(f"unsupported expression {op}")

    def prop(self, e: tuple, df: DataFrame, local: dict) -> Column:
        base, name = self.expr(e[1], df, local), e[2]
        kind = df.schema[e[1][1]].dataType if e[1][0] == "var" and e[1][1] not in local else self.kind_of(e[1], df, local)
        if isinstance(kind, T.StructType):
            if name not in kind.names and duration(kind):
                return duration_part(base, name)
            return base.getField(name) if name in kind.names else F.lit(None)
        if name in TEMPORAL and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return TEMPORAL[name](base)
        if isinstance(kind, T.NullType):
            return F.lit(None)
        raise CypherError(f"no property {name} here")

    def compare(self, op: str, left: tuple, right: tuple, df: DataFrame, local: dict) -> Column:
        a, b = self.expr(left, df, local), self.expr(right, df, local)
        kinds = [self.kind_of(x, df, local) for x in (left, right)]
        if all(isinstance(k, T.StructType) and "labels" in k.names for k in kinds):
            a, b, kinds = a.getField("id"), b.getField("id"), []
        elif all(isinstance(k, T.StructType) and "eid" in k.names for k in kinds):
            a, b, kinds = F.struct(a.getField("rel_type"), a.getField("eid")), F.struct(b.getField("rel_type"), b.getField("eid")), []
        elif unlike(*kinds):  # values of different families are unequal, and have no order
            return F.when(a.isNotNull() & b.isNotNull(), op == "<>") if op in ("=", "<>") else F.lit(None).cast("boolean")
        out = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        for side, x, k in zip((left, right), (a, b), kinds):  # NaN equals nothing and has no order
            if isinstance(k, (T.DoubleType, T.FloatType)) and side[0] != "lit":
                out = out | F.isnan(x) if op == "<>" else out & ~F.isnan(x)
        return out

    def arithmetic(self, e: tuple, df: DataFrame, local: dict) -> Column:
        op, a = e[0], self.expr(e[1], df, local)
        if op == "neg":
            return -a
        b = self.expr(e[2], df, local)
        if op == "^":
            return F.pow(a.cast("double"), b.cast("double"))
        ka, kb = self.kind_of(e[1], df, local), self.kind_of(e[2], df, local)
        found = temporal_arithmetic(op, a, ka, b, kb)
        if found is not None:
            return found
        if op in "*-%":
            return a * b if op == "*" else a - b if op == "-" else a % b
        if op == "/":
            whole = (T.LongType, T.IntegerType, T.ShortType)
            return F.call_function("div", a, b) if isinstance(ka, whole) and isinstance(kb, whole) else a / b
        if isinstance(ka, T.ArrayType):
            return F.concat(a, b) if isinstance(kb, T.ArrayType) else F.array_append(a, b)
        if isinstance(kb, T.ArrayType):
            return F.array_prepend(b, a)
        if isinstance(ka, T.StringType) or isinstance(kb, T.StringType):
            return F.concat(a.cast("string"), b.cast("string"))
        return a + b

    def call(self, e: tuple, df: DataFrame, local: dict) -> Column:
        _, name, distinct, args = e
        if name in AGGREGATES:
            return aggregate(name, distinct, [] if args and args[0][0] == "star" else [self.expr(x, df, local) for x in args])
        got = [self.expr(x, df, local) for x in args]
        field = {"id": "id", "labels": "labels", "type": "rel_type", "nodes": "nodes", "relationships": "rels"}
        if name in ("id", "elementid"):
            names = self.kind_of(args[0], df, local).names
            out = got[0].getField("eid" if "eid" in names else "id")
            return out.cast("string") if name == "elementid" else out
        if name in field:
            return got[0].getField(field[name])
        if name == "length":
            return F.size(got[0].getField("rels")).cast("long")
        if name in ("startnode", "endnode"):
            return got[0].getField("src" if name == "startnode" else "dst")
        if name == "exists":
            return got[0].isNotNull()
        if name == "size":
            text = isinstance(self.kind_of(args[0], df, local), T.StringType)
            return (F.length(got[0]) if text else F.size(got[0])).cast("long")
        if name in ("properties", "keys"):
            hidden = {"id", "labels", "eid", "src", "dst", "rel_type"}
            names = [n for n in self.kind_of(args[0], df, local).names if n not in hidden]
            if name == "properties":
                return F.struct(*(got[0].getField(n).alias(n) for n in names))
            return F.array_compact(F.array(*(F.when(got[0].getField(n).isNotNull(), n) for n in names)))
        if name == "point":
            return got[0]
        if name in TYPED:
            return TYPED[name](*got, kinds=[self.kind_of(x, df, local) for x in args])
        if name not in SCALARS:
            raise CypherError(f"unknown function {name}")
        try:
            return SCALARS[name](*got)
        except TypeError as bad:
            raise CypherError(f"{name} doesn't take {len(got)} arguments") from bad

    # Subqueries: what they share with the outer rows are keys of the data, never numbers of rows, which another evaluation could give anew.

    def names_in(self, x) -> set[str]:
        if isinstance(x, (Node, Rel, Path, Match)):
            return ({x.var} if not isinstance(x, Match) and x.var else set()) | {n for y in vars(x).values() for n in self.names_in(y)}
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
            return {x[1]}
        return {n for y in x for n in self.names_in(y)} if isinstance(x, (tuple, list)) else set()

    def keys(self, df: DataFrame, names: list[str]) -> dict[str, Column]:
        out = {}
        for n in names:
            kind, c = df.schema[n].dataType, F.col(f"`{n}`")
            fields = kind.names if isinstance(kind, T.StructType) else []
            out[f"_k_{n}"] = F.struct(c.rel_type, c.eid) if "eid" in fields else c.id if "id" in fields else c
        return out

    def correlated(self, df: DataFrame, m: Match, more=None, unique: bool = True) -> tuple[DataFrame, list[str]]:
        """The matches of ``m`` for what it shares with ``df``, and the columns of their keys."""
        names = sorted(n for n in self.names_in(m) | self.names_in(more) if n in df.columns)
        if not names:
            return self.match(df.sparkSession.range(1).select(F.lit(1).alias("_one")), m), []
        keys = self.keys(df, names)
        base = df.select(*(f"`{n}`" for n in names)).withColumns(keys)
        return self.match(base.dropDuplicates(list(keys)) if unique else base, m), list(keys)

    def on_keys(self, df: DataFrame, found: DataFrame, keys: list[str], how: str) -> DataFrame:
        if not keys:
            return df.join(found, F.lit(True), how)
        mine = self.keys(df, [k.removeprefix("_k_") for k in keys])
        renamed = found.withColumnsRenamed({k: f"{k}_" for k in keys})
        on = [mine[k].eqNullSafe(F.col(f"`{k}_`")) for k in keys]
        return df.join(renamed, on, how).drop(*(f"{k}_" for k in keys))

    def path_nodes(self, df: DataFrame, var: str) -> tuple[DataFrame, tuple]:
        """A column with a path's nodes and their properties."""
        out = self.fresh("nodes")
        ids = df.select(F.col(var).nodes.alias("_ids")).distinct()
        each = ids.select("_ids", F.posexplode("_ids").alias("_pos", "_at")).join(self.entity(self.graph.node_frame(), "_node"), F.col("_at") == F.col("_node.id"))
        got = each.groupBy("_ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_node")), lambda x, y: x._pos - y._pos), lambda x: x._node).alias(out))
        return df.withColumn("_own", F.col(var).nodes).join(got, F.col("_own") == F.col("_ids"), "left").drop("_own", "_ids"), ("col", out)

    # Pattern predicates inside expressions

    def prepare(self, df: DataFrame, e: tuple) -> tuple[DataFrame, tuple]:
        """Replaces pattern predicates, subqueries and comprehensions by columns that joins add."""
        if not isinstance(e, tuple) or not e:
            return df, e
        if e[0] in ("pattern", "exists", "countsub", "patterncomp"):
            m = Match([e[1]], e[2] if e[0] == "patterncomp" else None) if e[0] in ("pattern", "patterncomp") else e[1]
            out = self.fresh("sub")
            found, keys = self.correlated(df, m, e[3] if e[0] == "patterncomp" else None)
            if e[0] == "patterncomp":
                found, value = self.prepare(found, e[3])
                got = found.groupBy(*keys).agg(F.array_sort(F.collect_list(self.expr(value, found))).alias(out))
                empty = F.array().cast(got.schema[out].dataType)
            else:
                got, empty = found.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), F.lit(0)
            df = self.on_keys(df, got, keys, "left").withColumn(out, F.coalesce(out, empty))
            return df, ("col", out) if e[0] in ("patterncomp", "countsub") else (">", ("col", out), ("lit", 0))
        if e[0] == "call" and e[1] in ("startnode", "endnode") and e[3][0][0] == "var" and e[3][0][1] in df.columns:
            out, end = self.fresh("end"), F.col(f"`{e[3][0][1]}`").getField("src" if e[1] == "startnode" else "dst")
            return df.withColumn("_at", end).join(self.entity(self.graph.node_frame(), out), F.col("_at") == F.col(out).id, "left").drop("_at"), ("col", out)
        if e[0] == "call" and e[1] == "size" and e[3][0][0] == "call" and e[3][0][1] == "nodes":
            return df, e
        if e[0] == "call" and e[1] == "nodes" and e[3][0][0] == "var" and e[3][0][1] in df.columns:
            return self.path_nodes(df, f"`{e[3][0][1]}`")
        out = []
        for x in e:
            if isinstance(x, tuple) and x and isinstance(x[0], str):
                df, x = self.prepare(df, x)
            elif isinstance(x, list):
                new = []
                for y in x:
                    if isinstance(y, tuple) and y and isinstance(y[0], str) and e[0] != "map":
                        df, y = self.prepare(df, y)
                    elif isinstance(y, tuple):
                        z = []
                        for w in y:
                            if isinstance(w, tuple):
                                df, w = self.prepare(df, w)
                            z.append(w)
                        y = tuple(z)
                    new.append(y)
                x = new
            out.append(x)
        return df, tuple(out)

    def where(self, df: DataFrame, e: tuple | None) -> DataFrame:
        if e is None:
            return df
        if e[0] == "and":
            return self.where(self.where(df, e[1]), e[2])
        how, inner = ("left_anti", e[1]) if e[0] == "not" else ("left_semi", e)
        if inner[0] in ("pattern", "exists"):
            found, keys = self.correlated(df, Match([inner[1]], None) if inner[0] == "pattern" else inner[1], None, unique=False)
            return self.on_keys(df, found.select(*keys).distinct() if keys else found.select(F.lit(1).alias("_any")).limit(1), keys, how)
        names = df.columns
        df, e = self.prepare(df, e)
        return df.where(self.expr(e, df)).select(*(f"`{n}`" for n in names))

    # Patterns

    def entity(self, frame: DataFrame, var: str) -> DataFrame:
        first = [c for c in ("id", "labels", "eid", "src", "dst", "rel_type") if c in frame.columns]
        return frame.select(F.struct(*first, *(c for c in frame.columns if c not in first)).alias(var))

    def props(self, df: DataFrame, var: str, props: tuple | None) -> DataFrame:
        for k, v in self.entries(props) if props else []:
            df = self.where(df, ("=", ("prop", ("var", var), k), v))
        return df

    def alone(self, props: tuple | None) -> bool:
        """Whether a pattern's properties read no variable, so that they filter its scan."""
        return props is None or not any(self.names_in(v) for _, v in self.entries(props))

    def entries(self, e: tuple) -> list[tuple[str, tuple]]:
        """Keys and values of a map, written out or a parameter."""
        if e[0] == "map":
            return e[1]
        if e[0] == "param" and isinstance(self.params.get(e[1]), dict):
            return [(k, ("lit", v)) for k, v in self.params[e[1]].items()]
        raise CypherError("a map is needed here")

    def scan(self, node: Node, var: str, allowed: list[str] | None = None) -> DataFrame:
        if not node.labels and allowed is not None:
            frame = self.graph.node_frame(some=allowed)
        else:
            frame = self.graph.node_frame(node.labels or None)
        return self.entity(frame, var)

    def match(self, df: DataFrame | None, m: Match) -> DataFrame:
        rels: list[tuple[str, Rel, bool]] = []
        for path in m.paths:
            df = self.path(df, path, rels)
        for i, (a, ra, many_a) in enumerate(rels):  # no relationship twice in one MATCH
            for b, rb, many_b in rels[:i]:
                if a == b or (ra.types and rb.types and not set(ra.types) & set(rb.types)):
                    continue
                ids = [F.transform(F.col(v), lambda r: F.struct(r.rel_type, r.eid)) if many else F.array(F.struct(F.col(v).rel_type, F.col(v).eid)) for v, many in ((a, many_a), (b, many_b))]
                df = df.where(~F.arrays_overlap(*ids) if many_a or many_b else ~((F.col(a).eid == F.col(b).eid) & (F.col(a).rel_type == F.col(b).rel_type)))
        return self.where(df, m.where)

    def path(self, df: DataFrame | None, path: Path, rels: list) -> DataFrame:
        nodes, links = path.items[::2], path.items[1::2]
        names = [n.var or self.fresh("n") for n in nodes]
        known = [i for i, n in enumerate(names) if df is not None and n in df.columns]
        start = known[0] if known else 0
        if known:
            df = self.check(df, nodes[start], names[start])
        else:
            alone = self.alone(nodes[0].props)
            first = self.props(self.scan(nodes[0], names[0]), names[0], nodes[0].props if alone else None)
            df = first if df is None else df.crossJoin(first)
            df = df if alone else self.props(df, names[0], nodes[0].props)
        link_names = [r.var or self.fresh("r") for r in links]
        steps = [(i, i + 1, True) for i in range(start, len(links))] + [(i + 1, i, False) for i in range(start - 1, -1, -1)]
        for a, b, ahead in steps:
            r = links[min(a, b)]
            df = self.expand(df, names[a], r, link_names[min(a, b)], nodes[b], names[b], r.way if ahead else {"out": "in", "in": "out", "both": "both"}[r.way], path.var is not None)
            rels.append((link_names[min(a, b)], r, r.span is not None))
        if path.var:
            edges = [F.col(n) if r.span else F.array(F.col(n)) for n, r in zip(link_names, links)]
            slim = lambda c: F.struct(c.rel_type.alias("rel_type"), c.eid.alias("eid"), c.src.alias("src"), c.dst.alias("dst"))
            joined = F.concat(*(F.transform(x, slim) for x in edges)) if edges else F.array()
            step = lambda at, r: F.array_append(at, F.when(r.src == F.element_at(at, -1), r.dst).otherwise(r.src))
            ids = F.aggregate(joined, F.array(F.col(names[0]).id), step) if edges else F.array(F.col(names[0]).id)
            df = df.withColumn(path.var, F.struct(ids.alias("nodes"), joined.alias("rels")))
        return df

    def check(self, df: DataFrame, node: Node, var: str) -> DataFrame:
        if node.labels:
            df = df.where(self.expr(("haslabel", ("var", var), node.labels), df))
        return self.props(df, var, node.props)

    def expand(self, df: DataFrame, here: str, rel: Rel, rvar: str, node: Node, there: str, way: str, whole: bool) -> DataFrame:
        frame = self.graph.edge_frame(rel.types or None)
        own = self.alone(rel.props)
        if not own and rel.span is not None:
            raise CypherError("properties of a variable-length relationship read no variables")
        edges = self.props(self.entity(frame, rvar), rvar, rel.props if own else None)
        out = edges.select(F.col(rvar), F.col(rvar).src.alias("_from"), F.col(rvar).dst.alias("_to"))
        back = edges.select(F.col(rvar), F.col(rvar).dst.alias("_from"), F.col(rvar).src.alias("_to"))
        moves = out if way == "out" else back if way == "in" else out.unionByName(back.where("_from <> _to"))
        if rel.span is None:
            if rvar in df.columns:
                same = moves.withColumnRenamed(rvar, "_again")
                df = df.join(same, (F.col(here).id == F.col("_from")) & (F.col(rvar).eid == F.col("_again").eid) & (F.col(rvar).rel_type == F.col("_again").rel_type)).drop("_again")
            else:
                df = df.join(moves, F.col(here).id == F.col("_from"))
            df = df.drop("_from")
            df = df if own else self.props(df, rvar, rel.props)
        else:
            df = self.walk(df, here, rvar, moves, *rel.span)
        if there in df.columns:
            return self.check(df.where(F.col(there).id == F.col("_to")).drop("_to"), node, there)
        allowed = self.graph.far_labels(rel.types or None, way == "out") if way != "both" else None
        if node.var is None and not node.props and (not node.labels or allowed == node.labels):
            return df.withColumn(there, F.struct(F.col("_to").alias("id"))).drop("_to")  # nothing of the node is read
        own = self.alone(node.props)
        far = self.props(self.scan(node, there, allowed), there, node.props if own else None)
        df = df.join(far, F.col("_to") == F.col(there).id).drop("_to")
        return df if own else self.props(df, there, node.props)

    def walk(self, df: DataFrame, here: str, rvar: str, moves: DataFrame, low: int, high: int | None) -> DataFrame:
        """Walks without a repeated relationship: a frontier loop; open ends stop at an empty frontier."""
        moves = moves.withColumnRenamed(rvar, "_edge")
        kind = moves.schema["_edge"].dataType
        front = df.withColumn(rvar, F.array().cast(T.ArrayType(kind))).withColumn("_to", F.col(here).id)
        found = [front] if low == 0 else []
        for hop in range(1, (high if high is not None else self.max_hops) + 1):
            step = front.withColumnRenamed("_to", "_at").join(moves, F.col("_at") == F.col("_from"))
            fresh = ~F.exists(F.col(rvar), lambda r: (r.eid == F.col("_edge").eid) & (r.rel_type == F.col("_edge").rel_type))
            front = step.where(fresh).withColumn(rvar, F.array_append(F.col(rvar), F.col("_edge"))).select(*df.columns, rvar, "_to")
            if high is None:
                front = cut(front)
                if front.isEmpty():
                    break
            if hop >= low:
                found.append(front)
        else:
            if high is None:
                raise CypherError(f"an open path is longer than {self.max_hops} hops")
        return union(found) if found else front.limit(0)

    # Clauses

    def optional(self, df: DataFrame, m: Match) -> DataFrame:
        found, keys = self.correlated(df, m)
        new = [c for c in found.columns if c not in df.columns and not c.startswith("_")]
        return self.on_keys(df, found.select(*(f"`{k}`" for k in keys), *(f"`{c}`" for c in new)), keys, "left")

    def project(self, df: DataFrame, p: Project) -> DataFrame:
        items = list(p.items)
        if p.star:
            items = [Item(("var", c), c) for c in df.columns if not c.startswith("_")] + items
        if p.final is False and any(not i.aliased and i.expr[0] != "var" for i in p.items):
            raise CypherError("expressions in WITH need an alias")
        exprs = []
        for i in items:
            df, e = self.prepare(df, i.expr)
            exprs.append(e)
        by_name, by_expr = {i.name: i.name for i in items}, {repr(i.expr): i.name for i in items}
        order, extra = [], []
        for e, down in p.order:
            name = by_name.get(e[1]) if e[0] == "var" else by_expr.get(repr(e))
            if name is None:
                name = self.fresh("key")
                extra.append((name, self.on_items(e, {i.name: x for i, x in zip(items, exprs)})))
            order.append((name, down))
        rows = list(zip([i.name for i in items], exprs)) + extra
        if any(has_aggregate(e) for _, e in rows):
            df = self.grouped(df, rows)
        else:
            df = df.select(*(self.expr(e, df).alias(n) for n, e in rows))
        if p.distinct:
            df = df.distinct() if not extra else df.dropDuplicates([i.name for i in items])
        if order:
            df = df.orderBy(*(F.desc_nulls_first(f"`{n}`") if down else F.asc_nulls_last(f"`{n}`") for n, down in order))
        if p.skip is not None:
            df = df.offset(self.number(p.skip, df))
        if p.limit is not None:
            df = df.limit(self.number(p.limit, df))
        df = df.select(*(f"`{i.name}`" for i in items)) if extra else df
        return self.where(df, p.where)

    def on_items(self, e, names: dict):
        """A sort expression with the projection's aliases replaced by what they stand for."""
        if isinstance(e, tuple):
            return names[e[1]] if e and e[0] == "var" and e[1] in names else tuple(self.on_items(x, names) for x in e)
        return [self.on_items(x, names) for x in e] if isinstance(e, list) else e

    def number(self, e: tuple, df: DataFrame) -> int:
        one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
        v = e[1] if e[0] == "lit" else self.params.get(e[1]) if e[0] == "param" else one.select(self.expr(e, one)).first()[0]
        if not isinstance(v, int) or v < 0:
            raise CypherError("SKIP and LIMIT take a whole number, 0 or more")
        return v

    def grouped(self, df: DataFrame, rows: list[tuple[str, tuple]]) -> DataFrame:
        """Items without aggregates are the keys; aggregates inside expressions are computed first."""
        keys = [(n, e) for n, e in rows if not has_aggregate(e)]
        known = {repr(e): ("col", f"`{n}`") for n, e in keys}
        found: list[tuple[str, Column]] = []
        given: dict[str, Column] = {}

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "call" and e[1] in AGGREGATES:
                name = self.fresh("agg")
                counted = self.counted_percentile(e, df, given)
                found.append((name, self.expr(e, df) if counted is None else counted))
                return ("col", name)
            if isinstance(e, tuple) and repr(e) in known:
                return known[repr(e)]
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            return [lift(x) for x in e] if isinstance(e, list) else e

        lifted = [(n, lift(e) if has_aggregate(e) else ("col", f"`{n}`")) for n, e in rows]
        out = df.withColumns(given).groupBy(*(self.expr(e, df).alias(n) for n, e in keys)).agg(*(c.alias(n) for n, c in found))
        return out.select(*(self.expr(e, out).alias(n) for n, e in lifted))

    def counted_percentile(self, e: tuple, df: DataFrame, given: dict[str, Column]) -> Column | None:
        """percentileDisc as Spark's own, which counts distinct values before the shuffle; None where its doubles or a fraction of the data don't fit."""
        name, distinct, args = e[1:]
        if name != "percentiledisc" or distinct or len(args) != 2 or args[1][0] != "lit" or type(args[1][1]) not in (int, float) or not 0 <= args[1][1] <= 1:
            return None
        kind = self.kind_of(args[0], df, {})
        if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)):
            return None
        column = self.fresh("value")
        given[column] = self.expr(args[0], df)
        return F.expr(f"percentile_disc({float(args[1][1])!r}D) WITHIN GROUP (ORDER BY `{column}`)").cast(kind)

    def procedure(self, df: DataFrame | None, c: Call) -> DataFrame:
        p = self.procedures.get(c.name)
        if p is None:
            raise CypherError(f"unknown procedure {c.name}")
        if len(c.args) != len(p.inputs):
            raise CypherError(f"{c.name} takes {len(p.inputs)} arguments")
        base = df if df is not None else p.rows.sparkSession.range(1).select(F.lit(1).alias("_one"))
        names = [self.fresh("in") for _ in p.inputs]
        rows = p.rows.select(*(F.col(i).alias(n) for i, n in zip(p.inputs, names)), *(F.col(o).alias(a) for o, a in (c.yields or [(o, o) for o in p.outputs])))
        on = F.lit(True)
        for n, e in zip(names, c.args):
            on = on & (F.col(n) == self.expr(e, base))
        return (base.join(rows, on) if names else base.crossJoin(rows)).drop(*names)

    def unwind(self, df: DataFrame, c: Unwind) -> DataFrame:
        df, e = self.prepare(df, c.expr)
        if isinstance(self.kind_of(e, df, {}), T.NullType):
            return df.withColumn(c.var, F.lit(None)).limit(0)
        self.element(e, df, {})
        return df.withColumn(c.var, F.explode(self.expr(e, df)))

    def clause(self, df: DataFrame | None, c, spark) -> DataFrame:
        one = spark.range(1).select(F.lit(1).alias("_one"))
        if df is None and not isinstance(c, (Match, Call)):
            df = one
        if isinstance(c, Match):
            return self.match(df, c) if not c.optional else self.optional(df if df is not None else one, c)
        if isinstance(c, Unwind):
            return self.unwind(df, c)
        if isinstance(c, Call):
            return self.procedure(df, c)
        return self.project(df, c)

    def triangles(self, clauses: list) -> DataFrame | None:
        """count(*) of a->b->c with a->c, where the type joins all members of sets in the order of their ids: the triangles, counted without making rows of wedges."""
        if len(clauses) != 2 or not isinstance(clauses[0], Match) or not isinstance(clauses[1], Project):
            return None
        m, p = clauses
        nodes, rels, links = [], [], []
        for path in m.paths:
            ends = path.items[::2]
            nodes, rels = nodes + ends, rels + path.items[1::2]
            links += [(a.var, b.var) if r.way == "out" else (b.var, a.var) for a, r, b in zip(ends, path.items[1::2], ends[1:])]
        names, types = {n.var for n in nodes}, {tuple(r.types) for r in rels}
        plain = m.where is None and not m.optional and not any(path.var for path in m.paths) and all(n.var and n.props is None for n in nodes) and all(r.var is None and r.props is None and r.span is None and r.way != "both" for r in rels)
        counted = p.final and len(p.items) == 1 and p.items[0].expr == ("call", "count", False, [("star",)]) and not (p.star or p.distinct or p.order or p.skip or p.limit or p.where)
        shape = len(names) == len(rels) == len(set(links)) == 3 and sorted(sum(a == v for a, _ in links) for v in names) == [0, 1, 2] and all(a != b for a, b in links)
        if not (plain and counted and shape and len(types) == 1 and len(kind := next(iter(types))) == 1):
            return None
        for label, via in self.graph.sets:
            only = frozenset([label])
            if via == kind[0] and self.graph.ends.get(via) == (only, only) and all(set(n.labels) <= only for n in nodes):
                from sparkloom.algo.native import triangle_count

                return triangle_count(*self.graph.projection(label, via)).withColumnRenamed("triangles", p.items[0].name)
        return None

    def single(self, clauses: list, spark) -> DataFrame:
        found = self.triangles(clauses)
        if found is not None:
            return found
        df: DataFrame | None = None
        for c in clauses:
            df = self.clause(df, c, spark)
        if not isinstance(clauses[-1], Project) or not clauses[-1].final:
            raise CypherError("a query ends with RETURN")
        return df


WRITES = (Create, Merge, Change, Delete)


def execute(graph: PropertyGraph, query: str, params: dict | None = None, procedures: dict[str, Procedure] | None = None, max_hops: int = 30) -> DataFrame:
    """The query's result, as a lazy DataFrame (open-ended patterns run their frontier loop at once)."""
    spark = next(iter(graph.nodes.values())).sparkSession
    low = Lowering(graph, params or {}, procedures or {}, max_hops)
    out, every = None, True
    for clauses, all_ in Parser(query).query():
        if any(isinstance(c, WRITES) for c in clauses):
            raise CypherError("a query that writes goes through run()")
        part = low.single(clauses, spark)
        every = every and (out is None or all_)
        out = part if out is None else out.unionByName(part)
    return out if every else out.distinct()
