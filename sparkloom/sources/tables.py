"""A property graph over the star-schema tables, and Parquet graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.graph import Lazy, PropertyGraph

#: Label of each table: (code, table, key, properties). A node's id is key * 16 + code.
LABELS = {
    "Region": (0, "region", "r_regionkey", {"name": "r_name"}),
    "Nation": (1, "nation", "n_nationkey", {"name": "n_name"}),
    "Customer": (2, "customer", "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "Supplier": (3, "supplier", "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal"}),
    "Part": (4, "part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
    "Order": (5, "orders", "o_orderkey", {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}),
}


def node_id(label: str, key: str) -> Column:
    return F.col(key).cast("long") * 16 + LABELS[label][0]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of this quantity or more are bulk purchases, whose pairs are the relationship CO_BULK.
BULK = 45


def co_buy(lineitem: DataFrame, least: int = 0) -> DataFrame:
    """src < dst: parts bought in one order, both in lines of ``least`` or more; distinct."""
    line = (lineitem.where(F.col("l_quantity") >= least) if least else lineitem).select("l_orderkey", "l_partkey").distinct()
    pairs = line.select("l_orderkey", F.col("l_partkey").alias("a")).join(line.select("l_orderkey", F.col("l_partkey").alias("b")), "l_orderkey").where("a < b")
    return pairs.select(node_id("Part", "a").alias("src"), node_id("Part", "b").alias("dst")).distinct()


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    tables: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = read(spark, sf_dir, name)
        return tables[name]

    def node(label: str) -> DataFrame:
        _, name, key, props = LABELS[label]
        return table(name).select(node_id(label, key).alias("id"), F.col(key).cast("long").alias("key"), *(F.col(c).alias(p) for p, c in props.items()))

    def edge(name: str, a: str, ak: str, b: str, bk: str, *props) -> DataFrame:
        return table(name).select(F.monotonically_increasing_id().alias("eid"), node_id(a, ak).alias("src"), node_id(b, bk).alias("dst"), *props)

    def orders(least: int = 0) -> DataFrame:
        """Parts by order, of lines of ``least`` or more: those that the table of parts has."""
        lines = table("lineitem").where(F.col("l_quantity") >= least) if least else table("lineitem")
        lines = lines.select(F.col("l_orderkey").cast("long").alias("o"), node_id("Part", "l_partkey").alias("id")).where("o IS NOT NULL AND id IS NOT NULL")
        strange = lines.select("id").distinct().join(node("Part").select("id"), "id", "left_anti")
        return lines.join(strange, "id", "left_anti") if strange.limit(1).count() else lines

    hashed = lambda df: df.select(F.xxhash64("src", "dst").alias("eid"), "src", "dst")
    edges = {
        "IN_REGION": lambda: edge("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
        "IN_NATION": lambda: edge("customer", "Customer", "c_custkey", "Nation", "c_nationkey").unionByName(edge("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey").withColumn("eid", F.col("eid") + (1 << 60))),
        "PLACED": lambda: edge("orders", "Customer", "o_custkey", "Order", "o_orderkey"),
        "CONTAINS": lambda: edge("lineitem", "Order", "l_orderkey", "Part", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice")),
        "FULFILLED_BY": lambda: edge("lineitem", "Order", "l_orderkey", "Supplier", "l_suppkey"),
        "SUPPLIES": lambda: hashed(table("lineitem").select(node_id("Supplier", "l_suppkey").alias("src"), node_id("Part", "l_partkey").alias("dst")).distinct()),
        "CO_BUY": lambda: hashed(co_buy(table("lineitem"))),
        "CO_BULK": lambda: hashed(co_buy(table("lineitem"), BULK)),
    }
    one = lambda *x: frozenset(x)
    ends = {
        "IN_REGION": (one("Nation"), one("Region")), "IN_NATION": (one("Customer", "Supplier"), one("Nation")), "PLACED": (one("Customer"), one("Order")),
        "CONTAINS": (one("Order"), one("Part")), "FULFILLED_BY": (one("Order"), one("Supplier")), "SUPPLIES": (one("Supplier"), one("Part")), "CO_BUY": (one("Part"), one("Part")), "CO_BULK": (one("Part"), one("Part")),
    }
    return PropertyGraph(Lazy({label: (lambda label=label: node(label)) for label in LABELS}), Lazy(edges), ends, {("Part", "CO_BUY"): orders, ("Part", "CO_BULK"): lambda: orders(BULK)})


def save_graph(graph: PropertyGraph, folder: str) -> None:
    for kind, frames in (("nodes", graph.nodes), ("edges", graph.edges)):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{folder}/{kind}/{name}")


def load_graph(spark: SparkSession, folder: str, labels: list[str], types: list[str]) -> PropertyGraph:
    return PropertyGraph({n: spark.read.parquet(f"{folder}/nodes/{n}") for n in labels}, {t: spark.read.parquet(f"{folder}/edges/{t}") for t in types})
