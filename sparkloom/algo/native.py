"""Algorithms as joins, aggregations and checkpointed loops. ``n``: nodes (id); ``e``: edges (eid, src, dst, properties)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.algo import packed
from sparkloom.llm import scratch
from sparkloom.plans.lineage import cut


def both(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).where("src <> dst"))


def simple(e: DataFrame) -> DataFrame:
    """Undirected without loops or parallels, src < dst."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def neighbours(e: DataFrame, directed: bool) -> DataFrame:
    """Distinct (u, v), v a neighbour of u, without loops."""
    return (e if directed else both(e)).where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()


def scored(n: DataFrame, part: DataFrame, key: str = "u", score: str = "score", none: float = 0.0) -> DataFrame:
    return n.join(part, n.id == part[key], "left").select("id", F.coalesce(F.col(score).cast("double"), F.lit(none)).alias("score"))


def degree(n, e, directed):
    size = F.broadcast(n.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("_n")))
    part = (e if directed else both(e)).groupBy(F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("k")).crossJoin(size).select("u", (F.col("k") / F.col("_n")).alias("score"))
    return scored(n, part)


def wedges(e: DataFrame, weight: str = "one"):
    """Undirected: u with its degree k, near and base (``packed.oriented``); u with its triangles t and the sum s of their other corners' weights."""
    p = packed.lists(e)
    rows = packed.oriented(p, weight)
    scratch.drop(p.rows)
    return packed.nodes_of(rows).withColumnRenamed("id", "u"), packed.triangles(rows, p.bounds, weight).withColumnRenamed("id", "u")


def triangle_count(n, e):
    return wedges(e)[1].agg(F.expr("coalesce(sum(t), 0) div 3").alias("triangles"))


def triangles(n, e, directed):
    return scored(n, wedges(e)[1], score="t")


def clustering(n, e, directed):
    if directed:
        a = e.where("src <> dst").select("src", "dst").distinct()
        sym = a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
        sym = cut(sym)
        x, y, z = (sym.select(F.col("src").alias(p), F.col("dst").alias(q), F.col("w").alias(f"w{p}")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))
        tri = x.join(y, "b").where("a <> c").join(z, ["c", "a"]).groupBy("a").agg(F.sum(F.col("wa") * F.col("wb") * F.col("wc")).alias("t"))
        k = sym.groupBy("src").agg(F.sum("w").alias("k"), F.sum(F.expr("if(w = 2, 1, 0)")).alias("r"))
        part = k.join(tri, k.src == tri.a, "left").select(F.col("src").alias("u"), F.try_divide(F.coalesce("t", F.lit(0)), 2 * (F.col("k") * (F.col("k") - 1) - 2 * F.col("r"))).alias("score"))
        return scored(n, part)
    nodes, closed = wedges(e)
    part = nodes.join(closed, "u", "left").select("u", F.try_divide(2 * F.coalesce("t", F.lit(0)), F.col("k") * (F.col("k") - 1)).alias("score"))
    return scored(n, part)


def k_core(n, e, directed):
    """Core numbers: each round a node takes the h-index of its neighbours' values, starting from degrees."""
    return scored(n, packed.core_numbers(packed.lists(e)), score="c")


def preferential_attachment(n, e, directed):
    a = neighbours(e, directed)
    d = cut(a.groupBy("u").agg(F.count(F.lit(1)).alias("d")))
    total = F.broadcast(d.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("t")))
    near = a.join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v", "left").groupBy("u").agg(F.coalesce(F.sum("dv"), F.lit(0)).alias("s"))
    return scored(n, d.join(near, "u").crossJoin(total).select("u", (F.col("d") * (F.col("t") - F.col("d") - F.col("s"))).alias("score")))


def _common(e, directed, weight: str):
    """u and the sum of x(k) over the common neighbours w of u and every v not linked from u. Undirected, a neighbour w of u is common to all of its other
    neighbours but those that close a triangle with u and w, so no pairs are made, only triangles."""
    if not directed:
        nodes, closed = wedges(e, weight)
        return nodes.join(closed, "u", "left").select("u", "k", "near", (F.col("base") - F.coalesce("s", F.lit(0.0))).alias("score"))
    x = {"one": lambda k: F.lit(1), "log": lambda k: F.when(k > 1, 1 / F.log(k.cast("double"))).otherwise(0.0), "inverse": lambda k: 1 / k}[weight]
    a = cut(neighbours(e, directed))
    w = a.groupBy(F.col("v").alias("w")).agg(F.count(F.lit(1)).alias("k")).withColumn("x", x(F.col("k")))
    pairs = a.select("u", F.col("v").alias("w")).join(a.select(F.col("u").alias("t"), F.col("v").alias("w")), "w").where("u <> t").join(w.select("w", "x"), "w").groupBy("u", "t").agg(F.sum("x").alias("x"))
    score = pairs.join(a.select("u", F.col("v").alias("t")), ["u", "t"], "left_anti").groupBy("u").agg(F.sum("x").alias("score"))
    d = cut(a.groupBy("u").agg(F.count(F.lit(1)).alias("k")))
    near = a.join(d.select(F.col("u").alias("v"), F.col("k").alias("dv")), "v", "left").groupBy("u").agg(F.coalesce(F.sum("dv"), F.lit(0)).alias("near"))
    return d.join(near, "u").join(score, "u", "left")


def common_neighbors(n, e, directed):
    return scored(n, _common(e, directed, "one"))


def adamic_adar(n, e, directed):
    return scored(n, _common(e, directed, "log"))


def resource_allocation(n, e, directed):
    return scored(n, _common(e, directed, "inverse"))


def total_neighbors(n, e, directed):
    """Sum of |N(u) or N(v)| over v not linked: degrees' sums less common neighbours."""
    of = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    d = cut(n.join(_common(e, directed, "one"), n.id == F.col("u"), "left").select("id", of("k"), of("near"), of("score")))
    total = F.broadcast(d.agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("t")))
    return d.crossJoin(total).select("id", (F.col("k") * (F.col("c") - 1 - F.col("k")) + F.col("t") - F.col("k") - F.col("near") - F.col("score")).cast("double").alias("score"))


def _power(n, step, start, done, most, every=5):
    x = cut(start)
    for i in range(1, most + 1):
        new = step(x)
        x = cut(new) if done or i % every == 0 else new
        if done and done(x):
            break
    return x.select("id", "score")


def pagerank(n, e, directed, damping: float = 0.85, tolerance: float = 1e-10, most: int = 100):
    a = cut((e if directed else both(e)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    out = a.groupBy("src").agg(F.sum("w").alias("k"))
    n = cut(n.join(out, n.id == out.src, "left").select("id", "k"))
    size = n.count()

    def step(x):
        x = x.select("id", "score")
        gone = F.broadcast(x.join(n, "id").where("k IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("g")))
        sent = a.join(x.join(n, "id").select(F.col("id").alias("src"), (F.col("score") / F.col("k")).alias("s")), "src").groupBy("dst").agg(F.sum(F.col("s") * F.col("w")).alias("got"))
        new = x.join(sent, x.id == sent.dst, "left").crossJoin(gone)
        return new.select("id", ((1 - damping) / size + damping * (F.coalesce("got", F.lit(0.0)) + F.col("g") / size)).alias("score"), F.col("score").alias("old"))

    done = lambda x: (x.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) <= size * tolerance
    return _power(n, step, n.select("id", F.lit(1.0 / max(1, size)).alias("score")), done, most)


def _norm(x):
    total = F.broadcast(x.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("z")))
    return x.crossJoin(total).withColumn("score", F.when(F.col("z") > 0, F.col("score") / F.col("z")).otherwise(0.0)).drop("z")


def eigenvector(n, e, directed):
    a, size = cut((e if directed else both(e)).select("src", "dst")), n.count()

    def step(x):
        x = x.select("id", "score")
        got = a.join(x, a.src == x.id).groupBy("dst").agg(F.sum("score").alias("got"))
        return _norm(x.join(got, x.id == got.dst, "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old")))

    seen = [0]

    def done(x):
        seen[0] += 1
        return seen[0] >= 2 and (x.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) <= 1e-7

    return _power(n, step, n.select("id", F.lit(1.0 / max(1, size)).alias("score")), done, 20)


def article_rank(n, e, directed):
    a = cut((e if directed else both(e)).select("src", "dst"))
    n = cut(n.join(a.groupBy("src").agg(F.count(F.lit(1)).alias("k")), n.id == F.col("src"), "left").select("id", F.coalesce("k", F.lit(0)).alias("k")))
    mean = n.agg(F.avg("k")).first()[0] or 0.0

    def step(x):
        sent = a.join(x.join(n, "id").select(F.col("id").alias("src"), F.try_divide("delta", F.col("k") + mean).alias("m")), "src").groupBy("dst").agg(F.sum("m").alias("m"))
        return x.join(sent, x.id == sent.dst, "left").select("id", (0.85 * F.coalesce("m", F.lit(0.0))).alias("delta"), "score").withColumn("score", F.col("score") + F.col("delta"))

    return _power(n, step, n.select("id", F.lit(0.15).alias("delta"), F.lit(0.15).alias("score")), lambda x: (x.agg(F.max("delta")).first()[0] or 0.0) <= 1e-7, 20)


def _hits(n, e, directed, hub):
    part = packed.hits(e if directed else both(e), 40 if hub else 39)
    return _norm(scored(n, part))


def components(n, e, directed=False):
    """id, community_id: numbered by the smallest node."""
    return numbered(roots(n, e))


def roots(n, e):
    """id, l: the smallest node of its component. Large and small stars in turn: a logarithmic number of rounds."""
    links = cut(simple(e).select(F.col("dst").alias("u"), F.col("src").alias("v")))  # u > v

    def star(pairs, large):
        both_ = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both_.join(least, "u")
        moved = (out.where("v > u") if large else out).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return (moved if large else moved.unionByName(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()

    mark = None
    while True:
        links = cut(star(star(links, True), False))
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now.n:
            return n.join(links, n.id == links.u, "left").select("id", F.coalesce("v", "id").alias("l"))
        mark = now


def numbered(lab: DataFrame) -> DataFrame:
    """Communities numbered by their smallest node: places within ranges, after what the ranges before hold, so no task orders all of them."""
    first = cut(lab.groupBy("l").agg(F.min("id").alias("f")).repartitionByRange("f").withColumn("_part", F.spark_partition_id()))
    before = first.groupBy("_part").agg(F.count(F.lit(1)).alias("k"))
    before = before.select("_part", (F.sum("k").over(Window.orderBy("_part")) - F.col("k")).alias("base"))  # a row a partition
    ids = first.join(F.broadcast(before), "_part").withColumn("community_id", F.col("base") + F.row_number().over(Window.partitionBy("_part").orderBy("f")) - 1)
    return lab.join(ids.select("l", "community_id"), "l").select("id", "community_id")


def strongly_connected(n, e, directed=True):
    """Forward-backward colouring: the largest id that reaches a node colours it; a colour's root gathers its component backwards."""
    if not directed:
        return components(n, e)
    left, out, edges = cut(n.select("id")), None, cut(e.select("src", "dst").distinct())
    while left.limit(1).count():
        col = left.select("id", F.col("id").alias("c"))
        while True:
            got = edges.join(col.select(F.col("id").alias("src"), "c"), "src").groupBy("dst").agg(F.max("c").alias("m"))
            new = cut(col.join(got, col.id == got.dst, "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("o")))
            col = new.select("id", "c")
            if not new.where("c <> o").limit(1).count():
                break
        found = col.where("id = c")
        inner = cut(edges.join(col.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(col.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        front = found
        while True:
            front = cut(inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "c").distinct().join(found, "id", "left_anti"))
            if not front.limit(1).count():
                break
            found = cut(found.unionByName(front))
        out = found if out is None else cut(out.unionByName(found))
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return numbered(out.select("id", F.col("c").alias("l"))) if out is not None else n.select("id", F.lit(0).cast("long").alias("community_id"))


def node_similarity(n, e, k: int = 10, filtered: bool = False):
    """id1, id2, similarity: Jaccard of out-neighbour sets, best k for each node."""
    if filtered:
        p = packed.lists(e, both=False, loops=True)
        return best(packed.shared(p, k), k)
    a = cut(e.select(F.col("src").alias("u"), F.col("dst").alias("w")).distinct())
    d = a.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    pairs = a.join(a.withColumnRenamed("u", "v"), "w").where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"))
    s = pairs.join(d, "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").select("u", "v", (F.col("c") / (F.col("d") + F.col("dv") - F.col("c"))).alias("similarity"))
    return best(s.select(F.col("u").alias("id1"), F.col("v").alias("id2"), "similarity"), k)


def best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id1").orderBy(F.desc("similarity"), "id2")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def bfs(n, e, source: int, directed=True):
    """target, hops from ``source``, itself left out."""
    a = cut((e if directed else both(e)).select("src", "dst").distinct())
    seen = front = cut(n.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("hops")))
    hop = 0
    while front.limit(1).count():
        hop += 1
        front = cut(a.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).cast("long").alias("hops")))
        seen = cut(seen.unionByName(front))
    return seen.where("hops > 0").select(F.col("id").alias("target"), "hops")


def shortest(n, e, source: int | None = None, weight: str | None = None, directed=True, negative=False, target: int | None = None):
    """source, target, cost, path (ids, joined by commas) from one node, or from every node; ties go to fewer hops, then to the smaller path. Relaxation of
    what changed, round by round; costs that still fall after as many rounds as nodes are a negative cycle, an error."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a = e.select("src", "dst", w.alias("w"))
    a = a if directed else a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    a = cut(a.groupBy("src", "dst").agg(F.min("w").alias("w")))
    if not negative and a.where("w < 0 OR w IS NULL OR isnan(w)").limit(1).count():
        raise ValueError("weights have to be 0 or more")
    start = n if source is None else n.where(F.col("id") == source)
    best = front = cut(start.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("cost"), F.array("id").alias("path")))
    for _ in range(n.count() + 1):
        step = front.select("source", F.col("id").alias("src"), F.col("cost").alias("c"), "path").join(a, "src")
        step = step.groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct((F.col("c") + F.col("w")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))).alias("new"))
        old = best.select("source", "id", F.col("cost").alias("held"))
        front = cut(step.join(old, ["source", "id"], "left").where("held IS NULL OR new.cost < held").select("source", "id", "new.cost", "new.path"))
        if not front.limit(1).count():
            out = best.where(F.col("id") != F.col("source")).select("source", F.col("id").alias("target"), "cost", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))
            return out if target is None else out.where(F.col("target") == target)
        best = cut(best.join(front.select("source", "id"), ["source", "id"], "left_anti").unionByName(front))
    raise ValueError("a negative cycle is reachable")


def transitive_closure(n, e, directed=True):
    """source, target: reachable pairs of positive length, semi-naive."""
    a = cut((e if directed else both(e)).select("src", "dst").distinct())
    seen = front = cut(a.select(F.col("src").alias("source"), F.col("dst").alias("target")))
    while front.limit(1).count():
        step = front.join(a.withColumnRenamed("dst", "_far"), F.col("target") == F.col("src"))
        front = cut(step.select("source", F.col("_far").alias("target")).distinct().join(seen, ["source", "target"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def random_walk(n, e, source: int, walks: int = 1, length: int = 10, seed: int = 0):
    """walk, step, id: each step picks the out-edge of lowest hash of (seed, walk, step, edge); dead ends stop."""
    a = cut(e.select("eid", "src", "dst"))
    at = n.where(F.col("id") == source).select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), F.lit(0).alias("step"), "id")
    out = at = cut(at)
    for s in range(1, length + 1):
        key = F.struct(F.xxhash64(F.lit(seed), "walk", F.lit(s), "eid"), "dst")
        at = cut(at.join(a, at.id == a.src).groupBy("walk").agg(F.min(key).alias("k")).select("walk", F.lit(s).alias("step"), F.col("k.dst").alias("id")))
        out = out.unionByName(at)
    return out


def transitivity(n, e, directed=False):
    nodes, closed = wedges(e)
    t = closed.agg(F.expr("coalesce(sum(t), 0) div 3").alias("t"))
    w = nodes.agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("w"))
    return t.crossJoin(w).select(F.coalesce(F.try_divide(3.0 * F.col("t"), F.col("w")), F.lit(0.0)).alias("transitivity"))


def dyad_census(n, e, directed=True):
    a = e.where("src <> dst").select("src", "dst").distinct()
    p = a.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") == 2).alias("m"), F.count_if(F.col("k") == 1).alias("a"))
    c = n.agg(F.count(F.lit(1)).alias("n")).crossJoin(p)
    return c.select(F.expr("stack(3, 'mutual', m, 'asymmetric', a, 'null', n * (n - 1) div 2 - m - a) AS (dyad, count)"))


def modularity(n, e, part: DataFrame, weight: str | None = None):
    """Of a partition (id, community_id): Newman-Girvan, resolution 1; a loop counts twice in a degree."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a = e.select("src", "dst", w.alias("w"))
    c = lambda x: part.select(F.col("id").alias(x), F.col("community_id").alias(f"c{x}"))
    a = a.join(c("src"), "src").join(c("dst"), "dst")
    inner = a.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("csrc") == F.col("cdst"), F.col("w")).otherwise(0.0)).alias("i"))
    d = a.select(F.col("csrc").alias("c"), "w").unionByName(a.select(F.col("cdst").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inner.crossJoin(d).select((F.col("i") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def conductance(n, e, part: DataFrame, weight: str | None = None):
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    c = lambda x: part.select(F.col("id").alias(x), F.col("community_id").alias(f"c{x}"))
    a = e.select("src", "dst", w.alias("w")).join(c("src"), "src").join(c("dst"), "dst")
    ends = a.select(F.col("csrc").alias("community_id"), "w", (F.col("csrc") != F.col("cdst")).alias("x")).unionByName(a.select(F.col("cdst").alias("community_id"), "w", (F.col("csrc") != F.col("cdst")).alias("x")))
    v = ends.groupBy("community_id").agg(F.sum("w").alias("v"), F.sum(F.when(F.col("x"), F.col("w")).otherwise(0.0)).alias("cut"))
    total = F.broadcast(v.agg(F.sum("v").alias("t")))
    v = part.select("community_id").distinct().join(v, "community_id", "left").crossJoin(total)
    return v.select("community_id", F.coalesce(F.try_divide("cut", F.least(F.col("v"), F.col("t") - F.col("v"))), F.lit(0.0)).alias("conductance"))


def is_dag(n, e, directed=True):
    spark = n.sparkSession
    if not directed:
        return spark.createDataFrame([(False,)], "is_dag boolean")
    a = cut(e.select("src", "dst").distinct())
    while True:
        heads = a.select(F.col("dst").alias("src")).distinct()
        new = cut(a.join(heads, "src", "left_semi"))  # edges whose source still has an edge into it
        if new.count() == a.count():
            return spark.createDataFrame([(new.count() == 0,)], "is_dag boolean")
        a = new


def euler(n, e, form: str, directed: bool):
    """found: whether a circuit or path over every edge exists, by the nodes' degrees and, where these allow one, the components that hold edges."""
    ends = e.select(F.col("src").alias("u"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("u"), F.lit(-1 if directed else 1).alias("o")))
    off = ends.groupBy("u").agg(F.sum("o").alias("o")).select((F.col("o") if directed else F.col("o") % 2).alias("o"))
    odd = off.where("o <> 0").agg(F.count(F.lit(1)).alias("k"), F.max("o").alias("most")).first()
    found = odd.k == 0 or form == "path" and odd.k == 2 and odd.most == 1
    if found:
        active = cut(ends.select(F.col("u").alias("id")).distinct())
        found = roots(active, e).select("l").distinct().limit(2).count() < 2
    return n.sparkSession.createDataFrame([(found,)], "found boolean")
