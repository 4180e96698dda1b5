"""Vectors of nodes: exact neighbours, k-means, HDBSCAN, and embeddings of the graph."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.algo.native import best, both
from sparkloom.llm import scratch
from sparkloom.plans.lineage import cut


def given(nodes: DataFrame, vector: str) -> DataFrame:
    """id, v of the nodes that have a vector of finite numbers."""
    v = F.col(vector).cast("array<double>")
    return nodes.select("id", v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def cosine_pairs(nodes: DataFrame, vector: str, k: int | None = None, least: float | None = None, block: int = 4_096) -> DataFrame:
    """id1, id2, similarity of ordered pairs of different nodes, the best ``k`` of each id1, or all. Blocks of nodes meet blocks, so a task holds two of them."""
    rows = cut(given(nodes, vector).where(F.expr("aggregate(v, 0D, (a, x) -> a + x * x) > 0")))
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = rows.select(F.col("id").alias("id1"), F.col("v").alias("v1"), F.col("b").alias("i"), every.alias("j"))
    right = rows.select(F.col("id").alias("id2"), F.col("v").alias("v2"), every.alias("k"), F.col("b").alias("l"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id1": [], "id2": [], "similarity": []})
        ida, idb, x, y = a.id1.to_numpy(), b.id2.to_numpy(), np.array(a.v1.tolist()), np.array(b.v2.tolist())
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        s = np.clip(x @ y.T, -1, 1)
        s[ida[:, None] == idb[None]] = -2
        if least is not None:
            s[s < least] = -2
        if k is None or k >= len(idb):
            i, j = np.nonzero(s > -2)
        else:
            kth = np.partition(s, len(idb) - k, 1)[:, len(idb) - k]
            i, j = np.nonzero((s >= kth[:, None]) & (s > -2))  # ties stay; the window below decides
        return pd.DataFrame({"id1": ida[i], "id2": idb[j], "similarity": s[i, j]})

    out = left.groupBy("i", "j").cogroup(right.groupBy("k", "l")).applyInPandas(score, "id1 long, id2 long, similarity double")
    return out if k is None else best(out, k)


def filtered_knn(nodes: DataFrame, e: DataFrame, vector: str, k: int) -> DataFrame:
    """The best ``k`` out-neighbours by cosine, none below 0."""
    rows = given(nodes, vector)
    pairs = e.where("src <> dst").select("src", "dst").distinct().join(rows.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(rows.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, z) -> s + z)"
    pairs = pairs.select(F.col("src").alias("id1"), F.col("dst").alias("id2"), F.expr(f"try_divide({dot('a', 'b')}, sqrt({dot('a', 'a')} * {dot('b', 'b')}))").alias("similarity"))
    return best(pairs.where("similarity >= 0").withColumn("similarity", F.least("similarity", F.lit(1.0))), k)


def k_means(nodes: DataFrame, vector: str, k: int = 10, rounds: int = 100) -> DataFrame:
    """id, community_id: Lloyd's rounds from centres picked farthest first, from the first node on. The driver holds the centres alone."""
    rows = cut(given(nodes, vector))
    first = rows.orderBy("id").first()
    if first is None:
        return rows.select("id", F.lit(0).cast("long").alias("community_id"))
    centres = np.array([first.v])

    def assigned(centres: np.ndarray):
        def go(batches):
            for batch in batches:
                x = np.array(batch.v.tolist()).reshape(len(batch), -1)
                d = ((x[:, None] - centres[None]) ** 2).sum(2) if len(x) else np.empty((0, len(centres)))
                yield pd.DataFrame({"id": batch.id, "v": list(x), "c": d.argmin(1) if len(x) else [], "d": d.min(1) if len(x) else []})

        return rows.mapInPandas(go, "id long, v array<double>, c long, d double")

    while len(centres) < k:
        far = assigned(centres).orderBy(F.desc("d"), "id").first()
        if far.d <= 0:
            break
        centres = np.vstack([centres, far.v])
    for _ in range(rounds):
        sums = assigned(centres).select("c", F.posexplode("v").alias("at", "x")).groupBy("c", "at").agg(F.avg("x").alias("x")).collect()
        new = centres.copy()
        for r in sums:
            new[r.c, r["at"]] = r.x
        done, centres = np.array_equal(new, centres), new
        if done:
            break
    return assigned(centres).select("id", F.col("c").alias("community_id"))


def hdbscan(nodes: DataFrame, vector: str, least: int = 5, most: int = 20_000) -> DataFrame:
    """id, community_id: clusters of greatest excess of mass over the tree of mutual reachability; -1 is noise. One task, ``most`` nodes at most."""
    rows = given(nodes, vector)
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} nodes")

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        return pd.DataFrame({"id": frame.id, "community_id": _hdbscan(np.array(frame.v.tolist()), least)})

    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(go, "id long, community_id long")


def _hdbscan(x: np.ndarray, least: int) -> np.ndarray:
    n = len(x)
    gap = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    core = np.array([np.partition(gap(i), min(least, n) - 1)[min(least, n) - 1] for i in range(n)])
    reach, near, todo, links = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):  # Prim's tree over mutual reachability
        todo[at] = False
        d = np.maximum(np.maximum(gap(at), core), core[at])
        closer = todo & (d < reach)
        reach[closer], near[closer] = d[closer], at
        at = int(np.where(todo, reach, np.inf).argmin())
        links.append((reach[at], near[at], at))
    up, kids, size, height = list(range(2 * n)), {}, [1] * n + [0] * n, {}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, (d, a, b) in enumerate(sorted(links)):
        a, b, c = root(a), root(b), n + k
        up[a] = up[b] = c
        kids[c], size[c], height[c] = (a, b), size[a] + size[b], d

    def leaves(i):
        out, stack = [], [i]
        while stack:
            j = stack.pop()
            stack += kids.get(j, ())
            out += [j] if j < n else []
        return out

    label = np.full(n, -1)
    if n < 2:
        return label
    mass, child, members, stack = {}, defaultdict(list), {}, [(2 * n - 2, None, 0.0)]
    while stack:  # a cluster follows its larger part down until both parts are large enough
        top, parent, born = stack.pop()
        name, i, total = len(members), top, 0.0
        members[name] = leaves(top)
        if parent is not None:
            child[parent].append(name)
        while i in kids:
            rate = 1 / max(height[i], 1e-12)
            a, b = kids[i]
            if min(size[a], size[b]) >= least:
                total += (rate - born) * (size[a] + size[b])
                stack += [(a, name, rate), (b, name, rate)]
                break
            total += sum((rate - born) * size[j] for j in (a, b) if size[j] < least)
            i = a if size[a] >= least else b if size[b] >= least else None
        mass[name] = total
    chosen = {}
    for name in sorted(members, reverse=True):
        below = sum(mass[c] for c in child[name])
        if name and (not child[name] or mass[name] >= below):
            stack = list(child[name])
            while stack:
                c = stack.pop()
                chosen.pop(c, None)
                stack += child[c]
            chosen[name] = True
        else:
            mass[name] = below
    for k, name in enumerate(sorted(chosen, key=lambda c: min(members[c]))):
        label[members[name]] = k
    return label


def fast_random_projection(n: DataFrame, e: DataFrame, dim: int = 64, weights=(0.0, 1.0, 1.0), directed: bool = False, seed: int = 0) -> DataFrame:
    """id, embedding: weighted sum of unit vectors, random at first, then time after time the means of the neighbours'. A vector is one row's array."""
    a = scratch.table((e if directed else both(e)).select("src", "dst"), "links")
    squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    unit = lambda h: h.withColumn("_l", F.sqrt(squares)).select("id", F.when(F.col("_l") > 0, F.transform("x", lambda v: v / F.col("_l"))).alias("x"))
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(6))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    h = scratch.table(unit(n.select("id", F.transform(places, lambda i: F.when(draw(i) == 0, 1.0).when(draw(i) == 1, -1.0).otherwise(0.0)).alias("x"))), "vectors")
    out = n.select("id", F.transform(places, lambda i: F.lit(0.0)).alias("embedding"))
    for k, w in enumerate(weights):
        if k:
            got = a.join(h.select(F.col("id").alias("dst"), "x"), "dst").where("x IS NOT NULL").groupBy(F.col("src").alias("id"))
            new = scratch.table(got.agg(F.array(*(F.avg(F.col("x")[i]) for i in range(dim))).alias("x")), "vectors")
            scratch.drop(h)
            h = new
        if w:
            grown = F.when(F.col("x").isNull(), F.col("embedding")).otherwise(F.zip_with("embedding", "x", lambda o, v: o + v * w))
            out = scratch.table(out.join(unit(h), "id", "left").select("id", grown.alias("embedding")), "embeddings")
    return out


def _packed(n: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    got = rows.where("x <> 0").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return n.select("id").join(got, "id", "left").select("id", value.alias("embedding"))


def hashgnn(n: DataFrame, e: DataFrame, dim: int = 64, density: float = 0.1, rounds: int = 3, samples: int = 8, directed: bool = False, seed: int = 0) -> DataFrame:
    """id, embedding of 0 and 1: ``samples`` times a round, the bit of least hash among a node's own and its neighbours' bits."""
    a = cut((e if directed else both(e)).select("src", "dst").distinct())
    bits = n.select("id", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("at")).withColumn("h", F.xxhash64(F.lit(seed), "id", "at"))
    bits = cut(bits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("h", "at"))).where(F.col("r") <= max(1, int(np.ceil(density * dim)))).select("id", "at"))
    for i in range(rounds):
        seen = bits.select("id", "at", F.lit(0).alias("kind")).unionByName(a.join(bits.select(F.col("id").alias("dst"), "at"), "dst").select(F.col("src").alias("id"), "at", F.lit(1).alias("kind")))
        seen = seen.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("h", F.xxhash64(F.lit(seed + i + 1), "k", "kind", "at"))
        bits = cut(seen.groupBy("id", "k").agg(F.min(F.struct("h", "at")).alias("m")).select("id", "m.at").distinct())
    return _packed(n, bits.withColumn("x", F.lit(1.0)), dim)


def walks(n: DataFrame, e: DataFrame, length: int, count: int, p: float, q: float, directed: bool, seed: int) -> DataFrame:
    """walk, path: second-order walks from every node, steps weighted 1/p back, 1 to a neighbour of the last node, 1/q elsewhere. A step's draw is a hash, so reruns agree."""
    a = cut((e if directed else both(e)).select("src", "dst").distinct())
    at = cut(n.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("w"), "id").select(F.struct("w", "id").alias("walk"), F.array("id").alias("path"), F.lit(None).cast("long").alias("last"), F.col("id").alias("src")))
    ended = []
    for step in range(1, length):
        ways = at.join(a, "src")
        if p != 1 or q != 1:
            ways = ways.join(a.select(F.col("src").alias("last"), "dst", F.lit(True).alias("near")), ["last", "dst"], "left")
            weight = F.when(F.col("last").isNull(), 1.0).when(F.col("dst") == F.col("last"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        else:
            weight = F.lit(1.0)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "walk", "dst"), F.lit(1 << 30)) + 0.5) / (1 << 30)
        pick = ways.groupBy("walk").agg(F.min(F.struct((-F.log(u) / weight).alias("k"), "dst", "src", "path")).alias("m"))
        new = cut(pick.select("walk", F.array_append("m.path", F.col("m.dst")).alias("path"), F.col("m.src").alias("last"), F.col("m.dst").alias("src")))
        ended.append(at.join(new, "walk", "left_anti").select("walk", "path"))
        at = new
    out = at.select("walk", "path")
    for x in ended:
        out = out.unionByName(x)
    return cut(out)


def node2vec(n: DataFrame, e: DataFrame, dim: int = 128, length: int = 80, count: int = 10, p: float = 1.0, q: float = 1.0, window: int = 10, epochs: int = 1, rate: float = 0.025, directed: bool = False, seed: int = 0) -> DataFrame:
    """id, embedding: skip-grams (Spark's Word2Vec) of the walks."""
    from pyspark.ml.feature import Word2Vec

    paths = walks(n, e, length, count, p, q, directed, seed).select(F.col("path").cast("array<string>").alias("path"))
    model = Word2Vec(vectorSize=dim, minCount=0, maxIter=epochs, stepSize=rate, windowSize=window, seed=seed, inputCol="path", outputCol="v").fit(paths)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("embedding"))


def graphsage(nodes: DataFrame, e: DataFrame, features: list[str], dim: int = 32, layers: int = 2, rounds: int = 50, rate: float = 0.01, most: int = 200_000, seed: int = 0) -> DataFrame:
    """id, embedding: mean aggregators over undirected links, trained by Adam to tell linked nodes from drawn ones. One task, ``most`` nodes at most."""
    rows = nodes.select("id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).alias("v"), F.lit(None).cast("long").alias("dst"))
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"over {most} nodes")
    links = both(e).select(F.col("src").alias("id"), F.lit(None).cast("array<double>").alias("v"), "dst")

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame.dst.isna()].sort_values("id")
        ids = own.id.to_numpy()
        pairs = frame[frame.dst.notna()].sort_values(["id", "dst"])
        src, dst = np.searchsorted(ids, pairs.id.to_numpy()), np.searchsorted(ids, pairs.dst.to_numpy(np.int64))
        return pd.DataFrame({"id": ids, "embedding": list(_sage(np.array(own.v.tolist()), src, dst, dim, layers, rounds, rate, seed))})

    return rows.unionByName(links).groupBy(F.lit(0).alias("_g")).applyInPandas(go, "id long, embedding array<double>")


def _sage(x, src, dst, dim, layers, rounds, rate, seed):
    rng = np.random.default_rng(seed)
    x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    n, degree = len(x), np.maximum(np.bincount(src, minlength=len(x)), 1)[:, None]

    def mean(h, back=False):
        out = np.zeros_like(h)
        np.add.at(out, dst if back else src, (h / degree)[src] if back else h[dst])
        return out if back else out / degree

    sizes = [x.shape[1], *[dim] * layers]
    w = [rng.normal(0, (2 / (a + b)) ** 0.5, (2 * a, b)) for a, b in zip(sizes, sizes[1:])]
    m, v = [np.zeros_like(k) for k in w], [np.zeros_like(k) for k in w]

    def forward():
        h, held = x, []
        for k in w:
            joined = np.hstack([h, mean(h)])
            h = np.tanh(joined @ k)
            held.append((joined, h))
        return h, held

    for t in range(1, rounds + 1 if len(src) else 1):
        h, held = forward()
        other = rng.integers(0, n, len(src))
        g = np.zeros_like(h)
        for to, sign in ((dst, 1.0), (other, -1.0)):
            z = 1 / (1 + np.exp(np.clip(sign * (h[src] * h[to]).sum(1), -30, 30)))
            np.add.at(g, src, -sign * z[:, None] * h[to] / len(src))
            np.add.at(g, to, -sign * z[:, None] * h[src] / len(src))
        for i in range(layers - 1, -1, -1):
            joined, out = held[i]
            d = g * (1 - out**2)
            grad = joined.T @ d
            back = d @ w[i].T
            a = joined.shape[1] // 2
            g = back[:, :a] + mean(back[:, a:], True)
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad**2
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    h, _ = forward()
    return h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
