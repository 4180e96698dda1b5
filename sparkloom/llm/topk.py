"""Exact top-k by inner product: a Voronoi kNN join.

Inner products become distances: with M the longest vector's norm, data get the coordinate sqrt(M^2 - |s|^2) and queries are
scaled to norm M, so nearest means highest score. Queries and data are grouped by their nearest pivots. A bounded
reference sample gives every query a score that its k-th best can't fall below, so a radius; for each query group and
data cell the summaries are the least and greatest distance to the cell's pivot at which data can matter (triangle inequality).
Only data in that range are replicated to the group; each group is solved locally against chunks of what it got, and chunk
results are merged. Scores are exact integers; bounds get a small slack, so rounding loses nothing.

Defined results: vectors null or holding null or non-finite components take no part; vectors of different lengths are compared
over the shorter length; a row is no candidate for queries of its own vec_id; repeated rows are separate candidates and one query;
ties go to the smaller vec_id; fewer than k candidates: all. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import scratch

SLACK = 1e-6


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _unpack(column: pd.Series, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, dim).astype(np.float64)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows; by floats where those are exact."""
    most = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    ints = [[int(x) for x in v] for v in a], [[int(x) for x in v] for v in b]
    low, high = -(2**63), 2**63 - 1
    return np.array([[min(max(sum(x * y for x, y in zip(u, v, strict=True)), low), high) for v in ints[1]] for u in ints[0]], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 64, sample: int = 2048, group: int = 1024, chunk: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score. ``pivots`` and ``sample`` bound what the driver holds; ``group`` and ``chunk`` what a task holds."""
    spark = embeddings.sparkSession
    scratch.small_batches(spark, 5_000)
    fine = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity'))")
    rows = embeddings.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor(double({scale}) * double(x)))").alias("_f"))
    rows = rows.select("vec_id", F.expr("transform(_f, x -> double(x))").alias("v"))
    rows = scratch.table(rows.withColumn("sq", F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max("sq").alias("sq"), F.max(F.expr("array_max(transform(v, x -> abs(x)))")).alias("most"), F.count(F.expr(f"if(vec_id % {every} = 0, 1, NULL)")).alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not size.n or not size.queries or not size.dim:
        return spark.createDataFrame([], schema)
    dim, kind, far = size.dim, "<f4" if (size.most or 0) < 2**24 else "<f8", max(1.0, float(size.sq)) ** 0.5
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, pivots)).select("vec_id", "v").toPandas()
    ref, ref_ids = _matrix(picked.v, dim), picked.vec_id.to_numpy()

    def lift(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(far**2 - (x**2).sum(1), 0))])

    centres = lift(ref[:pivots])
    n_groups = max(1, -(-size.queries // group))
    heads = centres[: min(n_groups, len(centres))]

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))

    head_of = distances(centres, heads).argmin(1)

    def cells(batches):
        for batch in batches:
            x = _matrix(batch.v, dim)
            d = distances(lift(x), centres)
            cell = d.argmin(1)
            yield pd.DataFrame({"vec_id": batch.vec_id, "cell": cell, "r": d[np.arange(len(x)), cell], "vec": [v.tobytes() for v in x.astype(kind)]})

    def radii(batches):
        for batch in batches:
            x = _matrix(batch.v, dim)
            norm = np.sqrt((x**2).sum(1))
            d = distances(np.column_stack([x * (far / np.maximum(norm, 1e-30))[:, None], np.zeros(len(x))]), centres)
            scores = exact_scores(x, ref).astype(float)
            scores[batch.vec_id.to_numpy()[:, None] == ref_ids[None]] = -np.inf
            floor = np.sort(scores, 1)[:, -k] if len(ref) >= k else np.full(len(x), -np.inf)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.sqrt(np.maximum(2 * far**2 - 2 * far * floor / norm, 0))
            reach = np.where((norm > 0) & np.isfinite(floor), reach, np.inf) * (1 + SLACK) + SLACK * far
            yield pd.DataFrame({"vec_id": batch.vec_id, "head": head_of[d.argmin(1)], "low": list(d - reach[:, None]), "high": list(d + reach[:, None]), "floor": floor, "vec": [v.tobytes() for v in x.astype(kind)]})

    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = scratch.table(queries.mapInPandas(radii, "vec_id long, head int, low array<double>, high array<double>, floor double, vec binary"), "queries")
    salts = queries.groupBy("head").agg(F.count(F.lit(1)).alias("_n")).withColumn("salts", F.expr(f"(_n + {group - 1}) div {group}")).drop("_n")
    queries = queries.join(salts, "head").withColumn("g", F.struct("head", F.pmod(F.xxhash64("vec_id", "vec"), "salts").alias("salt")))
    ranges = queries.select("g", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "b")).groupBy("g", "cell").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    chunks = max(1, -(-size.n // chunk))
    data = rows.mapInPandas(cells, "vec_id long, cell int, r double, vec binary").withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(chunks)))
    given = data.join(ranges, "cell").where("r BETWEEN low AND high").select(F.col("g").alias("to"), F.col("chunk").alias("part"), "vec_id", "vec")
    asked = queries.select("g", F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")).alias("chunk"), F.col("vec_id").alias("query_id"), "floor", "vec")

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(s):
            ids, x = s.vec_id.to_numpy(), _unpack(s.vec, dim, kind)
            for at in range(0, len(q), 64):
                part = q.iloc[at : at + 64]
                for query, floor, own, vec, scores in zip(part.query_id, part.floor, range(at, at + 64), part.vec, exact_scores(_unpack(part.vec, dim, kind), x), strict=False):
                    keep = np.flatnonzero((scores >= floor) & (ids != query))
                    got = keep[best(scores[keep], ids[keep], k)]
                    out.append(pd.DataFrame({"query_id": query, "qvec": [vec] * len(got), "vec_id": ids[got], "score": scores[got]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "qvec": [], "vec_id": [], "score": []})

    local = asked.groupBy("g", "chunk").cogroup(given.groupBy("to", "part")).applyInPandas(solve, "query_id long, qvec binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "qvec").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
