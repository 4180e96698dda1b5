"""find: BM25 text search, exact cosine search, and their fusion by reciprocal ranks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60


def bm25(docs: DataFrame, query: str, limit: int = 10, key: str = "id", text: str = "text") -> DataFrame:
    """id, score of the best ``limit`` documents: alphanumeric tokens in lower case, any token of the query. Only matching tokens are counted by document."""
    import re

    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    toks = docs.select(F.col(key).alias("id"), F.expr(f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')").alias("w")).withColumn("len", F.size("w"))
    size = F.broadcast(toks.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))
    hits = toks.withColumn("w", F.explode(F.filter("w", lambda x: x.isin(*terms)))).groupBy("id", "len", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = F.broadcast(hits.groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.join(df, "w").crossJoin(size).groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cosine(vectors: DataFrame, query: list[float], limit: int = 10, key: str = "id", vector: str = "embedding") -> DataFrame:
    """id, score: exact cosine, clamped to 1."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = math.sqrt(sum(x * x for x in query))
    v = F.col(vector).cast("array<double>")
    score = F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * norm)
    return vectors.select(F.col(key).alias("id"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(limit)


def fuse(text: DataFrame, vector: DataFrame, limit: int = 10) -> DataFrame:
    """id, score, matched_on: the sum of 1 / (60 + rank) over two ranked lists of bounded length."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    both = text.select("id", order.alias("a")).join(vector.select("id", order.alias("b")), "id", "full")
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    on = F.when(F.col("a").isNull(), "vector").when(F.col("b").isNull(), "text").otherwise("text+vector")
    return both.select("id", (share("a") + share("b")).alias("score"), on.alias("matched_on")).orderBy(F.desc("score"), "id").limit(limit)
