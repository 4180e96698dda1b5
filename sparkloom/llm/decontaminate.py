"""Benchmark decontamination, on DataFrame functions alone.

A document's windows of an item's size are compared with the item. A window as similar as asked shares most shingles with its
item, so windows are formed only where enough of an item's shingles occur (a bound that loses nothing: the best window starts at one of
them or ends with the text). Each window gets a SimHash fingerprint; a multi-index over ``radius`` + 1 blocks of the bits tells
whether the item is within ``radius`` bits, as one block must agree (its key holds the item, so windows meet no item that they share too little with), and the similarity of the shingles, weighted by their
counts (sum of least over sum of greatest counts), then decides exactly. At 0.8 a pair's fingerprints differ in about 10 of 64 bits
with a deviation of 3, so the default radius of 19 keeps all but about one in a thousand borderline pairs and every exact copy.

Defined results: words are cut at ASCII white space in lower case; null or empty texts and items match nothing; an item of fewer than
``shingle`` words is one shingle of its own width and matches wherever its words stand in a row; a document shorter than an item is one window; repeated rows give one row. Extra columns
are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"filter(split(lower(text), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _held(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A computed column that later expressions read and never compute again: the optimizer inlines no column through a generator."""
    return df.withColumn(name, F.explode(F.array(F.expr(expression))))


def _shingled(df: DataFrame, shingle: int) -> DataFrame:
    """Adds m (words) and sh (a hash for each shingle, in order)."""
    parts = ", ".join(f"get(_w, i + {k})" for k in range(shingle))  # nulls past the end leave the hash as it is
    out = _held(df.where("text IS NOT NULL"), "_w", WORDS).withColumn("m", F.size("_w")).where("m > 0")
    return _held(out, "sh", f"transform(sequence(0, greatest(m - {shingle}, 0)), i -> xxhash64({parts}))").drop("_w")


def _simhash(sh: str) -> str:
    return f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if(2 * aggregate({sh}, 0, (c, h) -> c + int(shiftright(h, b) & 1L)) > size({sh}), shiftleft(1L, b), 0L))"


def _blocks(fp: str, radius: int) -> str:
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return "array(" + ", ".join(f"named_struct('block', {i}, 'bits', shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L)" for i, (a, b) in enumerate(zip(cuts, cuts[1:]))) + ")"


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 19, small: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash, item_id, start_word and similarity of the best window of every document and item that match.

    Tables of up to ``small`` rows, counted first, are broadcast; larger ones are joined by a shuffle. Items of fewer than
    ``shingle`` words are looked for by shingles of their own width, in a pass for each width that the items have.
    """
    words = _held(benchmark.where("text IS NOT NULL"), "_w", WORDS).select(F.least(F.size("_w"), F.lit(shingle)).alias("width"))
    widths = sorted(r.width for r in words.where("width > 0").distinct().collect()) or [shingle]
    parts = [_matches(docs, benchmark, w, w < shingle, similarity, radius, small) for w in widths]
    return reduce(DataFrame.unionByName, parts)


def _matches(docs: DataFrame, benchmark: DataFrame, shingle: int, only: bool, similarity: float, radius: int, small: int) -> DataFrame:
    """``contaminated`` for the items of ``shingle`` words or more, or of just as many."""
    from sparkloom.llm import scratch

    def given(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= small else df

    items = _shingled(benchmark.select("item_id", "text").distinct(), shingle).where(F.col("m") == shingle if only else F.col("m") >= shingle)
    items = items.select("item_id", "m", "sh", F.size("sh").alias("size"), F.expr(_simhash("sh")).alias("fp"))
    items = scratch.table(items, "items")
    grams = items.select("item_id", "size", F.explode("sh").alias("h")).distinct()
    sized = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    points = _shingled(sized, shingle).select("doc_id", "text_hash", F.posexplode("sh").alias("pos", "h"))
    n_grams = items.agg(F.sum("size")).first()[0] or 0
    hits = points.join(given(grams, n_grams), "h").groupBy("doc_id", "text_hash", "item_id", "size")
    hits = hits.agg(F.sort_array(F.collect_set("pos")).alias("at")).where(F.size("at") >= similarity * F.col("size"))
    # Windows of one shingle are all alike: the first will do.
    hits = scratch.table(hits.withColumn("at", F.expr("if(size = 1, slice(at, 1, 1), at)")), "hits")
    n_hits = hits.count()
    places = hits.join(given(items.select("item_id", "m"), n_grams), "item_id").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("item_id", "m", "at", "size")).alias("found"))
    mine = places.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "found")
    read = sized.join(given(mine, n_hits), sized.doc_id.eqNullSafe(mine._d) & (sized.text_hash == mine._h))
    read = _shingled(read.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "found"), shingle)
    each = read.select("doc_id", "text_hash", F.col("m").alias("n"), "sh", F.explode("found").alias("f"))
    each = each.select("doc_id", "text_hash", "sh", "f.*", F.least("n", "f.m").alias("words")).withColumn("len", F.greatest(F.col("words") - (shingle - 1), F.lit(1)))
    each = _held(each, "starts", "array_distinct(transform(at, p -> least(p, size(sh) - len)))")
    each = each.withColumn("start", F.explode(F.expr(f"filter(starts, s -> size(filter(at, p -> p >= s AND p < s + len)) >= {similarity} * size)")))
    windows = _held(each, "win", "slice(sh, start + 1, len)").select("doc_id", "text_hash", "item_id", "m", "start", "win").dropDuplicates(["doc_id", "text_hash", "item_id", "m", "start"])
    windows = scratch.table(windows.withColumn("fp", F.expr(_simhash("win"))), "windows")
    index = items.select("item_id", "m", F.col("fp").alias("item_fp"), F.explode(F.expr(_blocks("fp", radius))).alias("b")).select("item_id", "m", "item_fp", "b.*")
    asked = windows.select("doc_id", "text_hash", "item_id", "m", "start", "fp", F.explode(F.expr(_blocks("fp", radius))).alias("b")).select("doc_id", "text_hash", "item_id", "m", "start", "fp", "b.*")
    near = asked.join(given(index, n_grams * (radius + 1)), ["item_id", "m", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select(*(F.col(c).alias("_" + c) for c in ("doc_id", "text_hash", "item_id", "m", "start"))).distinct()
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in ("doc_id", "text_hash", "item_id", "m", "start")]
    pairs = windows.join(near, same, "left_semi").select("doc_id", "text_hash", "start", "win", "item_id", "m")
    pairs = pairs.join(given(items.select("item_id", "m", F.col("sh").alias("own")), n_grams), ["item_id", "m"])
    shared = "aggregate(array_intersect(win, own), 0, (a, h) -> a + least(size(filter(win, x -> x = h)), size(filter(own, x -> x = h))))"
    scored = pairs.withColumn("c", F.expr(shared)).withColumn("similarity", F.expr("c / double(size(win) + size(own) - c)")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("b.s")).cast("long").alias("start_word"), "b.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start_word, similarity: a row for each document and item that it contains."""
    found = contaminated(docs, benchmark, **options)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start_word"), "b.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, small: int = 2_000_000, **options) -> DataFrame:
    """``docs`` without those that contain an item."""
    from sparkloom.llm import scratch

    found = scratch.table(contaminated(docs, benchmark, small=small, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "leaks")
    bad = F.broadcast(found) if found.count() <= small else found
    return docs.join(bad, docs.doc_id.eqNullSafe(bad._d) & (F.xxhash64(docs.text) == bad._h), "left_anti")


SQL = r"""
WITH b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, len(w) AS m, least(len(w), 5) AS wide, greatest(len(w) - 4, 1) AS size, w FROM b WHERE len(w) > 0),
g AS (SELECT item_id, m, wide, size, array_to_string(w[p:p + wide - 1], ' ') AS h FROM (SELECT *, unnest(range(1, size + 1)) AS p FROM i)),
gc AS (SELECT item_id, m, wide, size, h, count(*) AS k FROM g GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, wide, len(w) AS n, pos - 1 AS pos, array_to_string(w[pos:pos + wide - 1], ' ') AS h
  FROM (SELECT *, unnest(range(1, greatest(len(w) - wide + 1, 1) + 1)) AS pos FROM d, (SELECT DISTINCT wide FROM i) WHERE len(w) > 0)),
x AS (SELECT doc_id, md5(text) AS t, n, pos, item_id, m, wide, size, h, k FROM p JOIN gc USING (wide, h)),
s AS (SELECT DISTINCT doc_id, t, item_id, size, greatest(least(n, m) - wide + 1, 1) AS len, least(pos, greatest(n - wide + 1, 1) - greatest(least(n, m) - wide + 1, 1)) AS start FROM x),
c AS (SELECT doc_id, t, item_id, size, len, start, h, least(count(*), any_value(k)) AS c FROM s JOIN x USING (doc_id, t, item_id, size) WHERE pos >= start AND pos < start + len GROUP BY ALL),
r AS (SELECT doc_id, item_id, start, sum(c) / (any_value(len) + any_value(size) - sum(c))::DOUBLE AS similarity FROM c GROUP BY doc_id, t, item_id, start)
SELECT doc_id, item_id, start::BIGINT AS start_word, similarity FROM r WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
