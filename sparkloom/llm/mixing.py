"""Mixing sources to target weights.

Words of each source, in a fixed order, are packed into blocks of ``block_words``. The mix is a run of slots, dealt
into output shards. How many slots of each source a shard gets is a multinomial draw, conditioned on every source's
total, so that totals come out at the targets: the draw descends a binary tree over the shards, splitting the
totals at each node with a hypergeometric draw seeded by the node, so any task can draw any shard alone and reruns
agree. Slot j of a source is mapped to a block by a keyed Feistel permutation of the block indices, a new one for
each pass over the source, and blocks are joined by index. The mix is a written table of these blocks, each with the
documents that its words are of; how much the mix takes of a document is counted from there.

Defined results: null text counts as no words; null source is a source of its own, sorted last; documents without
words are returned with ``taken`` 0; repeated rows are separate rows; an empty table gives an empty mix; a very long text is
cut into its blocks one by one, in one task. Extra columns don't matter, as only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import scratch

WEIGHTS = (5.0, 2.0, 1.0)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_edges(text: bytes) -> np.ndarray:
    """Where the words of ``text`` begin and end, in turn."""
    gap = np.ones(len(text) + 2, bool)
    gap[1:-1] = SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(gap[1:] != gap[:-1])


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""

    @F.pandas_udf("long")
    def n_words(text: pd.Series) -> pd.Series:
        return text.map(lambda b: 0 if b is None else len(word_edges(b)) // 2)

    return n_words(text.cast("binary"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[tuple]:
    """(source, its size, its target). Sources by code point, null last, take ``weights`` in turn; a target stops at
    ``most`` times its source's size and the excess is shared again by weight until none is above."""
    rows = sorted(((s, int(n)) for s, n in sizes), key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    got, open_ = [0.0] * len(rows), set(range(len(rows)))
    left = share * sum(n for _, n in rows)
    while open_ and left > 0:
        total = sum(weight[i] for i in sorted(open_))
        full = {i for i in open_ if left * weight[i] / total > most * rows[i][1]}
        if not full:
            for i in open_:
                got[i] = left * weight[i] / total
            break
        for i in sorted(full):
            got[i] = most * rows[i][1]
            left -= got[i]
        open_ -= full
    return [(s, n, t) for (s, n), t in zip(rows, got, strict=True)]


def _split(rng: np.random.Generator, totals: np.ndarray, left: int) -> np.ndarray:
    """How many of each source's slots fall among the first ``left`` slots: a multivariate hypergeometric draw."""
    out, rest, need = np.zeros_like(totals), int(totals.sum()), left
    for i, k in enumerate(map(int, totals)):
        rest -= k
        if k and need:
            if k + rest < 10**9:
                x = int(rng.hypergeometric(k, rest, need)) if rest else need
            else:  # numpy's draw ends at 10^9; at such counts the normal law is as good
                n = k + rest
                x = round(rng.normal(need * k / n, (need * k / n * (rest / n) * ((n - need) / max(n - 1, 1))) ** 0.5))
                x = min(max(x, need - rest, 0), k, need)
            out[i] = x
            need -= x
    return out


def shard_counts(totals: np.ndarray, slots: int, first: int, end: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards ``first`` to ``end``: (shard, slots of each source before it, slots of each source in it)."""
    all_slots = int(totals.sum())

    def walk(lo: int, hi: int, before: np.ndarray, here: np.ndarray):
        if hi <= first or lo >= end:
            return
        if hi - lo == 1:
            yield lo, before, here
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = _split(rng, here, min(mid * slots, all_slots) - lo * slots)
        yield from walk(lo, mid, before, left)
        yield from walk(mid, hi, before + left, here - left)

    n = -(-all_slots // slots)
    if n:
        yield from walk(0, n, np.zeros_like(totals), totals)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): four Feistel rounds, walked until the value falls below n."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            a, b = x >> half, x & low
            for r in range(4):
                a, b = b, a ^ (_mix64(b + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & low)
            out[todo] = (a << half) | b
            todo &= out >= n
    return out.astype(np.int64)


class Mix:
    """A mix: sizes, targets, and which block fills each slot."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 64, slots_per_shard: int = 4096, seed: int = 17, max_sources: int = 100_000, buckets: int = 4096):
        """``max_sources`` bounds what the driver holds and what is broadcast; more sources are an error, never dropped."""
        self.spark, self.block_words, self.slots, self.seed, self.buckets = docs.sparkSession, block_words, slots_per_shard, seed, buckets
        scratch.small_batches(self.spark)
        self.id_type = docs.schema["doc_id"].dataType
        self.words = scratch.table(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("hash"), word_count(F.col("text")).alias("size")), "words")
        found = self.words.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        self.sources = []
        for i, (source, size, target) in enumerate(targets([(r.source, r.n) for r in found], weights, share, most)):
            blocks = -(-size // block_words)
            slots = min(round(target * blocks / size), int(most * blocks)) if size else 0
            self.sources.append((source, i, size, float(target), blocks, slots))
        self.plan = self.spark.createDataFrame(self.sources, "source string, source_id int, source_size long, target double, n_blocks long, n_slots long")
        self.placed = scratch.table(self.positions(self.words.drop("text")).drop("hash"), "placed")

    def positions(self, docs: DataFrame) -> DataFrame:
        """``docs`` (doc_id, source, hash, size and more) with source_id, source_size, target and the document's first word's
        place ``at`` in its source: prefix sums within (source, bucket), over bucket totals of the source."""
        key = docs.join(F.broadcast(self.plan.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        key = key.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(self.buckets)))
        sums = key.groupBy("source_id", "_bucket").agg(F.sum("size").alias("_n"))
        sums = sums.select("source_id", "_bucket", (F.sum("_n").over(Window.partitionBy("source_id").orderBy("_bucket")) - F.col("_n")).alias("_base"))
        order = Window.partitionBy("source_id", "_bucket").orderBy("doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = key.withColumn("_sum", F.sum("size").over(order))
        return placed.join(sums, ["source_id", "_bucket"]).withColumn("at", F.col("_base") + F.col("_sum") - F.col("size")).drop("_bucket", "_base", "_sum", "n_blocks", "n_slots")

    def parts(self) -> DataFrame:
        """A row for each document and block that it has words in: source_id, block, at, doc_id, words and their text, joined by one space."""
        n = self.block_words

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["source_id", "block", "at", "doc_id", "words", "text"]
            for batch in batches:
                rows, held = [], 0
                for source_id, at, doc_id, text in batch.itertuples(index=False, name=None):
                    edges = word_edges(text)
                    size, blocks = len(edges) // 2, range(at // n, (at + len(edges) // 2 - 1) // n + 1)
                    first = np.maximum(np.arange(blocks.start, blocks.stop) * n - at, 0)
                    end = np.append(first[1:], size)
                    for block, words, a, b in zip(blocks, (end - first).tolist(), edges[2 * first].tolist(), edges[2 * end - 1].tolist(), strict=True):
                        rows.append((source_id, block, at, doc_id, words, b" ".join(text[a:b].split())))
                        held += b - a
                        if held > 1 << 22:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

        placed = self.positions(self.words.where("size > 0")).select("source_id", "at", F.col("doc_id").cast("string"), F.col("text").cast("binary"))
        cuts = placed.mapInPandas(cut, "source_id int, block long, at long, doc_id string, words int, text binary")
        return cuts.withColumn("doc_id", F.col("doc_id").cast(self.id_type)).withColumn("text", F.col("text").cast("string"))

    def slots_table(self) -> DataFrame:
        """A row for each slot of the mix: shard, slot, source_id, block."""
        totals = np.array([s[5] for s in self.sources], np.int64)
        blocks, slots, seed = [s[4] for s in self.sources], self.slots, self.seed
        shards = -(-int(totals.sum()) // slots) if len(totals) else 0

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard, before, here in shard_counts(totals, slots, int(batch.id.min()), int(batch.id.max()) + 1, seed):
                    ids, got = [], []
                    for i in np.flatnonzero(here):
                        j = np.arange(before[i], before[i] + here[i])
                        block = np.empty(len(j), np.int64)
                        for lap in np.unique(j // blocks[i]):
                            of = j // blocks[i] == lap
                            block[of] = permute(j[of] % blocks[i], blocks[i], (seed * 1_000_003 + int(i)) * 64 + int(lap))
                        ids.append(np.full(len(j), i, np.int32))
                        got.append(block)
                    order = np.random.default_rng([seed, 1, shard]).permutation(int(here.sum()))
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(order)), "source_id": np.concatenate(ids)[order], "block": np.concatenate(got)[order]})

        parts = min(max(1, -(-shards // 16)), 100_000)
        return self.spark.range(0, shards, 1, parts).mapInPandas(draw, "shard long, slot long, source_id int, block long")

    def blocks(self) -> DataFrame:
        """The mix itself, a written table: shard, slot, source_id, block, the block's words, joined by one space, and its parts: at, doc_id, words."""
        parts = scratch.table(self.parts(), "parts")
        scratch.drop(self.words)
        each = F.array_sort(F.collect_list(F.struct("at", "doc_id", "words", "text")))
        packed = parts.groupBy("source_id", "block").agg(each.alias("_of"))
        packed = packed.select("source_id", "block", F.expr("array_join(transform(_of, x -> x.text), ' ') AS words"), F.expr("transform(_of, x -> struct(x.at, x.doc_id, x.words)) AS parts"))
        # The slots grow with the data, while Spark's estimate of them is that of the shard ids: never broadcast.
        mix = scratch.table(self.slots_table().hint("merge").join(packed, ["source_id", "block"]).select("shard", "slot", "source_id", "block", "words", "parts"), "mix")
        scratch.drop(parts)
        return mix

    def taken(self, mix: DataFrame) -> DataFrame:
        """doc_id, source, size, source_size, target, taken: words of each document in the blocks of ``mix``, repeats counted."""
        got = mix.select("source_id", F.explode("parts").alias("p")).groupBy("source_id", F.col("p.at").alias("at")).agg(F.sum("p.words").alias("taken"))
        rows = self.placed.join(got, ["source_id", "at"], "left")
        taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
        return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix of ``docs`` is made and written; returns what it takes of each document."""
    mix = Mix(docs, **options)
    return mix.taken(mix.blocks())
