"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

Only suffixes at anchors are sorted. An anchor is the position of the least k-gram hash in a window of ``length`` bytes; any
two equal strings of that length have theirs at the same place, so equal strings meet at anchors of equal k-grams. Around
anchors whose k-gram occurs twice, contexts (``length - k`` bytes before, ``length`` from it) are gathered, one of each kind,
and within each k-gram the suffixes from the anchor on and the reversed prefixes before it are put in order by a mergesort
that compares suffixes in logarithmic time: prefix polynomial hashes and binary search give the common extension of
two suffixes. Neighbours' common extensions are then verified on the bytes; a collision makes the chunk be sorted by
bytes. Classes of the two orders give, for each anchor, the first and last start of a repeated string around it; what
those cover is removed. Copies of whole texts take part once. Contexts of a k-gram with more than ``max_group`` different ones are compared by
digests of longer strings instead, so no group outgrows a task; rows of keys that hold much of a table meet a broadcast of these keys,
of which there are few by definition.

Defined results: null text counts as empty; nothing is removed from texts shorter than ``length`` bytes; repeated rows are copies of
each other; strings never cross documents; very long texts go whole, in steps. Other columns, whatever their names, pass through ``drop_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch

LENGTH, GRAM = 400, 100
#: Passages of so many words are cut by ``drop_repeats`` whatever their bytes. A word of fewer than WIDE bytes is widened to WIDE by a byte that UTF-8 never
#: has, so WORDS words are at least WORDS * (WIDE + 1) - 1 = 407 bytes.
WORDS, WIDE, PAD = 51, 7, 0xFF
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _powers[base] = np.multiply.accumulate(held)
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes and positions of the anchors, in order. Long texts go in overlapping steps."""
    places, hashes, window = [], [], length - gram + 1
    data = np.frombuffer(text, np.uint8)
    for first in range(0, max(0, len(text) - length + 1), STEP):
        t = data[first : first + STEP + length - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(t * _power(BASE, len(t)), out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * _power(INVERSE, len(t) - gram + 1))
        least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if window > reach:
            least = np.minimum(least[: len(least) - (window - reach)], least[window - reach :])
        at = np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
        places.append(at + first)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, i = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[i].view(np.int64), at


def sort_suffixes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, bytes), group being sorted already, and each row's common extension with the one before it,
    -1 at a group's start."""
    n, m = rows.shape
    sums = np.zeros((m + 1, n), np.uint64)
    for j in range(m):
        sums[j + 1] = sums[j] * np.uint64(BASE) + rows[:, j] + np.uint64(1)
    flat = sums.reshape(-1)

    def extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.full(len(x), m, np.int64)
        for _ in range(int(m).bit_length()):
            mid = (low + high + 1) >> 1
            same = flat[mid * n + x] == flat[mid * n + y]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    start = np.searchsorted(group, group, side="left")
    count = np.searchsorted(group, group, side="right") - start
    order, width, widest = np.arange(n), 1, int(count.max(initial=0))
    place = np.arange(n) - start
    while width < widest:
        run = place // width
        other = (run ^ 1) * width
        act = np.flatnonzero(other < count)
        x, base = order[act], start[act] + other[act]
        odd = (run[act] & 1).astype(bool)
        low, high = np.zeros(len(act), np.int64), np.minimum(width, count[act] - other[act])
        open_ = np.arange(len(act))
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            y, xx = order[base[open_] + mid], x[open_]
            e = extension(xx, y)
            inside = e < m
            e = np.minimum(e, m - 1)
            before = np.where(inside, rows[y, e] < rows[xx, e], odd[open_])
            low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        to = start[act] + (run[act] & ~1) * width + place[act] % width + low
        new = order.copy()
        new[to] = x
        order, width = new, width * 2

    def verified(order: np.ndarray) -> tuple[np.ndarray, bool]:
        a, b = rows[order[:-1]], rows[order[1:]]
        differ = a != b
        e = np.where(differ.any(1), differ.argmax(1), m)
        k = np.minimum(e, m - 1)
        i = np.arange(len(e))
        same_group = group[order[:-1]] == group[order[1:]]
        fine = bool((~same_group | (e == m) | (a[i, k] < b[i, k])).all())
        return np.concatenate([[-1], np.where(same_group, e, -1)]), fine

    common, fine = verified(order)
    if not fine:  # hashes collided
        order = np.array(sorted(range(n), key=lambda i: (group[i], rows[i].tobytes())), np.int64)
        common, _ = verified(order)
    return order, common


def repeats(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts (``left`` bytes before the anchor), sorted by group: least and greatest number of bytes before the
    anchor at which a string starts that another context of the group has too; -1 where none does."""
    n, before = len(contexts), length - gram
    after = np.zeros((n, length), np.uint8)
    back = np.zeros((n, before), np.uint8)
    right = np.empty(n, np.int64)
    for i, (c, k) in enumerate(zip(contexts, left, strict=True)):
        b = np.frombuffer(c, np.uint8)
        right[i] = len(b) - k
        after[i, : len(b) - k] = b[k:]
        back[i, :k] = b[:k][::-1]
    orders = [sort_suffixes(x, group) for x in (after, back)]
    least, most = np.full(n, -1), np.full(n, -1)

    def classes(which: int, depth: int) -> np.ndarray:
        order, common = orders[which]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    for i in range(before + 1):
        fits = np.flatnonzero((left >= i) & (right >= length - i))
        if len(fits) < 2:
            continue
        key = (classes(0, length - i) * (n + 1) + classes(1, i))[fits]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = fits[by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        most[hit] = i
        least[hit[least[hit] < 0]] = i
    return least, most


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed, and maximal removed runs."""
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            parts.append(text[at:a])
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    return b"".join([*parts, text[at:]]), removed, runs


def _hot(counts: DataFrame, n: str, total: int, parts: int) -> Column:
    """Whether a key's rows are more than a quarter of an even partition; at most 4 * ``parts`` keys are, so they may be broadcast."""
    return F.col(n) > max(1, total // (4 * parts))


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int, parts: int) -> DataFrame:
    """Inner join of ``rows`` with one row a key, ``n`` being that key's number of rows of ``total``: rows of hot keys meet a broadcast and are not moved."""
    hot = F.broadcast(counts.where(_hot(counts, n, total, parts)))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(counts.where(~_hot(counts, n, total, parts)), keys)
    return rows.join(hot, keys).unionByName(rest)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def join_texts(rows: DataFrame, key: str, cuts: DataFrame, parts: int) -> DataFrame:
    """Left join of ``rows`` with ``cuts`` (one row a ``key``). Keys of more than a quarter of an even partition, at most 4 * ``parts`` of them, meet a broadcast."""
    total = rows.count()
    often = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    often = rows.sparkSession.createDataFrame([(bytes(r[0]),) for r in often.where(_hot(often, "n", total, parts)).select(key).collect()], f"{key} binary")
    own = [c for c in cuts.columns if c != key]
    hot = F.broadcast(often.join(cuts, key, "left").select(key, F.struct(*own).alias(f"{key}_")))
    held = rows.join(hot, key, "left")
    # Rows that have their answer, or need none, are spread by a key that nothing else has.
    alone = F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))
    held = held.withColumn(key, F.when(F.col(f"{key}_").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(alone))
    out = held.join(cuts.select(key, F.struct(*own).alias(f"{key}__")), key, "left")
    return out.withColumn(key, F.coalesce(f"{key}_", f"{key}__")).drop(f"{key}_", f"{key}__")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = 16_384, chunk: int = 8_192, prepare: Callable[[bytes], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the different texts of ``docs`` (text) that are ``length`` bytes or more after ``prepare``: (texts: digest, n, copies, packed), and (spans: digest,
    spans as an array of a, b), both written tables. Texts with copies are repeated as a whole and have no spans."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for digest, t in zip(batch.digest, batch.text, strict=True):
                t = prepare(bytes(t)) if prepare else bytes(t)
                if len(t) >= length:
                    h, at = anchors(t, length, gram)
                    rows.append((digest, len(t), pack.compress(t), h, at.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["digest", "n", "packed", "hash", "at"])

    binary = docs.select(F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    seen = binary.select(text_key(F.col("text")).alias("digest"), "text").mapInPandas(scan, "digest binary, n long, packed binary, hash array<long>, at array<int>")
    seen = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("n", "packed", "hash", "at")))
    seen = scratch.table(seen, "texts")
    texts = seen.select("digest", "packed")

    points = seen.select("digest", F.explode(F.arrays_zip("hash", "at")).alias("p")).select("digest", F.col("p.hash").alias("gram"), F.col("p.at").alias("at"))
    twice = scratch.table(points.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    n_points = twice.agg(F.sum("n")).first()[0] or 0
    marked = join_counted(points, twice, ["gram"], "n", n_points, parts)
    gather = lambda rows, *names: rows.groupBy("digest").agg(F.collect_list(F.struct(*names)).alias("marks"))

    def context(t: bytes, at: int) -> tuple[int, bytes]:
        low = max(0, at - (length - gram))
        return at - low, t[low : at + length]

    def unpacked(batch: pd.DataFrame) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for digest, packed, marks in zip(batch.digest, batch.packed, batch.marks, strict=True):
            yield digest, unpack.decompress(packed), marks

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: dict = {}
            for digest, t, marks in unpacked(batch):
                for m in marks:
                    left, c = context(t, m["at"])
                    rows.setdefault((digest, m["gram"], hashlib.md5(left.to_bytes(4, "little") + c).digest(), left, len(c) - left), []).append(m["at"])
            yield pd.DataFrame([(*k, v) for k, v in rows.items()], columns=["digest", "gram", "kind", "before", "after", "at"])

    found = texts.join(gather(marked, "at", "gram"), "digest").mapInPandas(name, "digest binary, gram long, kind binary, before int, after int, at array<int>")
    found = scratch.table(found, "contexts")
    scratch.drop(twice)
    kinds = found.groupBy("gram", "kind", "before", "after").agg(F.sum(F.size("at")).alias("n"), F.min(F.struct("digest", F.col("at")[0].alias("at"))).alias("one"))
    kinds = scratch.table(kinds, "kinds")
    crowd = scratch.table(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowds")
    n_kinds = crowd.agg(F.sum("size"), F.max("size")).first()
    node = join_counted(kinds.select("gram", "kind", "one.digest", "one.at"), crowd, ["gram"], "size", n_kinds[0] or 0, parts)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(m["gram"], m["kind"], *context(t, m["at"])) for _, t, marks in unpacked(batch) for m in marks]
            yield pd.DataFrame(out, columns=["gram", "kind", "before", "context"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(gram, kind, before, context):
            least, most = repeats(context, before, gram, length, chunk_gram)
            hit = np.flatnonzero(most >= 0)
            return pd.DataFrame({"gram": gram[hit], "kind": [kind[i] for i in hit], "least": least[hit], "most": most[hit]})

        held = None
        for batch in batches:
            got = [batch.gram.to_numpy(), batch.kind.tolist(), batch.before.to_numpy().astype(np.int64), batch.context.tolist()]
            held = got if held is None else [a + b if isinstance(a, list) else np.concatenate([a, b]) for a, b in zip(held, got, strict=True)]
            while len(held[0]) > chunk:
                cut = int(np.searchsorted(held[0], held[0][chunk]))  # groups stay whole
                cut = cut or int(np.searchsorted(held[0], held[0][0], side="right"))
                if cut == len(held[0]):
                    break
                yield solved(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield solved(*held)

    chunk_gram = gram
    near = texts.join(gather(node.where(F.col("size") <= max_group), "at", "gram", "kind"), "digest").mapInPandas(fetch, "gram long, kind binary, before int, context binary")
    near = near.repartition(parts, "gram").sortWithinPartitions("gram").mapInPandas(solve, "gram long, kind binary, least int, most int")
    if (n_kinds[1] or 0) > max_group:
        near = near.unionByName(_crowded(texts, node.where(F.col("size") > max_group), gather, unpacked, length, gram, parts))
    own = kinds.where("n > 1").select("gram", "kind", F.greatest(F.lit(0), F.lit(length) - F.col("after")).alias("least"), F.col("before").alias("most")).where("least <= most")
    ends = near.unionByName(own).groupBy("gram", "kind").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    ends = scratch.table(ends.join(kinds.select("gram", "kind", "n"), ["gram", "kind"]), "ends")
    spans = join_counted(found, ends, ["gram", "kind"], "n", n_points, parts).select("digest", F.explode("at").alias("at"), "least", "most")
    spans = spans.select("digest", F.struct((F.col("at") - F.col("most")).cast("long").alias("a"), (F.col("at") - F.col("least") + length).cast("long").alias("b")).alias("span"))
    spans = scratch.table(spans.groupBy("digest").agg(F.collect_list("span").alias("spans")), "spans")
    scratch.drop(found, kinds, crowd, ends)
    return seen, spans


def _crowded(texts: DataFrame, node: DataFrame, gather, unpacked, length: int, gram: int, parts: int) -> DataFrame:
    """gram, kind, least and most of the contexts ``node`` of k-grams with very many contexts, by the digests of longer strings, so that no group meets in a task.

    The places at which a string may start before the anchor are cut into some sqrt(length) ranges. What all strings of a range have in common is a string
    itself, and contexts that share none of a range's strings differ in most of these; what they cover together is another, and contexts that have that in
    common with others share all strings of the range. Where only the former holds, the strings themselves are counted, one context of each kind.
    """
    places = length - gram + 1
    step = max(1, round(places**0.5))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for digest, t, marks in unpacked(batch):
                for m in marks:
                    at = m["at"]
                    for a in range(0, places, step):
                        b = min(a + step, places) - 1
                        low, high = max(a, at + length - len(t)), min(b, at)
                        if low <= high:
                            core = hashlib.md5(a.to_bytes(4, "little") + t[at - a : at - b + length]).digest()
                            whole = hashlib.md5(b"%d %d " % (low, high) + t[at - high : at - low + length]).digest()
                            out.append((m["gram"], m["kind"], digest, at, low, high, int.from_bytes(core[:8], "little", signed=True), whole))
            yield pd.DataFrame(out, columns=["gram", "kind", "digest", "at", "low", "high", "core", "whole"])

    parted = texts.join(gather(node, "at", "gram", "kind"), "digest").mapInPandas(ranges, "gram long, kind binary, digest binary, at int, low int, high int, core long, whole binary")
    parted = scratch.table(parted, "ranges")
    kinds = parted.groupBy("gram", "core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "at", "kind", "low", "high")).alias("one"))
    kinds = scratch.table(kinds, "range-kinds")
    cores = scratch.table(kinds.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cores")
    total = kinds.agg(F.sum("n"), F.count(F.lit(1))).first()
    same = kinds.where("n > 1").select("gram", "core", "whole", "n")
    whole = join_counted(parted.select("gram", "kind", "low", "high", "core", "whole"), same, ["gram", "core", "whole"], "n", total[0] or 0, parts)
    whole = whole.select("gram", "kind", F.col("low").alias("least"), F.col("high").alias("most"))
    open_ = join_counted(kinds.select("gram", "core", "one"), cores, ["gram", "core"], "size", total[1] or 0, parts)

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, t, marks in unpacked(batch):
                for m in marks:
                    at = m["at"]
                    out += [(m["gram"], m["kind"], i, hashlib.md5(i.to_bytes(4, "little") + t[at - i : at - i + length]).digest()) for i in range(m["low"], m["high"] + 1)]
            yield pd.DataFrame(out, columns=["gram", "kind", "i", "string"])

    singles = texts.join(gather(open_.select("gram", "one.*"), "at", "gram", "kind", "low", "high"), "digest").mapInPandas(single, "gram long, kind binary, i int, string binary")
    singles = scratch.table(singles, "strings")
    often = scratch.table(singles.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    strings = join_counted(singles, often, ["string"], "n", often.agg(F.sum("n")).first()[0] or 0, parts)
    strings = strings.groupBy("gram", "kind").agg(F.min("i").alias("least"), F.max("i").alias("most"))
    out = scratch.table(whole.groupBy("gram", "kind").agg(F.min("least").alias("least"), F.max("most").alias("most")).unionByName(strings), "crowded")
    scratch.drop(parted, kinds, cores, singles, often)
    return out


def widen(text: bytes) -> bytes:
    """``text`` with every word of fewer than ``WIDE`` bytes followed by as many ``PAD`` as it lacks."""
    data = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    start, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    return np.insert(data, np.repeat(end, np.maximum(WIDE - (end - start), 0)), PAD).tobytes()


def narrow(wide: bytes) -> bytes:
    return wide.replace(bytes([PAD]), b"")


def long_runs(wide: bytes, spans, length: int, words: int) -> list[tuple[int, int]]:
    """The runs that ``spans`` cover together, of those with ``words`` words or ``length`` bytes, padding left out."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept = [(a, b, narrow(wide[a:b])) for a, b in runs]
    return [(a, b) for a, b, t in kept if len(t) >= length or len(t.split()) >= words]


def repeats_digest(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    texts, spans = find_repeats(docs, length, gram=max(1, length // 4), **options)

    @F.pandas_udf("struct<n_removed: long, n_spans: long, kept_sha256: string>")
    def cut(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
        unpack, rows = zstandard.ZstdDecompressor(), []
        for t, s in zip(packed, spans, strict=True):
            kept, removed, runs = _cut(unpack.decompress(t), [(x["a"], x["b"]) for x in s])
            rows.append((removed, runs, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])

    part = texts.where("copies = 1").join(spans, "digest").select("digest", cut("packed", "spans").alias("c")).select("digest", "c.*")
    gone = texts.where("copies > 1").select("digest", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    cuts = scratch.table(part.unionByName(gone), "cuts")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    ids = scratch.table(docs.select("doc_id", text_key(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "ids")
    scratch.drop(texts, spans)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    out = join_texts(ids, "digest", cuts, parts)
    return out.select("doc_id", "n_bytes", *(F.coalesce(f"digest.{c}", F.lit(0)).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("digest.kept_sha256", "sha").alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, **options) -> DataFrame:
    """``docs`` with repeated passages of ``words`` words or ``length`` bytes taken out of text (parts of characters go too) and n_chars, if there, counted
    anew. Null texts become empty.

    Strings are found in widened texts, where either is at least ``least`` bytes: of ``length`` bytes that start inside a short word, up to WIDE - 1 go
    unseen, as its padding differs. Runs of repeated strings that are shorter than both stay.
    """
    least = min(length - WIDE + 1, words * (WIDE + 1) - 1)

    @F.pandas_udf("string")
    def cut(packed: pd.Series, spans: pd.Series) -> pd.Series:
        unpack, kept = zstandard.ZstdDecompressor(), []
        for t, s in zip(packed, spans, strict=True):
            t = unpack.decompress(t)
            runs = long_runs(t, [(x["a"], x["b"]) for x in s], least, words)
            kept.append(narrow(_cut(t, runs)[0]).decode("utf-8", "ignore") if runs else None)
        return pd.Series(kept, dtype=object)

    spark = docs.sparkSession
    key = scratch.fresh(docs, "digest")
    texts, spans = find_repeats(docs, least, gram=max(1, least // 4), prepare=widen, **options)
    part = texts.where("copies = 1").join(spans, "digest").select(F.col("digest").alias(key), cut("packed", "spans").alias("kept")).where("kept IS NOT NULL")

    @F.pandas_udf("boolean")
    def gone(packed: pd.Series) -> pd.Series:
        whole = [zstandard.ZstdDecompressor().decompress(t) for t in packed]
        return pd.Series([bool(long_runs(t, [(0, len(t))], least, words)) for t in whole])

    # A text with copies is one repeat as a whole; below both lengths it stays.
    cuts = scratch.table(part.unionByName(texts.where("copies > 1").where(gone("packed")).select(F.col("digest").alias(key), F.lit("").alias("kept"))), "cuts")
    scratch.drop(texts, spans)
    rows = join_texts(docs.withColumn(key, text_key(docs["text"].cast("binary"))), key, cuts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    text = F.coalesce(F.col(key)["kept"], rows["text"].cast("string"), F.lit(""))
    given = [text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else rows[scratch.quoted(c)] for c in docs.columns]
    return rows.select(*given)
