"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, the last padded with zeros. The binary Golay code is perfect:
each 23-bit word has one codeword within 3 bits; taking all codewords within 4 gives one or six keys a segment, and two words
at most 2 bits apart always share one (that of a word halfway between them). By pigeonhole, fingerprints that differ in 4 bits or fewer
have two segments that differ in 2 or fewer each, so they share a pair of codeword indices, the key that they are joined by.
Distances are verified inside the key groups, whose links go out as a spanning forest: never all pairs of a group. Work is
on distinct fingerprints, so exact copies cost one row.

Defined results: null or empty text has no words and fingerprint zero, linked like any other; null doc_ids are ignored in
the smallest id of a component; repeated rows stay; very long texts are hashed whole; extra columns are ignored, or kept by ``drop_near_duplicates``,
which keeps one of repeated rows. There, null texts and those of white space alone are copies of the empty text.

The pipeline's ``drop_near_duplicates`` takes its candidates from the same keys of SimHash fingerprints and verifies them by the Jaccard similarity
of shingles. Fingerprints don't follow that closely enough to reach all links (an added passage moves many bits), so texts that are apart after
this step, and only these, are looked up again under bands of least hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch
from sparkloom.llm.components import components

#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a fixed value.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Members of a set that are compared, all up to this number; and standard deviations left to what a sample of more says: a link right at the
#: threshold is missed some three times in 10^5.
SAMPLE, SIGMAS = 1024, 4
#: Keys of a set: ``BANDS``, each of its least hashes in ``ROWS`` orders. Two sets of Jaccard similarity J have none in common with a chance of
#: (1 - J^ROWS)^BANDS: some 5 in 10^8 at 0.8, less above. The first ``EARLY`` bands give the pairs that are verified first of those under bands.
BANDS, ROWS, EARLY = 32, 4, 4
#: Bits in which fingerprints of candidates differ at most; sets of one size and Jaccard similarity 0.8 have a cosine of 0.89, so 9.7 bits on average.
BITS = 10
TURN = np.random.default_rng(64).integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
WEIGHT = np.random.default_rng(65).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and low 12 bits, and by syndrome the errors of weight 4 or less, -1 where there are fewer than six."""
    part = np.arange(4096, dtype=np.int64)
    errors = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for mask, s in zip(masks, _remainder(masks), strict=True):
            errors[s, used[s]] = mask
            used[s] += 1
    return _remainder(part << 12 & (1 << 23) - 1), _remainder(part), errors


def codewords(words: np.ndarray, tables) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word, -1 as padding."""
    high, low, errors = tables
    e = errors[high[words >> 12] ^ low[words & 4095]]
    return np.where(e >= 0, (words[:, None] ^ e) >> 11, -1)


def keys(fp: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(place in fp, key) for every pair of codeword indices of two segments."""
    code = [codewords((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64), tables) for at, n in SEGMENTS]
    where, out = [], []
    for k, (a, b) in enumerate(PAIRS):
        key = (k << 24) + (code[a][:, :, None] << 12) + code[b][:, None, :]
        fine = (code[a][:, :, None] >= 0) & (code[b][:, None, :] >= 0)
        where.append(np.nonzero(fine)[0])
        out.append(key[fine])
    return np.concatenate(where), np.concatenate(out)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a label is the smallest place of its component."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, buffer: int = 1 << 20, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints under one key that are ``radius`` bits or fewer apart; key is sorted. Row pairs are taken lag
    by lag, so memory follows the rows, not the pairs. ``direct``: only of pairs that are themselves no further apart."""
    value, place = np.unique(fp, return_inverse=True)
    label, held, count, found = np.arange(len(value)), [], 0, [(place[:0], place[:0])]
    at, lag = np.arange(len(key)), 0

    def settle():
        nonlocal label, held, count
        if held:
            a, b = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            if direct:
                label, a, b = forest(label, a, b)
                found.append((a, b))
            else:
                label = merge(label, a, b)
        held, count = [], 0

    while True:
        lag += 1
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        a, b = place[at], place[at + lag]
        link = (popcount(fp[at] ^ fp[at + lag]) <= radius) & (label[a] != label[b])
        if link.any():
            held.append((a[link], b[link]))
            count += int(link.sum())
            if count > buffer or lag in (1, 2, 4, 8, 16, 32, 64, 128, 256):
                settle()
    settle()
    if direct:
        return value[np.concatenate([f[0] for f in found])], value[np.concatenate([f[1] for f in found])]
    joined = np.flatnonzero(label != np.arange(len(value)))
    return value[label[joined]], value[joined]


def sample(hashes: np.ndarray) -> tuple[int, bytes]:
    """Level and 32-bit hashes, in order, of a set: all of them at level 0; at level n those below 2^(32 - n), the first n that leaves ``SAMPLE`` or fewer."""
    h, level = np.unique(hashes.view(np.uint64) >> np.uint64(32)), 0
    while len(h) > SAMPLE:
        level += 1
        h = h[: np.searchsorted(h, 1 << 32 - level)]
    return level, h.astype(np.uint32).tobytes()


def band_keys(hashes: np.ndarray, step: int = 4096) -> np.ndarray:
    """The keys of a set of 64-bit hashes, band by band; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    x = hashes.view(np.uint64)
    x = (x ^ x >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), step):
        np.minimum(least, (TURN * x[at : at + step]).min(1), out=least)
    key = (least.astype(np.uint64).reshape(BANDS, ROWS) * WEIGHT).sum(1, dtype=np.uint64)
    key ^= key >> np.uint64(29)
    return (key * WEIGHT[0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def in_common(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every two sets: products of their incidence matrices, ``width`` members at a time."""
    member, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    often = np.bincount(column, minlength=len(member)) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for first in range(0, int(often.sum()), width):
        i, j = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[i:j], column[i:j] - first] = 1
        out += part @ part.T
    return out


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the links a[i], b[i] that join the components of ``label`` without a cycle, and the labels then."""
    us, vs = [a[:0]], [b[:0]]
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label, np.concatenate(us), np.concatenate(vs)
        a, b = a[open_], b[open_]
        first = np.unique(np.maximum(x, y)[open_], return_index=True)[1]
        us.append(a[first])
        vs.append(b[first])
        label = merge(label, a[first], b[first])


def class_links(size: np.ndarray, group: np.ndarray, level: np.ndarray, sets: list[np.ndarray], similarity: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places, block by block, of rows of different classes that have ``similarity``: a spanning forest of those that surely have it by their sets, and all
    others that have it by samples, less ``SIGMAS`` standard deviations, or but for a collision of hashes. ``size`` is that of the whole sets, in order;
    sets of level 0 have all 64 bits of their hashes, so two of them are sure or no link."""
    n = len(size)
    _, first, of = np.unique(group, return_index=True, return_inverse=True)
    label = first[of]
    whole, sets = sets, [x if lv else np.unique(x >> np.uint64(32)).astype(np.uint32) for x, lv in zip(sets, level.tolist(), strict=True)]
    count = np.array([len(x) for x in sets])
    next_ = np.array([np.searchsorted(x, 1 << 31 - lv) for x, lv in zip(sets, level.tolist(), strict=True)])
    for i in range(0, n, block):
        for j in range(i, n, block):
            x = np.arange(i, min(i + block, n))
            y = x if i == j else np.arange(j, min(j + block, n))
            if size[x[-1]] < similarity * size[y[0]]:
                break  # too few for all that follow
            fits = (label[x][:, None] != label[y][None]) & (size[x][:, None] >= similarity * size[y][None]) & (x[:, None] < y[None]) & (np.abs(level[x][:, None] - level[y][None]) <= 1)
            a, b = np.nonzero(fits)
            if not len(a):
                continue
            both = x if i == j else np.concatenate([x, y])
            if not level[both].any():
                a, b, common = x[a], y[b], in_common([whole[k] for k in both])[a, b if i == j else b + len(x)]
                sure = common >= similarity * (size[a] + size[b] - common)
                label, u, v = forest(label, a[sure], b[sure])
                if len(u):
                    yield u, v
                continue
            a, b, common = x[a], y[b], in_common([sets[k] for k in both])[a, b if i == j else b + len(x)]
            of_a, of_b = np.where(level[a] < level[b], next_[a], count[a]), np.where(level[b] < level[a], next_[b], count[b])
            all_ = of_a + of_b - common
            sampled = (level[a] > 0) | (level[b] > 0)
            sure = ~sampled & (common - 2 >= similarity * all_)
            fits = ~sure & (common + 2 >= similarity * all_ - np.where(sampled, SIGMAS * np.sqrt(similarity * (1 - similarity) * all_), 0))
            label, u, v = forest(label, a[sure], b[sure])
            fits &= label[a] != label[b]
            if len(u) or fits.any():
                yield np.concatenate([u, a[fits]]), np.concatenate([v, b[fits]])


def whole_keys(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, put together to some ``chunk`` rows with no key cut apart."""
    held, n, due = [], 0, chunk
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= due:
            rows = pd.concat(held, ignore_index=True)
            key = rows.key.to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield rows[:cut]
            held, n = [rows[cut:]], len(rows) - cut
            due = max(chunk, 2 * n)
    if n:
        yield pd.concat(held, ignore_index=True)


def by_key(rows: DataFrame, step: int = 2000) -> DataFrame:
    """``rows`` (with fp long) under each of their keys, sorted by key and fp within partitions of whole keys; ``step`` rows are spread at once."""
    tables, kinds = golay_tables(), ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch[at : at + step]
                where, key = keys(part.fp.to_numpy().view(np.uint64), tables)
                yield part.iloc[where].assign(key=key)

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.mapInPandas(spread, f"{kinds}, key int").repartition(parts, "key").sortWithinPartitions("key", "fp")


def links(fps: DataFrame, radius: int = 4, chunk: int = 1_000_000, direct: bool = False) -> DataFrame:
    """u, v: a spanning forest, key by key, of linked fingerprints, from the distinct ``fps`` (fp long); ``direct`` as in ``bucket_links``."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_keys(batches, chunk):
            u, v = bucket_links(rows.key.to_numpy(), rows.fp.to_numpy().view(np.uint64), radius, direct=direct)
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return by_key(fps.select("fp")).mapInPandas(join, "u long, v long")


def links_between(texts: DataFrame, similarity: float, chunk: int = 10_000) -> DataFrame:
    """tu, tv: links that join the same ``texts`` (key, tid, root; size, level and sample of their shingles) as all links between different roots under a
    shared key of ``similarity``; some may fall short of it."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_keys(batches, chunk):
            key, size, level = rows.key.to_numpy(), rows["size"].to_numpy(), rows.level.to_numpy()
            tid, group = rows.tid.to_numpy(), pd.factorize(rows.root)[0]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(start[1:], len(key))
            for k in np.flatnonzero(np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)):
                at = slice(start[k], end[k])
                for a, b in class_links(size[at], group[at], level[at], [np.frombuffer(x, np.uint32 if lv else np.uint64) for x, lv in zip(rows["sample"][at], level[at], strict=True)], similarity):
                    u, v = tid[at][a], tid[at][b]
                    yield pd.DataFrame({"tu": np.where(u < v, u, v), "tv": np.where(u < v, v, u)})

    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = texts.select("key", "tid", "root", "size", "level", "sample").repartition(parts, "key").sortWithinPartitions("key", "size")
    return rows.mapInPandas(join, "tu string, tv string").distinct()


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``n`` words, joined by spaces; of all of them if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - np.array([len(w) + 1 for w in words])
    k = min(n, len(words))
    return np.fromiter((digest(text[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - k + 1)


def words_of(text) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return [] if text is None else bytes(text).lower().split()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (as a signed long)."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(words_of(t), shingle)) for t in text], np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.col("text").cast("binary")).alias("fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    if radius > 4:
        raise ValueError("keys are complete up to 4 bits")
    scratch.small_batches(docs.sparkSession)
    marks = scratch.table(fingerprints(docs, shingle), "fingerprints")
    groups = scratch.table(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(links(groups.select("fp"), radius))
    placed = groups.join(roots, groups.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(smallest, "root").select("fp", "component_id")
    return marks.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(texts: DataFrame, radius: int = BITS) -> DataFrame:
    """tu, tv: pairs of different ``texts`` (tid, fp) of equal fingerprints, each with the first one, and of fingerprints that share a key and are
    ``radius`` bits or fewer apart, key by key a spanning forest of these."""
    heads = scratch.table(texts.groupBy("fp").agg(F.min("tid").alias("head")), "heads")
    equal = texts.join(heads, "fp").where("tid <> head").select(F.col("head").alias("tu"), F.col("tid").alias("tv"))
    near = links(heads.select("fp"), radius, direct=True).distinct()
    near = near.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("tu")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("tv")), "v")
    pairs = scratch.table(equal.unionByName(near.select("tu", "tv")), "near")
    scratch.drop(heads)
    return pairs


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near-duplicates.

    Copies are linked where the Jaccard similarity of their distinct ``shingle``-word shingles is ``similarity`` or more. Candidates are texts whose
    SimHash fingerprints, of these shingles, share a pair of codewords and differ in ``BITS`` bits or fewer; they are verified. For the links that these
    miss, texts that are apart then but share one of their ``BANDS`` keys follow: each is verified with the first text under its ``EARLY`` keys. Where
    a key then still has texts that are apart, all of these are compared under it by their shingles, or samples of them where there are
    over ``SAMPLE``, and verified if these allow the similarity; pairs of texts that are joined already are never made.
    """
    scratch.small_batches(docs.sparkSession)

    @F.pandas_udf("struct<fp: long, keys: array<long>>")
    def marked(text: pd.Series) -> pd.DataFrame:
        hashes = [np.unique(shingle_hashes(words_of(t), shingle)) for t in text]
        return pd.DataFrame({"fp": np.array([simhash(h) for h in hashes], np.uint64).view(np.int64), "keys": [band_keys(h) for h in hashes]})

    @F.pandas_udf("array<long>")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words_of(t), shingle)).view(np.int64) for t in text])

    @F.pandas_udf("struct<level: int, sample: binary>")
    def sampled(s: pd.Series) -> pd.DataFrame:
        found = [(x, *sample(np.asarray(x, np.int64))) for x in s]
        return pd.DataFrame([(lv, h if lv else np.asarray(x, np.int64).tobytes()) for x, lv, h in found], columns=["level", "sample"])

    tid = F.md5(F.coalesce(F.btrim(docs["text"].cast("string"), F.lit(" \t\n\x0b\x0c\r")), F.lit("")).cast("binary"))
    text = docs["text"].cast("binary")
    marks = scratch.table(docs.select("doc_id", tid.alias("tid"), marked(text).alias("m")).select("doc_id", "tid", "m.*"), "marks")
    texts = scratch.table(marks.groupBy("tid").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "texts")
    marks = marks.select("doc_id", "tid")
    pairs = fingerprint_pairs(texts.where(F.size("keys") > 0).select("tid", "fp"))
    keyed = texts.select("tid", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("head")).where("n > 1").select("key", "head")
    member = scratch.table(keyed.join(shared, "key"), "keys")
    wanted = member.select("tid").unionByName(pairs.select(F.explode(F.array("tu", "tv")).alias("tid"))).distinct().join(texts.select("tid", "least"), "tid")
    # One row of each wanted text, found by its doc_id too, so that the rows of a text with many copies don't meet in a task.
    sets = docs.select(F.col("doc_id").alias("least"), tid.alias("tid"), text.alias("text"))
    sets = sets.join(wanted, (sets.tid == wanted.tid) & sets.least.eqNullSafe(wanted.least), "left_semi")
    sets = scratch.table(sets.dropDuplicates(["tid"]).select("tid", F.monotonically_increasing_id().alias("sid"), shingles("text").alias("s")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("tid").alias("tu"), F.col("s").alias("a")), "tu").join(sets.select(F.col("tid").alias("tv"), F.col("s").alias("b")), "tv")
        common = F.size(F.array_intersect("a", "b"))
        return both.where(common >= similarity * (F.size("a") + F.size("b") - common)).select(F.col("tu").alias("u"), F.col("tv").alias("v"))

    def place(linked: DataFrame) -> DataFrame:
        roots = components(linked)
        return texts.join(roots, texts.tid == roots.node, "left").select("tid", "least", F.coalesce("root", "tid").alias("root"))

    def apart(rows: DataFrame) -> DataFrame:
        """Rows under keys that have texts of different roots."""
        return rows.join(rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key"), "key", "left_semi")

    by_fp = scratch.table(verified(pairs), "linked")
    roots = scratch.table(place(by_fp).select("tid", "root"), "classes")
    early = member.where((F.col("band") < EARLY) & (F.col("tid") != F.col("head"))).select(F.col("head").alias("tu"), F.col("tid").alias("tv")).distinct()
    early = early.join(roots.select(F.col("tid").alias("tu"), F.col("root").alias("ru")), "tu").join(roots.select(F.col("tid").alias("tv"), F.col("root").alias("rv")), "tv")
    linked = scratch.table(by_fp.unionByName(verified(early.where("ru <> rv").select("tu", "tv"))), "linked")
    placed = scratch.table(place(linked), "placed")
    scratch.drop(pairs, by_fp, roots)
    open_ = scratch.table(apart(member.select("tid", "key").join(placed.select("tid", "root"), "tid")), "apart")
    scratch.drop(member)
    some = sets.join(open_.select("tid").distinct(), "tid", "left_semi")
    # A shingle that no other of these texts has is in no intersection.
    alone = some.select("sid", F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid")).where("n = 1").groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
    some = some.join(alone, "sid", "left").where(F.size("s") - F.coalesce("alone", F.lit(0)) >= similarity * F.size("s"))
    some = scratch.table(some.select("tid", F.size("s").alias("size"), sampled("s").alias("m")).select("tid", "size", "m.*"), "samples")
    left = scratch.table(apart(open_.join(some.select("tid"), "tid", "left_semi")), "open")
    scratch.drop(open_)
    if left.limit(1).count():
        more = verified(scratch.table(links_between(left.join(some, "tid"), similarity), "pairs"))
        placed = place(linked.unionByName(more))
    winners = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "tid")).alias("w")).select("w.least", "w.tid")
    # A text's rows of the winning doc_id; usually one each.
    chosen = marks.join(winners, (marks.tid == winners.tid) & marks.doc_id.eqNullSafe(winners.least), "left_semi").groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n"))
    id_, key = scratch.fresh(docs, "id"), scratch.fresh(docs, "tid")
    chosen = scratch.table(chosen.select(F.col("doc_id").alias(id_), F.col("tid").alias(f"{key}_"), "n"), "chosen")
    scratch.drop(texts, sets, linked, some, left)
    tagged = docs.withColumn(key, tid)
    fits = (tagged[key] == chosen[f"{key}_"]) & tagged["doc_id"].eqNullSafe(chosen[id_])
    kept = tagged.join(chosen.where("n = 1"), fits, "left_semi")
    if chosen.where("n > 1").limit(1).count():
        kept = kept.unionByName(tagged.join(chosen.where("n > 1"), fits, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.drop(key)
