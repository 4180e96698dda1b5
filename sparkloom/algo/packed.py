"""Neighbour lists packed by ranges of ids: a row holds a range's lists as compressed arrays, so that an edge is moved at a few bytes, and wedges are never rows."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch

#: Ends in a row of lists, pairs sorted at a time, rows of lists that a task of ``_closed`` holds, wedges tested at a time.
ROW, CHUNK, ROWS, WEDGES = 2_500_000, 1_000_000, 6, 2_000_000
LISTS = "b int, kind int, ids binary, counts binary, ends binary"


def enc(x: np.ndarray) -> bytes:
    """Longs as differences, in the fewest bytes that hold the largest, byte by byte, compressed."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(z) or int(z.max()) < 1 << (8 * w))
    raw = np.ascontiguousarray(z.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    return struct.pack("<BQ", width, len(x)) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def dec(b: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", b)
    if not n:
        return np.empty(0, np.int64)
    raw = np.frombuffer(pa.decompress(b[9:], decompressed_size=width * n, codec="zstd", asbytes=True), np.uint8)
    z = np.ascontiguousarray(raw.reshape(width, n).T).view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


def ordered(src: np.ndarray, dst: np.ndarray, distinct: bool):
    """Sorted by src, dst."""
    if not len(src):
        return src, dst
    a, c = int(src.min()), int(dst.min())
    wide = int(dst.max()) - c + 1
    if (int(src.max()) - a + 1) * wide < 1 << 62:
        key = np.sort((src - a) * wide + (dst - c))
        key = key[np.append(True, key[1:] != key[:-1])] if distinct else key
        return key // wide + a, key % wide + c
    at = np.lexsort((dst, src))
    src, dst = src[at], dst[at]
    keep = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])) if distinct else slice(None)
    return src[keep], dst[keep]


def grouped(src: np.ndarray):
    """The different ones of sorted ``src`` and how many there are of each."""
    at = np.flatnonzero(np.append(True, src[1:] != src[:-1])) if len(src) else np.empty(0, np.int64)
    return src[at], np.diff(np.append(at, len(src)))


def _cliques(o: np.ndarray, ids: np.ndarray):
    """All pairs, smaller id first, of each set of rows sorted by set and id."""
    at, d = np.arange(len(o)), 1
    while len(at):
        at = at[at + d < len(o)]
        at = at[o[at] == o[at + d]]
        if len(at):
            yield ids[at], ids[at + d]
        d += 1


def _of_sets(batches):
    held = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        o, ids = np.append(held[0], batch.o.to_numpy()), np.append(held[1], batch.id.to_numpy())
        if not len(o):
            continue
        keep = np.append(True, (o[1:] != o[:-1]) | (ids[1:] != ids[:-1]))
        o, ids = o[keep], ids[keep]
        last = np.searchsorted(o, o[-1])  # the last set may go on in the next batch
        held = o[last:], ids[last:]
        yield from _cliques(o[:last], ids[:last])
    yield from _cliques(*held)


@dataclass
class Packed:
    """``rows``: b, kind, ids, counts, ends: range b's ids, the length of each one's list and the lists. ``bounds``: where ranges begin, but the first."""

    rows: DataFrame
    bounds: np.ndarray


def lists(e: DataFrame, both: bool = True, distinct: bool = True, back: bool = False, loops: bool = False, bounds: np.ndarray | None = None) -> Packed:
    """Of every id with neighbours, in ranges of about equal numbers of ends: the sorted neighbours, itself only with ``loops``; ``both`` ways, or dst by src, or src by dst if ``back``.
    An ``e`` that joins the members of sets, smaller id first (``_sets`` makes them: o, id), is made here, set by set."""
    sets = e._sets() if hasattr(e, "_sets") else None
    if sets is not None:
        ids, per = sets.select("id"), 4 if both else 2
    else:
        e = e.where("src IS NOT NULL AND dst IS NOT NULL" if loops else "src <> dst").select("src", "dst")
        ids, per = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))), 1
    joined = sets is not None
    if bounds is None:
        parts = 1 + ids.count() * per // ROW
        cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
        bounds = np.unique(np.array(cuts or [], np.int64))

    def packed(src, dst):
        src, dst = np.concatenate(src), np.concatenate(dst)
        if both:
            src, dst = np.append(src, dst), np.append(dst, src)
        src, dst = ordered(*((dst, src) if back and not both else (src, dst)), distinct)
        b, n = grouped(np.searchsorted(bounds, src, "right"))
        to = np.cumsum(n)
        return pd.DataFrame({"b": b, "src": [enc(src[j - k : j]) for j, k in zip(to, n)], "dst": [enc(dst[j - k : j]) for j, k in zip(to, n)]})

    def pack(batches):
        src, dst, n = [], [], 0
        for s, d in _of_sets(batches) if joined else ((x.src.to_numpy(), x.dst.to_numpy()) for x in batches):
            src.append(s), dst.append(d)
            n += len(s)
            if n >= CHUNK:
                yield packed(src, dst)
                src, dst, n = [], [], 0
        if n:
            yield packed(src, dst)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        src, dst = ordered(np.concatenate([dec(x) for x in frame.src]), np.concatenate([dec(x) for x in frame.dst]), distinct)
        ids, counts = grouped(src)
        return pd.DataFrame({"b": [frame.b[0]], "kind": [0], "ids": [enc(ids)], "counts": [enc(counts)], "ends": [enc(dst)]})

    pairs = sets.repartition("o").sortWithinPartitions("o", "id") if joined else e
    rows = pairs.mapInPandas(pack, "b int, src binary, dst binary").groupBy("b").applyInPandas(merge, LISTS)
    return Packed(scratch.table(rows, "lists"), bounds)


def parts_of(counts: np.ndarray, ends: np.ndarray, part: np.ndarray):
    """For each part that ends are in: the part and which lists have one there."""
    at = np.repeat(np.arange(len(counts)), counts)
    for j in np.unique(part):
        yield j, np.unique(at[part == j])


WEIGHTS = {"one": lambda k: np.ones(len(k)), "log": lambda k: np.where(k > 1, 1 / np.log(np.maximum(k, 2)), 0.0), "inverse": lambda k: 1 / k}


def oriented(p: Packed, weight: str = "one") -> DataFrame:
    """Of lists both ways: each id's degree k, the sum of its neighbours' k (near) and of x(k) * (k - 1) for them (base), and its list cut to the neighbours after it by
    degree and id, with their degrees, so no list is long. Ranges tell each other the degrees."""
    bounds = p.bounds

    def tell(batches):
        for frame in batches:
            for r in frame.itertuples():
                ids, counts, ends = dec(r.ids), dec(r.counts), dec(r.ends)
                to = [(int(j), enc(ids[at]), enc(counts[at])) for j, at in parts_of(counts, ends, np.searchsorted(bounds, ends, "right"))]
                yield pd.DataFrame([(r.b, 0, r.ids, r.counts, r.ends), *((j, 1, i, k, None) for j, i, k in to)], columns=["b", "kind", "ids", "counts", "ends"])

    def orient(frame: pd.DataFrame) -> pd.DataFrame:
        own, told = frame[frame.kind == 0].iloc[0], frame[frame.kind == 1]
        ids, k, ends = dec(own.ids), dec(own.counts), dec(own.ends)
        near, nk = (np.concatenate([dec(x) for x in told[c]]) for c in ("ids", "counts"))
        at = np.argsort(near)
        ke = nk[at][np.searchsorted(near[at], ends)]
        row = np.repeat(np.arange(len(ids)), k)
        up = (k[row] < ke) | ((k[row] == ke) & (ids[row] < ends))
        sums = [np.bincount(row, w, len(ids)) for w in (ke, WEIGHTS[weight](ke) * (ke - 1))]
        return pd.DataFrame({"b": [own.b], "ids": [own.ids], "k": [own.counts], "counts": [enc(np.bincount(row[up], minlength=len(ids)))], "ends": [enc(ends[up])], "ke": [enc(ke[up])], "near": [sums[0].tobytes()], "base": [sums[1].tobytes()]})

    rows = p.rows.mapInPandas(tell, LISTS).groupBy("b").applyInPandas(orient, "b int, ids binary, k binary, counts binary, ends binary, ke binary, near binary, base binary")
    return scratch.table(rows, "oriented")


def nodes_of(rows: DataFrame) -> DataFrame:
    """id, k, near, base of ``oriented``."""

    def go(batches):
        for frame in batches:
            for r in frame.itertuples():
                yield pd.DataFrame({"id": dec(r.ids), "k": dec(r.k), "near": np.frombuffer(r.near), "base": np.frombuffer(r.base)})

    return rows.select("ids", "k", "near", "base").mapInPandas(go, "id long, k long, near double, base double")


class _Block:
    """The lists of some ranges, which other lists meet: for each edge (a, b) of these with b in the ranges, what the lists of a and b share."""

    def __init__(self, rows):
        self.ids, self.counts, ends = (np.concatenate([dec(r[c]) for r in rows]) for c in ("ids", "counts", "ends"))
        self.k = np.concatenate([dec(r["k"]) for r in rows])
        self.off = np.cumsum(self.counts) - self.counts
        self.far, first, at = np.unique(ends, return_index=True, return_inverse=True)
        self.ends = at.astype(np.int32)
        self.far_k = np.concatenate([dec(r["ke"]) for r in rows])[first] if rows[0]["ke"] is not None else None
        self.mask = np.zeros(len(self.far), np.uint64)
        self.sums = [np.zeros((2, len(x))) for x in (self.ids, self.far)]

    def met(self, counts: np.ndarray, ends: np.ndarray):
        """Edges as (list, place of b); the edge and the place in ``far`` of each end shared."""
        row = np.repeat(np.arange(len(counts)), counts)
        place = lambda x: (np.minimum(np.searchsorted(x, ends), max(0, len(x) - 1)), len(x))
        b, n = place(self.ids)
        own = self.ids[b] == ends if n else np.zeros(len(ends), bool)
        a, b = row[own], b[own]
        c, n = place(self.far)
        seen = self.far[c] == ends if n else np.zeros(len(ends), bool)
        crow, c = row[seen], c[seen]
        size = self.counts[b]
        edge, shared, done = [], [], np.append(0, np.cumsum(size))
        for first in range(0, len(counts), 64):  # a bit each
            lo, hi = np.searchsorted(crow, (first, first + 64))
            held = c[lo:hi]
            np.bitwise_or.at(self.mask, held, np.uint64(1) << (crow[lo:hi] - first).astype(np.uint64))
            at, end = np.searchsorted(a, (first, first + 64))
            while at < end:
                to = min(end, max(at + 1, int(np.searchsorted(done, done[at] + WEDGES, "right")) - 1))
                n, total = size[at:to], int(done[to] - done[at])
                if total:
                    far = self.ends[np.arange(total) + np.repeat(self.off[b[at:to]] - (done[at:to] - done[at]), n)]
                    hit = np.flatnonzero((self.mask[far] >> np.repeat((a[at:to] - first).astype(np.uint64), n)) & np.uint64(1))
                    edge.append(at + np.searchsorted(done[at + 1 : to + 1] - done[at], hit, "right"))
                    shared.append(far[hit])
                at = to
            self.mask[held] = 0
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return a, b, join(edge), join(shared)


def _closed(rows: DataFrame, bounds: np.ndarray, meet, left, schema: str) -> DataFrame:
    """``rows``: b, ids, k, counts, ends, ke. Every list goes to the tasks of the ranges that its ends are in, ``ROWS`` ranges a task: meet(block, list's row), left(block)."""
    names = ["j", "kind", "b", "ids", "k", "counts", "ends", "ke"]

    def send(batches):
        for frame in batches:
            for r in frame.itertuples():
                ids, k, counts, ends = map(dec, (r.ids, r.k, r.counts, r.ends))
                ke = None if r.ke is None else dec(r.ke)
                out = [(r.b // ROWS, 0, r.b, r.ids, r.k, r.counts, r.ends, r.ke)]
                row = np.repeat(np.arange(len(ids)), counts)
                for j, at in parts_of(counts, ends, np.searchsorted(bounds, ends, "right") // ROWS):
                    chosen = np.zeros(len(ids), bool)
                    chosen[at] = True
                    held = chosen[row]
                    out.append((int(j), 1, r.b, enc(ids[at]), enc(k[at]), enc(counts[at]), enc(ends[held]), None if ke is None else enc(ke[held])))
                yield pd.DataFrame(out, columns=names)

    def close(batches):
        own, block, now = [], None, None
        for frame in batches:
            for r in frame.to_dict("records"):
                if r["j"] != now:
                    if block is not None:
                        yield from left(block)
                    own, block, now = [], None, r["j"]
                if r["kind"] == 0:
                    own.append(r)
                elif own:
                    block = block or _Block(own)
                    yield from meet(block, r)
        if block is not None:
            yield from left(block)

    wide = "j int, kind int, b int, ids binary, k binary, counts binary, ends binary, ke binary"
    tasks = 4 * (1 + (len(bounds) + 1) // ROWS)
    spark, key = rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "8")  # rows are large
        sent = rows.mapInPandas(send, wide).repartition(tasks, "j").sortWithinPartitions("j", "kind", "b")
        return scratch.table(sent.mapInPandas(close, schema), "closed")
    finally:
        spark.conf.set(key, before)


def triangles(rows: DataFrame, bounds: np.ndarray, weight: str = "one") -> DataFrame:
    """id, t, s of ``oriented`` rows: the triangles that hold id, and the sum of x(k) over their other corners."""
    x = WEIGHTS[weight]

    def meet(block: _Block, r):
        ids, k, counts, ends = (dec(r[c]) for c in ("ids", "k", "counts", "ends"))
        a, b, edge, far = block.met(counts, ends)
        a, b = a[edge], b[edge]
        xa, xb, xc = x(k)[a], x(block.k)[b], x(block.far_k)[far]
        for sums, at, w in ((block.sums[0], b, xa + xc), (block.sums[1], far, xa + xb)):
            sums += [np.bincount(at, minlength=sums.shape[1]), np.bincount(at, w, sums.shape[1])]
        t = np.bincount(a, minlength=len(ids))
        some = t > 0
        yield pd.DataFrame({"id": ids[some], "t": t[some], "s": np.bincount(a, xb + xc, len(ids))[some]})

    def left(block: _Block):
        for ids, (t, s) in zip((block.ids, block.far), block.sums):
            some = t > 0
            yield pd.DataFrame({"id": ids[some], "t": t[some].astype(np.int64), "s": s[some]})

    got = _closed(rows.select("b", "ids", "k", "counts", "ends", "ke"), bounds, meet, left, "id long, t long, s double")
    return got.groupBy("id").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))


def shared(p: Packed, k: int) -> DataFrame:
    """id1, id2, similarity: of lists one way, the Jaccard similarity of the lists of both ends of every edge that share anything, the best ``k`` of an id1 of each task."""

    def meet(block: _Block, r):
        ids, counts, ends = (dec(r[c]) for c in ("ids", "counts", "ends"))
        a, b, edge, _ = block.met(counts, ends)
        c = np.bincount(edge, minlength=len(a))
        some = (c > 0) & (ids[a] != block.ids[b])
        a, b, c = a[some], b[some], c[some]
        s = c / (dec(r["k"])[a] + block.k[b] - c)
        at = np.lexsort((block.ids[b], -s, a))
        a, b, s = a[at], b[at], s[at]
        _, n = grouped(a)
        top = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) < k
        yield pd.DataFrame({"id1": ids[a[top]], "id2": block.ids[b[top]], "similarity": s[top]})

    rows = p.rows.select("b", "ids", F.col("counts").alias("k"), "counts", "ends", F.lit(None).cast("binary").alias("ke"))
    return _closed(rows, p.bounds, meet, lambda block: (), "id1 long, id2 long, similarity double")


def core_numbers(p: Packed) -> DataFrame:
    """u, c of lists both ways: an id takes the h-index of its neighbours' values, starting from degrees, until none falls. A range goes on by itself as far as it
    can, then ranges tell each other what fell."""
    bounds = p.bounds
    names = ["b", "kind", "ids", "counts", "ends", "x", "who", "near", "fell"]
    wide = "b int, kind int, ids binary, counts binary, ends binary, x binary, who binary, near binary, fell binary"

    def start(batches):
        for frame in batches:
            for r in frame.itertuples():
                who, far = np.unique(dec(r.ends), return_inverse=True)
                x = dec(r.counts)
                most = np.full(len(who), np.iinfo(np.int32).max)
                yield pd.DataFrame([(r.b, 0, r.ids, r.counts, enc(far), r.counts, enc(who), enc(most), np.ones(len(x), bool).tobytes())], columns=names)

    def tell(batches):
        for frame in batches:
            for r in frame.to_dict("records"):
                out, fell = [r], np.frombuffer(r["fell"], bool)
                if fell.any():
                    ids, x, counts = dec(r["ids"]), dec(r["x"]), dec(r["counts"])
                    row = np.repeat(np.arange(len(ids)), counts)
                    told = fell[row]
                    row = row[told]
                    part = np.searchsorted(bounds, dec(r["who"]), "right")[dec(r["ends"])[told]]
                    for j in np.unique(part):
                        if j != r["b"]:
                            at = np.unique(row[part == j])
                            out.append({"b": int(j), "kind": 2, "ids": enc(ids[at]), "x": enc(x[at])})
                yield pd.DataFrame(out, columns=names)

    def fall(frame: pd.DataFrame) -> pd.DataFrame:
        own, told = frame[frame.kind < 2].iloc[0], frame[frame.kind == 2]
        x = old = dec(own.x)
        near = dec(own.near)
        if own.kind == 0 or len(told):
            ids, counts, far, who = dec(own.ids), dec(own.counts), dec(own.ends), dec(own.who)
            for i, values in zip(told.ids, told.x):
                near[np.searchsorted(who, dec(i))] = dec(values)
            here = np.searchsorted(ids, who)
            here = np.where(ids[np.minimum(here, len(ids) - 1)] == who, here, -1)
            row, at = np.repeat(np.arange(len(x)), counts), np.cumsum(counts) - counts
            x = x.copy()
            while True:
                near[here >= 0] = x[here[here >= 0]]
                y = near[far]
                few = np.add.reduceat(y >= np.repeat(x, counts), at, dtype=np.int64) < x  # only these fall
                if not few.any():
                    break
                left = few[row]
                a, v = row[left], y[left]
                order = np.lexsort((-v, a))
                a, v = a[order], v[order]
                first, n = grouped(a)
                x[first] = np.maximum.reduceat(np.minimum(np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + 1, v), np.cumsum(n) - n)
        fell = np.ones(len(x), bool) if own.kind == 0 else x < old
        return pd.DataFrame({"b": [own.b], "kind": [1], "ids": [own.ids], "counts": [own.counts], "ends": [own.ends], "x": [enc(x)], "who": [own.who], "near": [enc(near)], "fell": [fell.tobytes()], "moved": [int(fell.sum())]})

    state = scratch.table(p.rows.mapInPandas(start, wide), "cores")
    scratch.drop(p.rows)
    while True:
        new = scratch.table(state.mapInPandas(tell, wide).groupBy("b").applyInPandas(fall, wide + ", moved long"), "cores")
        scratch.drop(state)
        state = new.drop("moved")
        state._scratch = new._scratch
        if not new.where("moved > 0").limit(1).count():
            return values_of(state, "c", "long")


def values_of(rows: DataFrame, name: str, kind: str) -> DataFrame:
    def go(batches):
        for frame in batches:
            for r in frame.itertuples():
                yield pd.DataFrame({"u": dec(r.ids), name: dec(r.x) if kind == "long" else np.frombuffer(r.x)})

    return rows.select("ids", "x").mapInPandas(go, f"u long, {name} {kind}")


def sides(e: DataFrame) -> Packed:
    """Rows b, side, ids, counts, ends, who: lists dst by src (side 0) and src by dst (side 1), loops and parallels kept, ends as places in the sorted ids ``who``."""

    def placed(b, side, ids, counts, ends):
        who, far = np.unique(ends, return_inverse=True)
        return b, side, enc(ids), enc(counts), enc(far), enc(who)

    def split(batches):
        for frame in batches:
            for r in frame.itertuples():
                ids, counts, ends = dec(r.ids), dec(r.counts), dec(r.ends)
                row, out = np.repeat(np.arange(len(ids)), counts), []
                for side in (0, 1) if r.side < 0 else (r.side,):
                    held = np.ones(len(row), bool) if r.side >= 0 else (ends > ids[row]) == (side == 0)
                    n = np.bincount(row[held], minlength=len(ids))
                    if held.any():
                        out.append(placed(r.b, side, ids[n > 0], n[n > 0], ends[held]))
                yield pd.DataFrame(out, columns=["b", "side", "ids", "counts", "ends", "who"])

    if hasattr(e, "_sets"):
        p, more = lists(e), []
        rows = p.rows.withColumn("side", F.lit(-1))
    else:
        p = lists(e, False, False, loops=True)
        q = lists(e, False, False, back=True, loops=True, bounds=p.bounds)
        rows, more = p.rows.withColumn("side", F.lit(0)).unionByName(q.rows.withColumn("side", F.lit(1))), [q.rows]
    out = scratch.table(rows.mapInPandas(split, "b int, side int, ids binary, counts binary, ends binary, who binary"), "sides")
    scratch.drop(p.rows, *more)
    return Packed(out, p.bounds)


def hits(e: DataFrame, halves: int, every: int = 4) -> DataFrame:
    """u, score, to a factor: after ``halves`` half steps, from scores of 1 along the edges and against them in turn. Ranges send each other sums by id; a step only
    scales scores, so lengths are left to the reader, and every few steps a factor keeps the numbers in range."""
    p = sides(e)
    bounds, seen, z = p.bounds, None, 1.0

    def step(first: bool, z: float):
        def send(frame: pd.DataFrame) -> pd.DataFrame:
            own, got = frame[frame.side == 0], frame[frame.side == 1]
            if not len(own):
                return pd.DataFrame(columns=["b", "ids", "x", "top"])
            own = own.iloc[0]
            ids, counts, far, who = dec(own.ids), dec(own.counts), dec(own.ends), dec(own.who)
            score = np.full(len(ids), 1.0 if first else 0.0)
            for i, v in zip(got.ids, got.x):
                i, v = dec(i), np.frombuffer(v)
                at = np.minimum(np.searchsorted(i, ids), len(i) - 1)
                held = i[at] == ids
                score[held] += v[at[held]] / z
            sums = np.bincount(far, np.repeat(score, counts), len(who))
            b, k = grouped(np.searchsorted(bounds, who, "right"))
            last = np.cumsum(k)
            return pd.DataFrame({"b": b, "ids": [enc(who[j - i : j]) for i, j in zip(k, last)], "x": [sums[j - i : j].tobytes() for i, j in zip(k, last)], "top": [sums[j - i : j].max() for i, j in zip(k, last)]})

        return send

    for i in range(halves):
        own = p.rows.where(F.col("side") == i % 2).select("b", F.lit(0).alias("side"), "ids", "counts", "ends", "who", F.lit(None).cast("binary").alias("x"))
        rows = own if seen is None else own.unionByName(seen.select("b", F.lit(1).alias("side"), "ids", "x"), allowMissingColumns=True)
        new = scratch.table(rows.groupBy("b").applyInPandas(step(seen is None, z), "b int, ids binary, x binary, top double"), "scores")
        if seen is not None:
            scratch.drop(seen)
        seen, z = new, 1.0
        if i % every == every - 1:
            z = new.agg(F.max("top")).first()[0] or 1.0
    scratch.drop(p.rows)
    return values_of(seen, "score", "double").groupBy("u").agg(F.sum("score").alias("score"))
