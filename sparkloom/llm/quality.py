"""Quality classifier by co-training.

Two views of a document are learned apart: its text (which words occur, and bucketed statistics of characters, repetition and lines) and its
metadata (language, source, length). Each view is a logistic regression over features scaled by their log-count ratio: one slope that all features
share, and a deviation of each that the labelled rows bear out. In every round each view, calibrated on held-out labels, labels every other
document that it is sure of; the other view's ratios then count these documents too, so a feature that no labelled row has still gets a weight.
The calibrated views are then combined by a small regression on the held-out labels, so a view that says nothing weighs nothing,
and all documents are scored. A document is good if its quality is 1 and it isn't toxic.

The regressions are fitted in one task on a bounded sample, ``max_labelled`` labelled documents of lowest hash. The exchange covers all other
documents, and what it sends is two counts a feature, of which there are fewer than 2^19. Scoring reads every whole text, however long.

Defined results: null or empty text has only its statistics; missing metadata is a value of its own; without labels of both kinds every
document gets the score 1, or 0 where all labels are bad. Labels that repeat a doc_id count as the worst of them. Repeated rows are scored alike,
and each counts in the exchange; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch

WORD_BITS, META_BITS, BUCKETS = 18, 12, 24
STATS = 9


def text_features(text) -> np.ndarray:
    """Ids of the features that a text has."""
    data = b"" if text is None else bytes(text)
    words = data.split()
    kinds = {w.lower() for w in words}
    ids = [zlib.crc32(w.strip(b".,;:!?\"'()[]{}")) & (1 << WORD_BITS) - 1 for w in kinds]
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, lines = max(1, len(data)), data.split(b"\n")
    share = lambda a, b: a / max(1, b)
    most = max(np.unique(np.fromiter(map(zlib.crc32, words), np.uint32), return_counts=True)[1]) if words else 0
    stats = (
        share(len(kinds), len(words)),
        share(most, len(words)),
        share(int(seen[65:91].sum()), int(seen[65:91].sum() + seen[97:123].sum())),
        share(int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()), n),
        share(int(seen[48:58].sum()), n),
        min(1.0, share(len(data), len(words)) / 24),
        min(1.0, math.log2(1 + len(words)) / 20),
        share(len(set(lines)), len(lines)),
        min(1.0, math.log2(1 + len(lines)) / 16),
    )
    ids += [(1 << WORD_BITS) + k * BUCKETS + min(BUCKETS - 1, int(x * BUCKETS)) for k, x in enumerate(stats)]
    return np.unique(np.array(ids, np.int32))


def meta_features(lang, source, n_chars) -> np.ndarray:
    size = "none" if n_chars is None or pd.isna(n_chars) else str(int(math.log2(1 + max(0, n_chars)) * 2))
    return np.unique(np.array([zlib.crc32(f"{k}={v}".encode()) & (1 << META_BITS) - 1 for k, v in (("lang", lang), ("source", source), ("size", size))], np.int32))


NAMES = ("text", "meta")
SIZES = {"text": (1 << WORD_BITS) + STATS * BUCKETS, "meta": 1 << META_BITS}


class View:
    """Logistic regression on feature ids scaled by log-count ratios, with a calibrated output."""

    def __init__(self, size: int, steps: int = 120, ridge: float = 1e-3, least: int = 3):
        self.size, self.steps, self.ridge, self.least = size, steps, ridge, least

    def fit(self, rows: list[np.ndarray], y: np.ndarray, counts: np.ndarray) -> View:
        """``counts``: of pseudo-labelled documents, good ones first, by feature and in all; they weigh as much as the labelled rows at most."""
        ids, lens = np.concatenate(rows), np.array([len(r) for r in rows])
        of = np.repeat(np.arange(len(rows)), lens)
        weight = min(1.0, len(y) / max(1, counts[:, -1].sum()))
        pos, neg = (np.bincount(ids, w[of], self.size) + weight * c[:-1] for w, c in ((y, counts[0]), (1 - y, counts[1])))
        n_pos, n_neg = y.sum() + weight * counts[0, -1], (1 - y).sum() + weight * counts[1, -1]
        ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
        ratio[np.bincount(ids, minlength=self.size) + counts[:, :-1].sum(0) < self.least] = 0
        used = np.flatnonzero(ratio)
        at = np.full(self.size, -1)
        at[used] = np.arange(len(used))
        k = at[ids]
        fine = k >= 0
        k, of = k[fine], of[fine]
        x = ratio[used][k]
        total = np.bincount(of, x, len(rows))
        scale = max(float(total.std()), 1e-9)
        total = total / scale
        w, s, b, m, v = np.zeros(len(used)), 0.0, 0.0, np.zeros(len(used) + 2), np.zeros(len(used) + 2)
        for t in range(1, self.steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[k] * x, len(rows)) + s * total + b, -30, 30)))
            e = (p - y) / len(y)
            g = np.append(np.bincount(k, e[of] * x, len(used)) + self.ridge * w, (e @ total + self.ridge * s, e.sum()))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, s, b = w - step[:-2], s - step[-2], b - step[-1]
        self.w = np.zeros(self.size, np.float32)
        self.w[used] = (w + s / scale) * ratio[used]
        self.b, self.scale, self.shift = b, 1.0, 0.0
        return self

    def raw(self, rows) -> np.ndarray:
        return np.array([float(self.w[r].sum()) + self.b for r in rows])

    def logit(self, rows) -> np.ndarray:
        return np.clip(self.raw(rows) * self.scale + self.shift, -30, 30)

    def calibrate(self, rows, y: np.ndarray) -> View:
        self.scale, self.shift = (float(c) for c in logistic(self.raw(rows)[:, None], y))
        return self


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Newton's method for few columns; the last coefficient is the constant."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return np.append(w[:-1] / scale, w[-1])


class Model:
    """Scores of (text ids, meta ids) lists: by text, by metadata, and combined."""

    def __init__(self, views: dict | None = None, mix: np.ndarray | None = None, always: float | None = None):
        self.views, self.mix, self.always = views, mix, always

    def __call__(self, text, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.always is not None:
            return tuple(np.full(len(text), self.always) for _ in range(3))
        x = np.empty((len(text), 2))
        for i, rows in enumerate((text, meta)):
            w, b, scale, shift = self.views[("text", "meta")[i]]
            x[:, i] = np.clip(np.array([float(w[r].sum()) + b for r in rows]) * scale + shift, -30, 30)
        return (*(1 / (1 + np.exp(-x.T))), 1 / (1 + np.exp(-np.clip(x @ self.mix[:-1] + self.mix[-1], -30, 30))))


def fit_views(labelled: list[tuple], y: np.ndarray, counts: dict[str, np.ndarray]) -> Model:
    """Both views from labelled rows and the other view's pseudo-labels, calibrated and combined on the held-out quarter."""
    if not len(y) or y.min() == y.max():
        return Model(always=float(y[0]) if len(y) else 1.0)
    held = np.arange(len(y)) % 4 == 3
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    test = held if held.any() else ~held
    views, logits = {}, []
    for i, n in enumerate(NAMES):
        own, out = ([r[i] for r, t in zip(labelled, chosen, strict=True) if t] for chosen in (~held, test))
        views[n] = View(SIZES[n]).fit(own, y[~held], counts[n]).calibrate(out, y[test])
        logits.append(views[n].logit(out))
    mix = logistic(np.column_stack(logits), y[test])
    return Model({n: (v.w, v.b, v.scale, v.shift) for n, v in views.items()}, mix)


def no_counts() -> dict[str, np.ndarray]:
    return {n: np.zeros((2, SIZES[n] + 1)) for n in NAMES}


def tally(model: Model, rows: Iterator[tuple[list, list]], sure: float) -> dict[str, np.ndarray]:
    """What each view gets from the other: documents that this one is ``sure`` of, good and bad, by feature and in all."""
    counts = no_counts()
    for text, meta in rows:
        by_text, by_meta, _ = model(text, meta)
        for to, p, features in (("meta", by_text, meta), ("text", by_meta, text)):
            for at, chosen in enumerate((p >= sure, 1 - p >= sure)):
                picked = [features[i] for i in np.flatnonzero(chosen)]
                if picked:
                    counts[to][at] += np.bincount(np.concatenate(picked), minlength=SIZES[to] + 1)
                    counts[to][at, -1] += len(picked)
    return counts


def _lowest(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` rows of lowest hash, more or less: a threshold on the hash first, so that no task sorts more than it has to."""
    n = ids.count()
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    return ids.where(key < int((1 << 30) * min(1.0, 1.5 * most / max(1, n) + 1e-6)) + 1).orderBy(key, "doc_id").limit(most)


def classifier(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000, rounds: int = 2, sure: float = 0.97) -> Model:
    """Trained in one task on the bounded sample and the counts of the exchange, so that the driver gets the finished model alone."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    marks = marks.select("doc_id", F.when((F.col("q") >= 1) & (F.col("t") < 1), 1.0).otherwise(0.0).alias("y"))
    own = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = scratch.table(_lowest(marks.join(own, "doc_id", "left_semi"), max_labelled, 1).select(F.col("doc_id").alias("id"), "y"), "labelled")

    @F.pandas_udf("struct<text: array<int>, meta: array<int>>")
    def features(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": [text_features(t) for t in text], "meta": [meta_features(*m) for m in zip(lang, source, n_chars, strict=True)]})

    every = docs.select(F.col("doc_id").alias("id"), *_columns(docs)).select("id", features("text", "lang", "source", "n_chars").alias("f"))
    every = scratch.table(every.select("id", "f.*"), "features")
    # max_labelled rows at most, so they can be sent to every task
    labelled = every.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct("text", "meta")).alias("f"))
    labelled = scratch.table(labelled.select(F.col("id").cast("string").alias("id"), "y", "f.*"), "training")
    given = labelled.withColumns({c: F.lit(None).cast(t) for c, t in (("view", "string"), ("good", "array<double>"), ("bad", "array<double>"))})
    pool = every.join(F.broadcast(known.select("id")), "id", "left_anti").select("text", "meta")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames, counts = [], no_counts()
        for frame in batches:
            frames.append(frame[frame.view.isna()])
            for n, at, good, bad in frame.loc[frame.view.notna(), ["view", "text", "good", "bad"]].itertuples(index=False):
                counts[n][0, at], counts[n][1, at] = good, bad
        rows = pd.concat([*frames, pd.DataFrame({"id": [], "y": [], "text": [], "meta": []})]).sort_values("id")
        model = fit_views([(_ids(t), _ids(m)) for t, m in zip(rows.text, rows.meta, strict=True)], rows.y.to_numpy(float), counts)
        yield pd.DataFrame({"model": [pickle.dumps((model.views, model.mix, model.always))]})

    def fit(rows: DataFrame) -> Model:
        return Model(*pickle.loads(rows.repartition(1).mapInPandas(train, "model binary").first().model))

    model = fit(given)
    for _ in range(rounds if model.always is None else 0):

        def exchange(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            counts = tally(model, (([_ids(t) for t in b.text], [_ids(m) for m in b.meta]) for b in batches), sure)
            for n, c in counts.items():
                at = np.flatnonzero(c.any(0))
                yield pd.DataFrame({"view": n, "feature": at.astype(np.int32), "good": c[0, at], "bad": c[1, at]})

        sums = pool.mapInPandas(exchange, "view string, feature int, good double, bad double").groupBy("view", "feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        packed = sums.groupBy("view", F.expr("feature div 1024").alias("block")).agg(F.sort_array(F.collect_list(F.struct("feature", "good", "bad"))).alias("c"))
        packed = packed.select("view", F.col("c.feature").alias("text"), F.col("c.good").alias("good"), F.col("c.bad").alias("bad"))
        model = fit(given.unionByName(packed, allowMissingColumns=True))
    scratch.drop(every, known, labelled)
    return model


def _ids(found) -> np.ndarray:
    return np.asarray(found, np.int32)


def _columns(docs: DataFrame) -> list:
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return [have("text", "binary"), have("lang", "string"), have("source", "string"), have("n_chars", "double")]


def _scores(docs: DataFrame, labels: DataFrame, name: str, **options) -> DataFrame:
    scratch.small_batches(docs.sparkSession)
    model = classifier(docs, labels, **options)

    @F.pandas_udf("struct<text_score: double, meta_score: double, score: double>")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        t, m, s = model([text_features(x) for x in text], [meta_features(*x) for x in zip(lang, source, n_chars, strict=True)])
        return pd.DataFrame({"text_score": t, "meta_score": m, "score": s})

    return docs.withColumn(name, score(*_columns(docs)))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score (each a probability of good) and keep of every document."""
    name = scratch.fresh(docs, "scores")
    q = _scores(docs, labels, name, **options).select("doc_id", F.col(name).alias("q"))
    return q.select("doc_id", "q.text_score", "q.meta_score", "q.score", (F.col("q.score") >= 0.5).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` less those of a score under 0.5; its columns pass through, whatever their names."""
    name = scratch.fresh(docs, "scores")
    return _scores(docs, labels, name, **options).where(F.col(name)["score"] >= 0.5).drop(name)
