"""URL filters: host and path rules, and gradient-boosted trees for urls without a rule.

The trees are trained from labelled urls, those with a rule, on lexical features: lengths, depth, digit ratio, entropy, parameter
counts and statistics of the host's suffix. These are counted over all urls: how many have the suffix, and the share of block
among its labelled ones; a url that the trees are fitted on gets the share among the other folds' urls, so that it
doesn't tell its own label. Fitting takes a bounded sample, the ``max_train`` labelled urls of lowest
hash of url and page_id; scoring covers every url, in Arrow batches with the small model in the function.

Defined results: null or a url without ``://`` has empty host and path, no rule, and a verdict by the method; without labels
of both kinds the method's verdict is the kind there is, else allow. Repeated rows are judged alike; a url is judged whole,
however long; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch

#: (verdict, host, path): fixed values of the production query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FOLDS = 5
INPUTS = ("url", "host", "path", "share", "seen")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def suffix_counts(split: DataFrame) -> DataFrame:
    """A row for each last label of hosts: suffix, seen (its urls), and by fold of the url its labelled and blocked ones."""
    labelled = [f"count_if(ruled IS NOT NULL AND fold = {i})" for i in range(FOLDS)]
    blocked = [f"count_if(ruled = 'block' AND fold = {i})" for i in range(FOLDS)]
    return split.groupBy("suffix").agg(F.count(F.lit(1)).alias("seen"), *(F.expr(f"array({', '.join(x)})").alias(n) for n, x in (("labelled", labelled), ("blocked", blocked))))


def block_share(prior: float, least: float = 10.0) -> Column:
    """The share of block among a suffix's labelled urls, drawn to ``prior`` by the weight of ``least`` urls; for a labelled row, of other folds."""
    other = "aggregate({0}, 0L, (a, x) -> a + x) - if(ruled IS NULL, 0L, element_at({0}, int(fold) + 1))"
    return (F.expr(other.format("blocked")) + F.lit(least * prior)) / (F.expr(other.format("labelled")) + F.lit(least))


def features(urls, hosts, paths, share, seen) -> np.ndarray:
    out = np.empty((len(urls), 16))
    for i, (u, h, p, rate, n_seen) in enumerate(zip(urls, hosts, paths, share, seen, strict=True)):
        u = u or ""
        n, query = max(1, len(u)), u.partition("?")[2].partition("#")[0]
        counts = Counter(u)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        digits, upper = sum(map(str.isdigit, u)), sum(map(str.isupper, u))
        out[i] = (len(u), len(h), len(p), p.count("/"), digits / n, entropy, query.count("=") + query.count("&"), len(query), h.count("."), u.count("-"), upper / n,
                  u.startswith("https:"), "#" in u, u.count("%"), rate, math.log1p(n_seen))
    return out


class Trees:
    """Boosted trees on binned features with the logistic loss; fixed depth, Newton leaves."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(p / (1 - p)), []
        f, leaves = np.full(n, self.base), 1 << self.depth
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                best = [(0.0, 0, self.bins)] * (1 << level)
                for j in range(d):
                    key = node * (self.bins + 1) + b[:, j]
                    gs, hs = (np.bincount(key, w, (self.bins + 1) << level).reshape(1 << level, -1).cumsum(1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    for k, c in enumerate(gain.argmax(1)):
                        if gain[k, c] > best[k][0] + 1e-9:
                            best[k] = (gain[k, c], j, int(c))
                tree.append(np.array([(j, c) for _, j, c in best]))
                node = node * 2 + (b[np.arange(n), tree[-1][node, 0]] > tree[-1][node, 1])
            value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge) * self.rate
            self.trees.append((tree, value))
            f += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in tree:
                node = node * 2 + (b[rows, level[node, 0]] > level[node, 1])
            f += value[node]
        return 1 / (1 + np.exp(-f))


def train(rows: list[tuple]):
    """A scorer of (urls, hosts, paths, share, seen), the probability of block, from rows of these and the verdict."""
    y = np.array([r[-1] == "block" for r in rows], float)
    if not len(y) or y.min() == y.max():
        always = float(y[0]) if len(y) else 0.0
        return lambda urls, *rest: np.full(len(urls), always)
    model = Trees().fit(features(*list(zip(*rows, strict=True))[:-1]), y)
    return lambda *columns: model.score(features(*columns))


def judge(pages: DataFrame, rules=RULES, max_train: int = 20_000, small: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every page's url.

    Suffix counts of up to ``small`` rows, counted first, are broadcast; more are joined by a shuffle, whose hot suffixes
    Spark splits at run time.
    """
    scratch.small_batches(pages.sparkSession, 10_000)
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumn("rule", rule).withColumn("ruled", ruled)
    split = split.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    counts = scratch.table(suffix_counts(split), "suffixes")
    each = [F.sum(F.expr(f"aggregate({c}, 0L, (a, x) -> a + x)")).alias(c) for c in ("labelled", "blocked")]
    total = counts.agg(F.count(F.lit(1)).alias("n"), *each).first()
    split = split.join(F.broadcast(counts) if total.n <= small else counts.hint("merge"), "suffix")
    split = split.withColumn("share", block_share((total.blocked or 0) / max(1, total.labelled or 0)))
    labelled = split.where("ruled IS NOT NULL")
    key = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30))
    cut = 1.5 * max_train / max(1, total.labelled or 0)  # a threshold first, so that partitions don't each send a whole sample
    labelled = labelled.where(key < int((1 << 30) * min(1.0, cut)) + 1).orderBy(key, "url", "page_id").limit(max_train)
    scorer = train([tuple(r) for r in labelled.select(*INPUTS, "ruled").collect()])

    @F.pandas_udf("double")
    def score(url: pd.Series, host: pd.Series, path: pd.Series, share: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series(scorer(*(c.tolist() for c in (url, host, path, share, seen))))

    scored = split.withColumn("score", score(*INPUTS))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
