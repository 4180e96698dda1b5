"""SQL of iterative scores, unrolled step by step. ``e`` (src, dst) and ``n`` (id) are the names of the graph's tables."""

from __future__ import annotations


def _final(steps: list[str], digits: int) -> str:
    return ", ".join(steps) + f" SELECT id, round(score, {digits}) AS score FROM x{len(steps) - 1}"


def pagerank(graph: str, steps: int = 100, digits: int = 6) -> str:
    """Scores stand still once their changes sum to 1e-10 a node."""
    out = [f"WITH {graph}, k AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY 1), c AS (SELECT count(*) AS c FROM n), x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS score, 1e9::DOUBLE AS old FROM n, c)"]
    for i in range(steps):
        x = f"x{i}"
        out.append(
            f"x{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN (SELECT sum(abs(score - old)) FROM {x}) <= 1e-10 * (SELECT c FROM c) THEN score ELSE 0.15 / (SELECT c FROM c) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM {x} WHERE id NOT IN (SELECT src FROM k)) / (SELECT c FROM c)) END AS score, score AS old "
            f"FROM {x} LEFT JOIN (SELECT dst, sum(score / k) AS got FROM e JOIN {x} ON id = src JOIN k USING (src) GROUP BY 1) ON dst = id)"
        )
    return _final(out, digits)


def article_rank(graph: str, steps: int = 20, digits: int = 6) -> str:
    out = [f"WITH {graph}, k AS MATERIALIZED (SELECT id, count(src) AS k FROM n LEFT JOIN e ON src = id GROUP BY 1), m AS (SELECT avg(k) AS m FROM k), x0 AS MATERIALIZED (SELECT id, 0.15::DOUBLE AS score, 0.15::DOUBLE AS delta FROM n)"]
    for i in range(steps):
        x = f"x{i}"
        still = f"(SELECT max(delta) FROM {x}) <= 1e-7" if i else "false"
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT x.id, score + CASE WHEN {still} THEN 0 ELSE 0.85 * coalesce(got, 0) END AS score, CASE WHEN {still} THEN 0 ELSE 0.85 * coalesce(got, 0) END AS delta FROM {x} x LEFT JOIN (SELECT dst, sum(delta / (k + (SELECT m FROM m))) AS got FROM e JOIN {x} y ON y.id = src JOIN k ON k.id = src GROUP BY 1) ON dst = x.id)")
    return _final(out, digits)


def hits(graph: str, hub: bool, steps: int = 20, digits: int = 6) -> str:
    """Authorities and hubs in turn, each of length 1."""
    out, count = [f"WITH {graph}, x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS score FROM n)"], 2 * steps - (not hub)
    for i in range(count):
        a, b = ("src", "dst") if i % 2 == 0 else ("dst", "src")
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT id, s / sqrt(sum(s * s) OVER ()) AS score FROM (SELECT n.id, coalesce(s, 0) AS s FROM n LEFT JOIN (SELECT {b} AS t, sum(score) AS s FROM e JOIN x{i} ON id = {a} GROUP BY 1) ON t = n.id))")
    return _final(out, digits)


def eigenvector(graph: str, steps: int = 20, digits: int = 5) -> str:
    out = [f"WITH {graph}, x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS score, 1e9::DOUBLE AS old FROM n)"]
    for i in range(steps):
        still = f"(SELECT max(abs(score - old)) FROM x{i}) <= 1e-7" if i > 1 else "false"
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN {still} THEN old ELSE s / sqrt(sum(s * s) OVER ()) END AS score, old FROM (SELECT x.id, x.score AS old, x.score + coalesce(s, 0) AS s FROM x{i} x LEFT JOIN (SELECT dst, sum(score) AS s FROM e JOIN x{i} ON id = src GROUP BY 1) ON dst = x.id))")
    return _final(out, digits)


def hops(graph: str) -> str:
    """Start of a query: h (s, t, d), the least number of edges from s to t, for all pairs."""
    return f"WITH RECURSIVE {graph}, w AS (SELECT src AS s, dst AS t, 1 AS d FROM e UNION SELECT s, dst, d + 1 FROM w JOIN e ON t = src), h AS (SELECT s, t, min(d) AS d FROM w WHERE s <> t GROUP BY 1, 2)"


def triads(graph: str) -> str:
    """Of a graph without two-way links and directed cycles: counts by degrees and triangles."""
    zero = ["102", "111D", "111U", "030C", "201", "120D", "120U", "120C", "210", "300"]
    return (
        f"WITH {graph}, t AS (SELECT count(*) AS t FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), o AS (SELECT src AS v, count(*) AS o FROM e GROUP BY 1), i AS (SELECT dst AS v, count(*) AS i FROM e GROUP BY 1), "
        "c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS m, t, (SELECT sum(o * (o - 1) // 2) FROM o) - t AS d, (SELECT sum(i * (i - 1) // 2) FROM i) - t AS u, (SELECT sum(o * i) FROM o JOIN i USING (v)) - t AS c FROM t), "
        "r AS (SELECT *, m * (n - 2) - 2 * (d + u + c) - 3 * t AS one FROM c) "
        "SELECT unnest(['003', '012', '021D', '021U', '021C', '030T']) AS triad, unnest([n * (n - 1) * (n - 2) // 6 - one - d - u - c - t, one, d, u, c, t])::BIGINT AS count FROM r "
        f"UNION ALL SELECT unnest({zero}), 0"
    )


#: The best 20 documents by BM25 for three words.
BM25 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
h AS (SELECT doc_id, len(w) AS len, q, len(list_filter(w, lambda x: x = q)) AS tf FROM t, (SELECT unnest(['idiot', 'worthless', 'nation']) AS q)),
f AS (SELECT *, count(*) OVER (PARTITION BY q) AS df FROM h WHERE tf > 0)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM f, s GROUP BY 1
ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) DESC, 1 LIMIT 20
"""
