"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt out by length into buckets, longest first. A query's threshold is its k-th best product with the longest vectors, raised
as buckets are met. In a bucket whose longest vector has length l, a result needs cosine ``threshold / (|q| l)`` or more. Above
1 the bucket is skipped. From ``COORDINATE`` up, coordinate pruning keeps rows of which the query's largest
coordinates lie in the range that the cosine allows; below, length pruning keeps rows of length ``threshold / |q|`` or more. What stays is
verified by exact integer products.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; rows with the query's id are its own; vectors
of other lengths are no candidates; repeated rows count each time; equal products go to the smaller vec_id;
an empty table gives an empty result; products beyond 64 bits are cut to the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm._vectors import Best, packed, paired, ranked, searched, valid
from riskweave.session import stage

#: Longest vectors that give the first thresholds.
SEEDS = 512
COORDINATE = 0.5
FOCUS = 3
#: A bucket ends where lengths fall below this share of its first, once it has MIN_BUCKET rows.
FALL = 0.9
MIN_BUCKET = 64
_SLACK = 1e-9


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows: in doubles while every partial sum is exact in them, else in big integers."""
    bound = _lengths(q).max(initial=0) * _lengths(x).max(initial=0)
    if bound < 2.0**52:
        return (q @ x.T).astype(np.int64)
    whole = [[min(max(sum(int(a) * int(b) for a, b in zip(u, v)), -(1 << 63) + 1), (1 << 63) - 1) for v in x] for u in q]
    return np.array(whole, np.int64).reshape(len(q), len(x))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def allowed(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Lowest and highest value that each coordinate of a unit vector can have at this cosine or more with ``unit``."""
    spread = np.sqrt(np.maximum(0, 1 - unit * unit) * max(0.0, 1 - cosine * cosine))
    low = np.where(unit * -1 >= cosine, -1.0, unit * cosine - spread)
    high = np.where(unit >= cosine, 1.0, unit * cosine + spread)
    return np.stack([low, high])


def _meet(q: dict, x: dict, best: Best) -> None:
    dims = q["dims"]
    queries, rows = (np.frombuffer(part["v"], np.float64).reshape(-1, dims) for part in (q, x))
    ids = np.frombuffer(x["ids"], np.int64)
    seeds = np.frombuffer(q["threshold"], np.float64)
    lengths = _lengths(rows)  # descending
    length = _lengths(queries)
    threshold = np.maximum(seeds, best.score[:, -1].astype(float))
    short = np.flatnonzero(np.isfinite(threshold) & (threshold > 0) & (length > 0))
    cosine = np.full(len(queries), -np.inf)
    cosine[short] = threshold[short] / (length[short] * max(lengths[0], 1e-300))
    alive = cosine <= 1 + _SLACK
    by_place = np.flatnonzero(alive & (cosine >= COORDINATE))
    unit = rows / np.maximum(lengths, 1e-300)[:, None] if len(by_place) else None
    for i in by_place:
        own = queries[i] / length[i]
        focus = np.argsort(-np.abs(own))[:FOCUS]
        low, high = allowed(own[focus], float(cosine[i]))
        near = unit[:, focus]
        keep = np.flatnonzero(((near >= low - _SLACK) & (near <= high + _SLACK)).all(1) | (lengths == 0))
        if len(keep):
            best.add(i, products(queries[i : i + 1], rows[keep])[0], ids[keep])
    by_length = np.flatnonzero(alive & (cosine < COORDINATE))
    if len(by_length):
        least = np.zeros(len(queries))
        least[short] = threshold[short] / length[short]
        wanted = (least[by_length] * (1 - _SLACK)).min()
        n = int(np.searchsorted(-lengths, -wanted, "right")) if wanted > 0 else len(rows)
        scores = products(queries[by_length], rows[:n])
        for row, i in zip(scores, by_length, strict=True):
            best.add(i, row, ids[:n])


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of whole numbers ``floor(scale * x)`` of the rows that ``is_query`` holds for (of vec_id)."""
    sound = stage(valid(vectors, id_col, vector), "topk-vectors")
    n, n_queries = sound.count(), sound.where(is_query).count()
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    first = sound.select("vec_id", length.alias("length")).orderBy(F.desc("length"), "vec_id").limit(SEEDS).collect()  # of each partition these come to the driver, so without vectors
    least = first[-1]["length"] if first else 0.0
    longest = sound.where(F.col("vec_id").isin([r["vec_id"] for r in first]) & (length >= least)).limit(SEEDS).collect()  # any rows may give thresholds
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in longest}:
        mine = [r for r in longest if len(r["v"]) == d]
        seeds[d] = np.array([r["vec_id"] for r in mine]), np.floor(np.array([r["v"] for r in mine]) * scale)
    shared = vectors.sparkSession.sparkContext.broadcast(seeds)

    def query(ids: np.ndarray, matrix: np.ndarray) -> Iterator[dict]:
        whole = np.floor(matrix * scale)
        threshold = np.full(len(ids), -np.inf)
        if whole.shape[1] in shared.value:
            others, rows = shared.value[whole.shape[1]]
            scores = products(whole, rows).astype(float)
            scores[ids[:, None] == others[None]] = -np.inf
            if len(others) >= k:
                threshold = np.partition(scores, -k, axis=1)[:, -k]
        yield {"dims": whole.shape[1], "ids": ids.tobytes(), "v": whole.tobytes(), "threshold": threshold.tobytes()}

    def buckets(ids: np.ndarray, matrix: np.ndarray) -> Iterator[dict]:
        whole = np.floor(matrix * scale)
        lengths = _lengths(whole)
        order = np.argsort(-lengths, kind="stable")
        whole, lengths, ids = whole[order], lengths[order], ids[order]
        first = 0
        while first < len(ids):
            end = int(np.searchsorted(-lengths, -FALL * lengths[first], "right"))
            end = min(len(ids), max(end, first + MIN_BUCKET))
            yield {"ids": ids[first:end].tobytes(), "v": whole[first:end].tobytes()}
            first = end

    asked = packed(sound.where(is_query), n_queries, query, "dims int, ids binary, v binary, threshold binary", "q")
    index = packed(sound, n, buckets, "ids binary, v binary", "x", (length.desc(),))
    return ranked(searched(paired(asked, index, n_queries, n), k, _meet, whole=True), k)


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.w) = len(q.w)),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 5
"""
