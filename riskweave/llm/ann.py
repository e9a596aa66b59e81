"""Approximate nearest neighbours by an inverted multi-index.

Each vector gets a last component that makes all lengths equal, so the largest inner product is the least distance. Both halves are
quantised apart by k-means fitted on a bounded sample; a pair of centroids is a cell, and every vector is in one. A query
walks the pairs by the sum of its two distances, with a heap, until the cells hold the share ``SHARE`` of all vectors; their entries are
reranked by exact inner products.

The share is high because it is set for vectors without structure: on isotropic vectors of 64 components the walk to 0.65 of the entries
finds about 0.96 of the 20 nearest, on clustered ones nearly all.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; rows with the query's id are its own;
vectors of other lengths are no candidates; repeated rows count each time; equal products go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm._memory import lean
from riskweave.llm._vectors import Best, matrices, packed, paired, ranked, searched, valid
from riskweave.session import stage

CENTROIDS = 32
SHARE = 0.65
#: Vectors that centroids are fitted on at most, and rounds of fitting.
SAMPLE = 16_000
ROUNDS = 12


def k_means(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centers = x[np.sort(random.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = distances(x, centers).argmin(1)
        count = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T, 0)


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, longest * longest - (x * x).sum(1)))[:, None]])


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """Cells in the order of the sum of the two distances until they hold ``wanted`` entries. sizes: entries by (first, second)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, held = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        out.append(a[i] * len(second) + b[j])
        held += sizes[a[i], b[j]]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return np.array(out, np.int64)


class Quantiser:
    """Centroids of both halves of the extended vectors of one number of components."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest, self.half = longest, (sample.shape[1] + 1) // 2
        x = extended(sample, longest)
        self.first, self.second = k_means(x[:, : self.half], k), k_means(x[:, self.half :], k)
        self.sizes = np.zeros((len(self.first), len(self.second)), np.int64)

    def both(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        whole = np.hstack([x, np.zeros((len(x), 1))]) if query else extended(x, self.longest)
        return distances(whole[:, : self.half], self.first), distances(whole[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.both(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)


#: A walk holds at least 2 * OWN * k entries; rows of a query's own id count as candidates in this only up to OWN * k.
OWN = 10
#: Numbers of components, the most frequent, that get centroids; vectors of others are in one cell, which every walk visits.
KINDS = 1000


def fit(vectors: DataFrame, n: int, centroids: int = CENTROIDS, sample: int = SAMPLE) -> dict[int, Quantiser]:
    """A quantiser for each of the KINDS most frequent numbers of components, from at most ``sample`` vectors by hash of their id."""
    share = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    table = vectors.where(share * n <= sample).orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample).select("v").toArrow()
    longest = {r["d"]: r["l"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.max("length").alias("l")).orderBy(F.desc(F.count(F.lit(1)))).limit(KINDS).collect()}
    out = {}
    for d, most in longest.items():
        got = [matrices(b, 0, d)[1] for b in table.to_batches()]
        rows = np.concatenate(got) if got else np.zeros((0, d))
        if not len(rows):  # too rare for the sample: a single cell
            rows = np.zeros((1, d))
        out[d] = Quantiser(rows, float(most), centroids)
    return out


def _counted(vectors: DataFrame, quantisers: dict[int, Quantiser]) -> None:
    """Fills in the entries of each cell: one row for each cell comes to the driver."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantisers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, quantiser in shared.value.items():
                _, matrix = matrices(batch, 0, d)
                if len(matrix):
                    cells, n = np.unique(quantiser.cells(matrix), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(cells), d), pa.int32()), "cell": pa.array(cells, pa.int32()), "n": n.astype(np.int64)})

    for r in vectors.select("v").mapInArrow(lean(run), "d int, cell int, n bigint").groupBy("d", "cell").agg(F.sum("n").alias("n")).collect():
        quantisers[r["d"]].sizes.reshape(-1)[r["cell"]] = r["n"]


def _meet(q: dict, x: dict, best: Best) -> None:
    dims = q["dims"]
    queries, rows = (np.frombuffer(part["v"], np.float64).reshape(-1, dims) for part in (q, x))
    ids, cells = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["cells"], np.int32)
    asked = np.unpackbits(np.frombuffer(q["asked"], np.uint8).reshape(len(queries), -1), axis=1)
    scores = np.full((len(queries), len(rows)), -np.inf)
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    for a, b in zip(first, [*first[1:], len(cells)]):
        who = np.flatnonzero(asked[:, cells[a]])
        if len(who):
            scores[who, a:b] = queries[who] @ rows[a:b].T
    scores[best.ids[:, None] == ids[None]] = -np.inf  # own rows, however many, take no place
    k = min(best.k, len(rows))
    least = np.maximum(best.score[:, -1], np.partition(scores, -k, axis=1)[:, -k])
    slack = 1e-9 * np.sqrt((queries * queries).sum(1)) * np.sqrt((rows * rows).sum(1).max())
    for i in range(len(queries)):
        near = np.flatnonzero((scores[i] >= least[i] - slack[i]) & (scores[i] > -np.inf))
        if len(near):  # again, each by itself, so that equal vectors have equal products
            best.add(i, (rows[near] * queries[i]).sum(1), ids[near])


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products of the rows that ``is_query`` holds for (of vec_id)."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sound = stage(valid(vectors, id_col, vector).withColumn("length", length).where("length > 0"), "ann-vectors")
    n, n_queries = sound.count(), sound.where(is_query).count()
    quantisers = fit(sound, n, centroids)
    _counted(sound, quantisers)
    shared = vectors.sparkSession.sparkContext.broadcast(quantisers)
    # own rows are no candidates, so a walk goes on past them; ids of few rows need no count, as half of what any walk holds is more. One pair for each OWN * k rows at most
    repeated = sound.where(is_query).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OWN * k)
    own = {r["vec_id"]: r["n"] for r in repeated.collect()}

    def query(ids: np.ndarray, matrix: np.ndarray) -> Iterator[dict]:
        quantiser = shared.value.get(matrix.shape[1])
        total = int(quantiser.sizes.sum()) if quantiser else 0
        asked = np.zeros((len(ids), quantiser.sizes.size), np.uint8) if quantiser else np.ones((len(ids), 1), np.uint8)
        for i, (a, b) in enumerate(zip(*quantiser.both(matrix, query=True)) if quantiser else ()):
            asked[i, walk(a, b, quantiser.sizes, min(total, own.get(int(ids[i]), 0) + max(2 * OWN * k, int(np.ceil(share * total)))))] = 1
        yield {"dims": matrix.shape[1], "ids": ids.tobytes(), "v": matrix.tobytes(), "asked": np.packbits(asked, axis=1).tobytes()}

    def lists(ids: np.ndarray, matrix: np.ndarray) -> Iterator[dict]:
        quantiser = shared.value.get(matrix.shape[1])
        cells = quantiser.cells(matrix).astype(np.int32) if quantiser else np.zeros(len(ids), np.int32)
        order = np.argsort(cells, kind="stable")
        yield {"ids": ids[order].tobytes(), "v": matrix[order].tobytes(), "cells": cells[order].tobytes()}

    asked = packed(sound.where(is_query), n_queries, query, "dims int, ids binary, v binary, asked binary", "q")
    index = packed(sound, n, lists, "ids binary, v binary, cells binary", "x")
    return ranked(searched(paired(asked, index, n_queries, n), k, _meet), k)
