"""Vectors packed into blocks, and queries met with them block by block, shard by shard.

Queries and index rows are packed into rows of up to BLOCK vectors. Every block of queries meets every block of the index: both are
dealt out by (query block, shard), where a shard is a few index blocks, so the work spreads over tasks however the vectors
are distributed, and a task holds two blocks and the best results of its queries.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskweave.llm._memory import lean
from riskweave.session import stage

BLOCK = 1024
#: Index blocks of a shard.
SHARD_BLOCKS = 4


def valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector has components, all of them finite numbers; v as doubles."""
    v = F.col(vector).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce(sound, F.lit(False)))


def matrices(batch: pa.RecordBatch, vector: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose vectors have ``dims`` components, and these vectors."""
    column = batch.column(vector)
    length = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero(length == dims)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = (column.offsets.to_numpy() - column.offsets[0].as_py())[:-1]
    return rows, flat[start[rows][:, None] + np.arange(dims)[None]] if len(rows) else np.zeros((0, dims))


def dimensions(batch: pa.RecordBatch, vector: int) -> list[int]:
    return sorted(set(np.diff(batch.column(vector).offsets.to_numpy()).tolist()))


def packed(vectors: DataFrame, n: int, make: Callable[[np.ndarray, np.ndarray], dict], fields: str, name: str, order: tuple = ()) -> DataFrame:
    """Blocks of (vec_id, v): a number, dims, and the struct ``name`` of ``make(ids, matrix)``. n: vectors, as counted before.

    Vectors are dealt out by range of ``order``, or by hash of their id.
    """
    parts = max(1, -(-n // BLOCK))
    dealt = vectors.repartitionByRange(parts, *order, "vec_id") if order else vectors.repartition(parts, "vec_id")
    kind = T.StructType.fromDDL(fields)
    inner = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in kind])

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = batch.column(0).to_numpy()
        for dims in dimensions(batch, 1):
            rows, matrix = matrices(batch, 1, dims)
            for a in range(0, len(rows), BLOCK):
                for made in make(ids[rows[a : a + BLOCK]], matrix[a : a + BLOCK]):
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([made], inner)], names=["dims", name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                size += batch.num_rows
            if size and (batch is None or size >= 8 * BLOCK):
                for part in out(held):
                    yield part.append_column("block", pa.array([number], pa.int64()))
                    number += 1
                held, size = [], 0

    schema = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField(name, kind), T.StructField("block", T.LongType())])
    return stage(dealt.select("vec_id", "v").mapInArrow(lean(run), schema), f"blocks-{name}")


def paired(queries: DataFrame, index: DataFrame, n_queries: int, n_index: int) -> DataFrame:
    """(qb, q, x): every block of queries with every block of the index of the same dimensions, from what :func:`packed` gives.

    Sizes of files say nothing of what explode makes of them (a copy of each query for each shard), so the join is told not to broadcast a side.
    """
    n_shards = max(1, -(-n_index // (BLOCK * SHARD_BLOCKS)))
    n_groups = max(1, -(-n_queries // BLOCK))
    x = index.select("dims", "x", F.pmod(F.xxhash64("block"), F.lit(n_shards)).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("_g"))
    q = queries.select("dims", F.col("block").alias("qb"), "q", F.pmod(F.xxhash64("block"), F.lit(n_groups)).alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("_s"))
    return q.hint("merge").join(x, ["_g", "_s", "dims"]).select("qb", "q", "x")


class Best:
    """The k best (score, id) of each query of a block; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, whole: bool = False):
        self.ids, self.k = ids, k
        self.empty = np.iinfo(np.int64).min if whole else -np.inf
        self.score = np.full((len(ids), k), self.empty, np.int64 if whole else np.float64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.flatnonzero((ids != self.ids[query]) & (scores >= self.score[query, -1]))
        if len(keep) > 4 * self.k:  # all that tie with the k-th best stay
            keep = keep[scores[keep] >= np.partition(scores[keep], -self.k)[-self.k]]
        if not len(keep):
            return
        score = np.concatenate([self.score[query], scores[keep]])
        found = np.concatenate([self.found[query], ids[keep]])
        order = np.lexsort((found, ~score if score.dtype == np.int64 else -score))[: self.k]
        self.score[query], self.found[query] = score[order], found[order]

    def rows(self, qb: int) -> pa.RecordBatch:
        qi, place = np.nonzero(self.found < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(qi), qb), pa.int64()), pa.array(qi, pa.int32()), pa.array(self.ids[qi], pa.int64()), pa.array(self.found[qi, place], pa.int64()), pa.array(self.score[qi, place])],
            names=["qb", "qi", "query_id", "vec_id", "score"],
        )


def searched(pairs: DataFrame, k: int, meet: Callable[[dict, dict, Best], None], whole: bool = False) -> DataFrame:
    """The best of each task's queries; ``meet(query block, index block, best)`` adds what a pair of blocks gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for qb, q, x in zip(*batch.columns, strict=True):
                q, x = q.as_py(), x.as_py()
                if at != (qb.as_py(), q["dims"]):
                    if best is not None:
                        yield best.rows(at[0])
                    at, best = (qb.as_py(), q["dims"]), Best(np.frombuffer(q["ids"], np.int64), k, whole)
                meet(q, x, best)
        if best is not None:
            yield best.rows(at[0])

    return pairs.sortWithinPartitions("qb").mapInArrow(lean(run), f"qb bigint, qi int, query_id bigint, vec_id bigint, score {'bigint' if whole else 'double'}")


def ranked(results: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query row."""
    place = F.row_number().over(Window.partitionBy("qb", "qi").orderBy(F.desc("score"), "vec_id"))
    return results.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
