"""Linear rankers fitted together on the preference pairs of ranked rows.

Pairs are not written out: a row stands once, beside the weights of the pairs that it makes with the rows that follow it, and the task that reads it pairs their scores.
A round reads the rows once for all rankers; what it shuffles is one row for each ranker and task.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from riskweave.session import stage

#: Rows of a record, besides those that follow them. A record of 30 features is about 20 KB, so that a batch of them stays small.
STEP = 64
#: Records that meet the rankers at once: what a dozen rankers make of these fits a core's cache.
SLICE = 32
PACKED = "s array<double>, pairs binary"


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(float)


def _records(table: pa.Table, features: list[str], per_row: int, own: int, beyond: bool = False) -> pa.Table:
    """Sums and records of the pairs of the table's first ``own`` rows with the rows that follow; ``beyond``: only with those that are not among the first."""
    n, steps, d = table.num_rows, -(-own // STEP), len(features)
    code = table["group"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    label, weight = _numbers(table, "label"), _numbers(table, "weight")
    keys, x = [None if k is None else k.encode() for k in table["_key"].to_pylist()], np.stack([_numbers(table, c) for c in features], axis=1)
    whole_keys = None not in keys
    power = np.exp2(label)
    pulls, sums = np.zeros((steps * STEP, per_row)), np.zeros(2 + 2 * d)
    for s in range(1, per_row + 1):
        first, m = max(0, own - s) if beyond else 0, max(0, min(own, n - s))
        at = first + np.flatnonzero((code[first:m] == code[first + s : m + s]) & (np.abs(label[first:m] - label[first + s : m + s]) > 0))  # not where a label is missing
        pull = weight[at] * weight[at + s] * np.abs(power[at] - power[at + s])
        sign = np.where(label[at] > label[at + s], 1.0, -1.0)
        pulls[at, s - 1] = sign * pull
        # which side is first is no feature: a hash of both keys says, as in preference_pairs
        both = [keys[i] + b"#" + keys[i + s] if whole_keys else b"#".join(k for k in (keys[i], keys[i + s]) if k is not None) for i in at.tolist()]
        odd = np.array([md5(b).digest()[3] for b in both], dtype=int) & 1
        turned = (x[at] - x[at + s]) * np.where(odd, -sign, sign)[:, None]
        sums += np.concatenate([[pull.sum(), (pull * pull).sum()], pull @ turned, pull @ (turned * turned)])
    whole = np.zeros((steps * STEP + per_row, d))
    whole[:n] = x
    records = [whole[b : b + STEP + per_row].tobytes() + pulls[b : b + STEP].tobytes() for b in range(0, steps * STEP, STEP)]
    return pa.table({"s": pa.array([sums.tolist(), *[None] * steps], pa.list_(pa.float64())), "pairs": pa.array([None, *records], pa.binary())})


def packed(rows: DataFrame, order: list[Column], features: list[str], per_row: int, key: str = "cve_id") -> list[DataFrame]:
    """Rows (key, group, label, weight, features) by their order, which begins with the group, as staged frames: records ``pairs`` of STEP rows, and sums ``s``.

    A record holds the features of its rows and of the ``per_row`` rows that follow, then each row's pairs as weights, negative where the later row is the better one, 0 where
    there is no pair. s: sums of weights and squared weights, then for each feature of weighted differences and their squares, turned by hash of both keys.
    Rows are dealt out by range, however large a group is; the second frame has the pairs across two ranges, from the first and last rows of each, which one task reads.
    """
    ready = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ready = ready.select(F.col(key).cast("string").alias("_key"), "group", "label", "weight", *[F.col(c).cast("double").alias(c) for c in features])
    edge = StructType([StructField("_part", IntegerType()), StructField("_head", BooleanType()), StructField("_place", IntegerType()), *[StructField(f.name, f.dataType) for f in ready.schema.fields]])
    schema = StructType([*StructType.fromDDL(PACKED).fields, *edge.fields])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]

    def filled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [table[c].cast(kind) if c in table.column_names else pa.nulls(table.num_rows, kind) for c, kind in zip(names, kinds)]
        return iter(pa.table(columns, names=names).combine_chunks().to_batches())

    def ends(table: pa.Table, head: bool) -> pa.Table:
        n, number = table.num_rows, TaskContext.get().partitionId()
        for name, values in (("_part", pa.array([number] * n, pa.int32())), ("_head", pa.array([head] * n)), ("_place", pa.array(range(n), pa.int32()))):
            table = table.append_column(name, values)
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rest = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            head = table.slice(0, per_row) if head is None else pa.concat_tables([head, table.slice(0, per_row - head.num_rows)])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows > per_row:
                own = rest.num_rows - per_row
                yield from filled(_records(rest, features, per_row, own))
                rest = rest.slice(own)
        if rest is not None and rest.num_rows:
            yield from filled(_records(rest, features, per_row, rest.num_rows))
            yield from filled(ends(head, True))
            yield from filled(ends(rest, False))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        mark = table["_part"].to_numpy() * 2 + table["_head"].to_numpy(zero_copy_only=False)  # a part's last rows, then its first ones
        cuts = np.append(np.flatnonzero(np.diff(mark, prepend=-1)), len(mark))
        runs = [table.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        lasts, heads = runs[::2], runs[1::2]
        for i, last in enumerate(lasts):
            ahead, more = [], per_row
            for head in heads[i + 1 :]:
                ahead.append(head.slice(0, more))
                more -= ahead[-1].num_rows
                if more <= 0:
                    break
            if ahead:
                yield from _records(pa.concat_tables([last, *ahead]), features, per_row, last.num_rows, beyond=True).combine_chunks().to_batches()

    inner = stage(ready.mapInArrow(run, schema), "ranked-rows")
    edges = inner.where("_part IS NOT NULL").select(*edge.names).repartition(1).sortWithinPartitions("_part", "_head", "_place")
    return [inner, stage(edges.mapInArrow(across, PACKED), "ranked-edges")]


def losses(packs: DataFrame, weights: np.ndarray, per_row: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all pairs of the weighted logistic loss, and of its derivative for each feature, of each row of ``weights``."""
    models, d = weights.shape
    rows = STEP + per_row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, g = np.zeros(models), np.zeros((models, d))
        for batch in batches:
            records = batch.column(0)
            for low in range(0, len(records), SLICE):
                part = np.frombuffer(b"".join(records[low : low + SLICE].to_pylist())).reshape(-1, rows * d + STEP * per_row)
                n = len(part)  # each record's rows lie side by side, so that all rows at a distance of s are one slice
                x = part[:, : rows * d].reshape(n, rows, d).transpose(1, 0, 2).reshape(-1, d)
                pulls = part[:, rows * d :].reshape(n, STEP, per_row).transpose(2, 1, 0).reshape(per_row, -1)
                sizes, turns = np.abs(pulls), -np.sign(pulls)
                score = weights @ x.T
                moves, steep, own = np.zeros_like(score), np.abs(score).max() > 350, slice(0, STEP * n)
                for s in range(1, per_row + 1):
                    later = slice(s * n, (s + STEP) * n)
                    odds = score[:, own] - score[:, later]
                    odds *= turns[s - 1]
                    if steep:
                        np.clip(odds, -700, 700, out=odds)
                    np.exp(odds, out=odds)
                    whole = odds + 1
                    odds /= whole
                    odds *= pulls[s - 1]
                    moves[:, own] -= odds
                    moves[:, later] += odds
                    f += np.log(whole, out=whole) @ sizes[s - 1]
                g += moves @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array(f), pa.array(list(g), pa.list_(pa.float64()))], names=["model", "f", "g"])

    found = packs.where("pairs IS NOT NULL").select("pairs").mapInArrow(run, "model int, f double, g array<double>")
    f, g = np.zeros(models), np.zeros((models, d))
    for r in found.groupBy("model").agg(F.sum("f").alias("f"), F.array(*[F.sum(F.col("g")[i]) for i in range(d)]).alias("g")).collect():  # one row for each model
        f[r["model"]], g[r["model"]] = r["f"], r["g"]
    return f, g


Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _line(x: np.ndarray, way: np.ndarray, f: float, g: np.ndarray, t: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[float, float, float, np.ndarray] | None]:
    """A step along ``way`` that meets the strong Wolfe conditions, as (t, slope, value, gradient); None if ten trials, or ten more between two of them, give none."""
    start = (0.0, float(g @ way), f, g)
    if start[1] > 0:
        return None

    def between(a: tuple, b: tuple) -> float:  # where the cubic through both is least, not near their ends
        (p, dp, fp, _), (q, dq, fq, _) = sorted((a, b), key=lambda c: c[0])
        u = dp + dq - 3 * (fp - fq) / (p - q)
        v = np.sqrt(max(u * u - dp * dq, 0.0))
        bottom = dq - dp + 2 * v
        found = q - (q - p) * (dq + v - u) / bottom if bottom else (p + q) / 2
        return float(min(max(found, p + 0.1 * (q - p)), p + 0.9 * (q - p)))

    low, high = start, None
    for i in range(10):
        value, gradient = yield x + t * way
        c = (t, float(gradient @ way), value, gradient)
        if not np.isfinite(value):
            t /= 2
            continue
        if value > f + 1e-4 * t * start[1] or (i and value >= low[2]):
            high = c
            break
        if abs(c[1]) <= 0.9 * abs(start[1]):
            return c
        if c[1] >= 0:
            low, high = c, low
            break
        low, t = c, 1.5 * t
    if high is None:
        return None
    for _ in range(10):
        t = between(low, high)
        value, gradient = yield x + t * way
        c = (t, float(gradient @ way), value, gradient)
        if value > f + 1e-4 * t * start[1] or value >= low[2]:
            high = c
            continue
        if abs(c[1]) <= 0.9 * abs(start[1]):
            return c
        if c[1] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    return None


def descent(n: int, rounds: int, tolerance: float = 1e-6, memory: int = 10) -> Search:
    """L-BFGS from 0, as pyspark.ml's LogisticRegression sets it: yields points, takes (value, gradient) of each, and returns the last accepted point."""
    x = np.zeros(n)
    f, g = yield x
    first, values, steps, failed, done = f, [], [], False, 0
    while done < rounds and np.linalg.norm(g) > max(tolerance * f, 1e-8) and not (done >= 20 and abs(f - max(values[-20:])) <= tolerance * first):
        way, shares = g.copy(), []
        for moved, turned in reversed(steps):
            shares.append(float(moved @ way) / float(moved @ turned))
            way -= shares[-1] * turned
        if steps:
            way *= float(steps[-1][0] @ steps[-1][1]) / float(steps[-1][1] @ steps[-1][1])
        for (moved, turned), share in zip(steps, reversed(shares)):
            way += (share - float(turned @ way) / float(moved @ turned)) * moved
        found = yield from _line(x, -way, f, g, 1.0 if done else 1.0 / float(np.linalg.norm(way)))
        if found is None or found[0] * np.linalg.norm(g) < 1e-10:
            if failed:
                break
            steps, failed = [], True  # once more, straight down
            continue
        moved = -found[0] * way
        x, f, turned, g, failed = x + moved, found[2], found[3] - g, found[3], False
        steps = [*steps, (moved, turned)][-memory:] if moved @ turned > 0 else []
        values.append(f)
        done += 1
    return x


def fitted(frames: list[DataFrame], features: list[str], variants: list[list[str]], per_row: int, regular: float = 0.01, rounds: int = 30) -> list[dict[str, float]]:
    """For each list of columns the weights that ``models.fit_pairs`` gives, but all fitted together. Without pairs all weights are 0. ValueError if the pairs' numbers aren't finite."""
    d, packs = len(features), reduce(DataFrame.unionByName, [frame.select("s", "pairs") for frame in frames])
    total = packs.where("s IS NOT NULL").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(2 + 2 * d)]).alias("s")).first()["s"]
    if not total[0]:
        return [dict.fromkeys(columns, 0.0) for columns in variants]
    if not np.isfinite(total).all():
        raise ValueError("features and weights of pairs must be finite numbers")
    whole, squares, one, two = total[0], total[1], np.array(total[2 : 2 + d]), np.array(total[2 + d :])
    free = whole - squares / whole
    deviation = np.sqrt(np.maximum(two - one * one / whole, 0) / free) if free > 0 else np.zeros(d)
    scale = np.divide(1.0, deviation, out=np.zeros(d), where=deviation > 0)
    place = {c: i for i, c in enumerate(features)}
    used = [[place[c] for c in columns] for columns in variants]
    searches, out = [descent(len(u), rounds) for u in used], [np.zeros(len(u)) for u in used]
    asked = {m: next(search) for m, search in enumerate(searches)}
    while asked:
        weights = np.zeros((len(asked), d))
        for r, (m, point) in enumerate(asked.items()):
            weights[r, used[m]] = point * scale[used[m]]
        f, g = losses(packs, weights, per_row)
        more = {}
        for r, (m, point) in enumerate(asked.items()):
            try:
                more[m] = searches[m].send((float(f[r] / whole + regular / 2 * (point @ point)), g[r, used[m]] * scale[used[m]] / whole + regular * point))
            except StopIteration as end:
                out[m] = end.value
        asked = more
    return [{c: float(v) for c, v in zip(columns, out[m] * scale[used[m]])} for m, columns in enumerate(variants)]
