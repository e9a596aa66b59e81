"""Similarity graph without all pairs: trees of cuts over rotated unit vectors, balls around rows to say where else to look, salted leaves, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import stage

#: Rows of a leaf that a task holds, and rows that it scores at once.
BLOCK, PROBED = 2048, 512
#: Numbers (rows x components) of the sample from which a tree's cuts come, and its rows for a leaf.
SAMPLED, PER_LEAF = 8_000_000, 8
#: What is added to a ball's squared radius: weights are rounded to nine digits, and equal ones count.
SLACK = 4e-9

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def nearest(asked: np.ndarray, x: np.ndarray, others: np.ndarray, index: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place in others, weight) of the ``k`` most cosine-similar others of each unit vector, of those at the row's ``least`` or more; by row, weight and then key. ``others`` is sorted; a row's own key is none."""
    cosine = x @ index.T
    begin, end = np.searchsorted(others, asked), np.searchsorted(others, asked, "right")
    for i in np.flatnonzero(begin < end):
        cosine[i, begin[i] : end[i]] = -2
    low = least - 1e-9
    hits = cosine >= low[:, None]
    if len(others) > k and np.count_nonzero(hits) > 4 * k * len(x):
        low = np.maximum(low, np.partition(cosine, len(others) - k, axis=1)[:, len(others) - k] - 1e-9)
        hits = cosine >= low[:, None]
    row, col = np.nonzero(hits)
    weight = np.round(cosine[row, col], 9)
    kept = weight >= least[row]
    row, col, weight = row[kept], col[kept], weight[kept]
    at = firsts(row, col, weight, k)
    return row[at], col[at], weight[at]


def firsts(a: np.ndarray, b: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Where, in order, the ``k`` of each ``a`` are that come first by weight, largest first, and then by ``b``."""
    order = np.lexsort((b, -weight, a))
    a = a[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def all_pairs(asked: np.ndarray, x: np.ndarray, others: np.ndarray, index: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, weight) of pairs of asked and others (sorted) at ``least`` or more, among them the k most similar others of each asked and, by their own parts of at most PROBED asked, the k most similar asked of each other.

    Single precision says which pairs may reach ``least``; the weights of these are computed in double precision. Where many do, the k of each side are taken at once.
    """
    rough, dims = index.astype(np.float32), x.shape[1]
    for low in range(0, len(x), PROBED):
        ids, part = asked[low : low + PROBED], x[low : low + PROBED]
        for at in range(0, len(index), 4096):
            keys, held = others[at : at + 4096], index[at : at + 4096]
            hits = np.flatnonzero(part.astype(np.float32) @ rough[at : at + 4096].T >= np.float32(least - 1e-6 - 2e-7 * dims))
            if len(hits) > 4 * k * len(part):
                order = np.argsort(ids, kind="stable")
                row, col, weight = nearest(ids, part, keys, held, k, np.full(len(part), float(least)))
                col_too, row_too, weight_too = nearest(keys, held, ids[order], part[order], k, np.full(len(held), float(least)))
                row, col, weight = np.concatenate([row, order[row_too]]), np.concatenate([col, col_too]), np.concatenate([weight, weight_too])
                once = np.unique(row * len(held) + col, return_index=True)[1]
                yield ids[row[once]], keys[col[once]], weight[once]
                continue
            for begin in range(0, len(hits), max(1, 1_000_000 // dims)):
                row, col = np.divmod(hits[begin : begin + max(1, 1_000_000 // dims)], len(held))
                weight = np.round(np.einsum("ij,ij->i", part[row], held[col]), 9)
                kept = (weight >= least) & (ids[row] != keys[col])
                yield ids[row[kept]], keys[col[kept]], weight[kept]


def grown(sample: np.ndarray, depth: int, seed: int, tree: int) -> Tree:
    """A rotation, and for each node of a complete tree the axis and the place of its cut: the sample's median on the axis on which the node's rows vary most.
    The first tree turns to the sample's principal axes, others at random."""
    dims = sample.shape[1]
    if tree == 0:
        turn = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims))[1]
    else:
        turn = np.linalg.qr(np.random.default_rng([seed, dims, tree]).standard_normal((dims, dims)))[0]
    z = sample @ turn
    axes, cuts = np.zeros(2**depth - 1, dtype=np.int64), np.zeros(2**depth - 1)
    node = np.zeros(len(z), dtype=np.int64)
    for level in range(depth):
        n = np.bincount(node, minlength=2**level)
        some = np.maximum(n, 1)
        spread = np.stack([np.bincount(node, z[:, i] ** 2, 2**level) / some - (np.bincount(node, z[:, i], 2**level) / some) ** 2 for i in range(dims)], axis=1)
        axis = spread.argmax(1)
        value = z[np.arange(len(z)), axis[node]]
        order = np.lexsort((value, node))
        middle = np.minimum(np.cumsum(n) - n + n // 2, len(z) - 1)
        cut = (value[order[middle]] + value[order[np.maximum(middle - 1, 0)]]) / 2
        cut[n < 2] = 0.0
        axes[2**level - 1 : 2 ** (level + 1) - 1], cuts[2**level - 1 : 2 ** (level + 1) - 1] = axis, cut
        node = 2 * node + (value > cut[node])
    return turn, axes, cuts


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    turn, axes, cuts = tree
    z, node = x @ turn, np.zeros(len(x), dtype=np.int64)
    for level in range((len(axes) + 1).bit_length() - 1):
        at = node + 2**level - 1
        node = 2 * node + (z[np.arange(len(z)), axes[at]] > cuts[at])
    return node


def reached(tree: Tree, x: np.ndarray, square: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves that the ball around a row touches, whose squared radius is given, of each row's the ``most`` nearest; and which rows' balls touch more."""
    turn, axes, cuts = tree
    z = x @ turn
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    off, far, more = np.zeros_like(z), np.zeros(len(x)), np.zeros(len(x), dtype=bool)
    for level in range((len(axes) + 1).bit_length() - 1):
        at = node + 2**level - 1
        axis = axes[at]
        gap = z[row, axis] - cuts[at]
        beyond = far - off[np.arange(len(row)), axis] ** 2 + gap**2  # the other side of the cut is that far off on its axis
        other = np.flatnonzero(beyond <= square[row])
        off = np.concatenate([off, off[other]])
        off[np.arange(len(row), len(off)), axis[other]] = np.abs(gap[other])
        side = gap > 0
        node = np.concatenate([2 * node + side, 2 * node[other] + ~side[other]])
        row, far = np.concatenate([row, row[other]]), np.concatenate([far, beyond[other]])
        if (np.bincount(row, minlength=len(x)) > most).any():
            order = np.lexsort((far, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            more[row[order[rank >= most]]] = True
            kept = order[rank < most]
            row, node, far, off = row[kept], node[kept], far[kept], off[kept]
    return row, node, more


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(counts: np.ndarray, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)


def _of_sizes(batch: pa.RecordBatch, lists: int, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch of one number of components each."""
    sizes = np.diff(batch.column(lists).offsets.to_numpy())
    for dims in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == dims))) if (sizes != dims).any() else batch
        for low in range(0, part.num_rows, size):
            yield int(dims), part.slice(low, size)


def approximate(vectors: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.7, tables: int = 8, probes: int = 8, per_bucket: int = 512, seed: int = 7) -> DataFrame:
    """(src, dst, weight): up to ``k`` most cosine-similar other rows of each row, of those at ``least`` or more; ties to the smaller key. Weights are exact. Vectors that are null, empty,
    or hold null or non-finite components take no part.

    A tree of cuts, fitted on a sample of at most SAMPLED numbers, deals unit vectors to leaves of about ``per_bucket`` rows (more, where the sample has fewer than PER_LEAF for a leaf).
    A row first meets its own leaf. No nearer neighbour than its k-th so far lies outside the ball up to that one, so it then looks only into the leaves that this ball touches. Where these are
    3 x ``probes`` or fewer, the row's neighbours are the true ones. Others look into the nearest so many, and into ``probes`` leaves of each of ``tables`` - 1 further trees of other rotations; they may miss some.

    Equal vectors are searched once, and of each such group only the k + 1 smallest keys can be among a row's nearest. A leaf above BLOCK rows is dealt out by salt, and all that look into it go to every part.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(sound).select(F.col(key).cast("bigint").alias("id"), F.transform(v, lambda x: x + 0.0).alias("v"))
    # the rows of equal vectors come in key order, and Spark limits them before it shuffles
    copies = stage(rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1), "similar-copies")
    single = copies.where("_n = 1").select("id", "v")
    counts = {r["d"]: r["n"] for r in single.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each number of components
    samples = _samples(single, counts, per_bucket)
    depths = {d: max(0, int(np.floor(np.log2(min(counts[d] / per_bucket, len(x) / PER_LEAF))))) + 1 for d, x in samples.items() if len(x) >= 2 * PER_LEAF}
    first = {d: grown(samples[d], depth, seed, 0) for d, depth in depths.items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _of_sizes(batch, 1, 8192):
                x = _matrix(part.column(1), dims)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                leaf = leaves(first[dims], x) if dims in first else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dims, np.int32)), pa.array(leaf), part.column(0), _lists(np.full(len(x), dims), pa.array(x.ravel()))], names=["dims", "leaf", "id", "v"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leaf and role: held, held and asking, asking only."""
        current, held, waiting, ready = None, [], [], None

        def answered(asks: list[tuple], ready: tuple) -> Iterator[pa.RecordBatch]:
            for who, x, floor in asks:
                for low in range(0, len(who), PROBED):
                    row, col, weight = nearest(who[low : low + PROBED], x[low : low + PROBED], *ready, k, floor[low : low + PROBED])
                    if len(row):
                        n = np.bincount(row)
                        some = np.flatnonzero(n)
                        near = pa.StructArray.from_arrays([pa.array(-weight), pa.array(ready[0][col])], names=["w", "b"])
                        yield pa.RecordBatch.from_arrays([pa.array(who[low : low + PROBED][some]), _lists(n[some], near)], names=["a", "near"])

        def gathered() -> tuple:
            ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, dtype=np.int64)
            order = np.argsort(ids)
            return ids[order], (np.concatenate([h[1] for h in held])[order] if held else np.zeros((0, int(current[0]))))

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            begins = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0, axis=1)) if len(keys) else []
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                if current is None or not np.array_equal(current, keys[begin]):
                    if waiting and held:
                        yield from answered(waiting, gathered())
                    current, held, waiting, ready = keys[begin], [], [], None
                part = batch.slice(int(begin), int(end - begin))
                role, who, x, floor = part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6), int(current[0])), part.column(7).to_numpy()
                inside, both, only = np.flatnonzero(role <= 1), np.flatnonzero(role == 1), np.flatnonzero(role == 2)
                if len(inside):
                    held.append((who[inside], x[inside]))
                if len(both):
                    waiting.append((who[both], x[both], floor[both]))
                if len(only) and held:
                    if ready is None:
                        ready = gathered()
                        yield from answered(waiting, ready)
                        waiting = []
                    yield from answered([(who[only], x[only], floor[only])], ready)
        if waiting and held:
            yield from answered(waiting, gathered())

    by = ["dims", "tree", "leaf", "salt"]

    def met(index: DataFrame, asks: DataFrame | None) -> DataFrame:
        """(a, near) of what asks (dims, tree, leaf, id, v, floor) find in the leaves of index (dims, tree, leaf, id, v); without asks, each row asks in its own leaf."""
        hot = index.groupBy(*by[:3]).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("salts")).where("salts > 1")
        hot = stage(hot, "similar-hot")
        salts = F.coalesce("salts", F.lit(1))
        own, every = F.pmod(F.xxhash64("id"), salts).cast("int"), F.sequence(F.lit(0), salts - 1)
        columns = ["role", "id", "v", "floor"]
        kept = index.join(F.broadcast(hot), by[:3], "left").withColumn("floor", F.lit(float(least)))
        if asks is None:
            dealt = kept.withColumn("salt", F.explode(every)).withColumn("role", F.when(F.col("salt") == own, 1).otherwise(2)).select(*by, *columns)
        else:
            asking = asks.join(F.broadcast(hot), by[:3], "left").withColumn("salt", F.explode(every)).withColumn("role", F.lit(2))
            dealt = kept.withColumn("salt", own).withColumn("role", F.lit(0)).select(*by, *columns).unionByName(asking.select(*by, *columns))
        dealt = dealt.withColumns({c: F.col(c).cast("bigint") for c in by})
        return dealt.repartition(*by).sortWithinPartitions(*by, "role").mapInArrow(scored, "a bigint, near array<struct<w:double,b:bigint>>")

    def merged(found: DataFrame) -> DataFrame:
        """The k nearest of each row's lists. What two trees found may differ in the last digit, so a key counts where it comes first."""
        near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, 2 * k)
        return found.groupBy("a").agg(near.alias("near")).select("a", F.slice(F.filter("near", lambda x, i: F.array_position(F.col("near.b"), x["b"]) == i + 1), 1, k).alias("near"))

    able = single if least <= 0 else single.where(F.exists("v", lambda x: x != 0))
    index = stage(able.mapInArrow(placed, "dims int, leaf bigint, id bigint, v array<double>").withColumn("tree", F.lit(0)), "similar-leaves")
    near = stage(merged(met(index, None)), "similar-own")
    floor = F.when(F.size("near") >= k, -F.element_at("near", -1)["w"]).otherwise(F.lit(float(least)))
    known = index.join(near.select(F.col("a").alias("id"), floor.alias("floor")), "id", "left").select("dims", "leaf", "id", "v", F.coalesce("floor", F.lit(float(least))).alias("floor"))
    forest: dict[int, list[Tree]] = {}

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's leaves beyond its own that its ball touches."""
        for batch in batches:
            for dims, part in _of_sizes(batch, 3, max(16, min(4096, 4_000_000 // (3 * probes * max(1, len(batch.column(3).flatten()) // max(1, batch.num_rows)))))):
                x, own, n = _matrix(part.column(3), dims), part.column(1).to_numpy(), part.num_rows
                more, found = np.zeros(n, dtype=bool), pa.array([], pa.int64())
                count = np.zeros(n, dtype=np.int64)
                if dims in first:
                    row, leaf, more = reached(first[dims], x, 2 - 2 * part.column(4).to_numpy() + SLACK, 3 * probes)
                    row, leaf = row[leaf != own[row]], leaf[leaf != own[row]]
                    order = np.argsort(row, kind="stable")
                    count, found = np.bincount(row, minlength=n), pa.array(leaf[order])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(more), _lists(count, found)], names=["dims", "id", "v", "floor", "more", "leaves"])

    beyond = stage(known.mapInArrow(looked, "dims int, id bigint, v array<double>, floor double, more boolean, leaves array<bigint>").where("more OR size(leaves) > 0"), "similar-reached")
    asks = beyond.select("dims", F.lit(0).alias("tree"), F.explode("leaves").alias("leaf"), "id", "v", "floor")
    found = near.unionByName(met(index, asks))
    open_rows = beyond.where("more")
    if tables > 1 and not open_rows.isEmpty():
        forest.update({d: [grown(samples[d], depth, seed, t) for t in range(1, tables)] for d, depth in depths.items()})

        def elsewhere(asking: bool):  # noqa: ANN202
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for dims, part in _of_sizes(batch, 2, 1024):
                        x = _matrix(part.column(2), dims)
                        for t, tree in enumerate(forest.get(dims, []), 1):
                            row, leaf = (np.arange(len(x)), leaves(tree, x)) if not asking else reached(tree, x, 2 - 2 * part.column(3).to_numpy() + SLACK, probes)[:2]
                            taken = part.take(pa.array(row))
                            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(np.full(len(row), t, np.int32)), pa.array(leaf), *[taken.column(i) for i in range(1, 4)]], names=["dims", "tree", "leaf", "id", "v", "floor"])

            return run

        kind = "dims int, tree int, leaf bigint, id bigint, v array<double>, floor double"
        others = index.withColumn("floor", F.lit(0.0)).select("dims", "id", "v", "floor").mapInArrow(elsewhere(False), kind).drop("floor")
        found = found.unionByName(met(others, open_rows.select("dims", "id", "v", "floor").mapInArrow(elsewhere(True), kind)))
    pairs = merged(found).select("a", F.inline("near")).select("a", "b", (-F.col("w")).alias("weight"))
    near = stage(pairs.unionByName(single.where(F.lit(least <= 1) & F.exists("v", lambda x: x != 0)).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("weight"))), "similar-near")
    named = single.select(F.col("id").alias("_first"), "v")
    members = copies.join(named, "v").select(F.col("_first").alias("b"), F.col("id").alias("dst"))  # k + 1 at most of each group
    sources = rows.join(named, "v").select(F.col("_first").alias("a"), F.col("id").alias("src"))
    pairs = near.join(members, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "dst"))).alias("_near"))  # (k + 1)^2 at most
    out = sources.join(pairs, "a").select("src", F.slice(F.filter("_near", lambda x: x["dst"] != F.col("src")), 1, k).alias("_near"))
    return out.select("src", F.inline("_near")).select("src", "dst", (-F.col("w")).alias("weight"))


def _samples(single: DataFrame, counts: dict[int, int], per_bucket: int) -> dict[int, np.ndarray]:
    """Unit vectors by hash, for each number of components that fills several leaves: a bounded part, which comes to the driver."""
    large = {d: n for d, n in counts.items() if n > per_bucket}
    if not large:
        return {}
    wanted = {d: min(n, SAMPLED // len(large) // d, 2 * PER_LEAF * n // per_bucket) for d, n in large.items()}
    share = F.create_map(*[F.lit(x) for d, n in large.items() for x in (d, int(2**31 * wanted[d] / n))])
    limit = F.element_at(share, F.size("v"))
    found = single.where(F.size("v").isin(list(large)) & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(2**31)) < limit)).select("v").toArrow().column(0).combine_chunks()
    sizes = np.diff(found.offsets.to_numpy())
    out = {}
    for d in large:
        x = found.filter(pa.array(sizes == d)).flatten().to_numpy().reshape(-1, d)
        x = x[(x != 0).any(1)]
        out[d] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return out
