"""Graph operators on edge tables (src, dst, weight) and node tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import number, vendor_of
from riskweave.operators import similarity
from riskweave.operators.filters import one_row
from riskweave.session import stage, unstage


def bipartite(df: DataFrame, key: str = "cve_id", listed: str = "cwe", most: int = 20) -> DataFrame:
    """(key, item) of the comma list's first ``most`` items, blanks and ``nan``/``none`` left out, once each."""
    items = F.transform(F.slice(F.split(F.col(listed), ","), 1, most), lambda x: F.trim(x))
    return df.select(key, F.explode(items).alias("item")).where(~F.lower("item").isin("", "nan", "none")).distinct()


def vendor_graph(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, key: str = "cve_id", text: str = "description") -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) of records to the vendor their text names, and (vendor, n, columns) the means of standardised columns of each vendor's records.

    Vendors, means and deviations come from ``fit_on`` (the records themselves if none is given); a vendor that isn't among these counts as unknown_vendor.
    """
    fit = df if fit_on is None else fit_on
    named = fit.select(vendor_of(F.col(text)).alias("vendor"), *columns)
    params = one_row(named, *[f(number(c)).alias(f"_{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = named.join(params).select("vendor", *[((number(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}"))).alias(c) for c in columns])
    means = scaled.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
    edges = df.select(F.col(key).alias("src"), vendor_of(F.col(text)).alias("vendor")).join(means.select("vendor", F.col("vendor").alias("_known")), "vendor", "left")
    return edges.select("src", F.coalesce("_known", F.lit("unknown_vendor")).alias("dst")), means


#: Edges of a node that one task gets; a node of more is cut into replicas that hold its edges in shares. Cut nodes up to which their list is broadcast.
HUB, BROADCAST_HUBS = 10_000, 100_000


def _both(edges: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight")
    return edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src")))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges in both directions with the weight's share of the source's sum."""
    both = _both(edges)
    sums = both.groupBy("src").agg(F.sum("weight").alias("_sum"))
    return both.join(sums, "src").select("src", "dst", (F.col("weight") / F.col("_sum")).alias("share"))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_HUBS else table


def _dealt(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged links (src, part, dst, weight), those of a node of several parts dealt to its replicas by a hash of the other end."""
    hubs = _few(nodes.where("parts > 1").select(F.col("id").alias("src"), "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"), F.lit(0))
    return stage(links.join(hubs, "src", "left").select("src", part.alias("part"), "dst", "weight").repartition("src", "part"), "walk-links")


def _parts(hub: int | None = None) -> Column:
    return F.ceil(F.count(F.lit(1)) / F.lit(hub or HUB)).cast("int").alias("parts")


def cut(edges: DataFrame, hub: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Staged links (src, part, dst, weight) in both directions, and nodes (id, total, parts): the sum of a node's weights and the number of replicas that its links are dealt to, by a hash of the other end."""
    both = stage(_both(edges), "walk-both")
    nodes = stage(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"), _parts(hub)), "walk-nodes")
    links = _dealt(both, nodes)
    unstage(both)
    return links, nodes


def twins(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged members (id, class), nodes (id, total, parts, size) and links (src, part, dst, weight) of the graph whose nodes are classes of twins: nodes of the same neighbours, weights and seeds.

    Twins have the same score in every round, so a walk over the classes gives that of each member. A link into a class sums the weights of the links into one member, its least id. Neighbours and weights are compared
    by two independent 64-bit sums of hashes, taken with the node's total in one aggregation of fixed size, whatever the number of neighbours. seeds: (id, ...), whose other columns tell twins apart too.
    """
    marks = lambda *of: [F.bit_xor(F.xxhash64(F.lit(n), *of)).alias(f"_{n}") for n in (1, 2)]
    both = stage(_both(edges), "walk-both")
    every = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("total"), *marks("dst", "weight"))
    told = seeds.groupBy("id").agg(*[m.alias(f"_s{n}") for n, m in enumerate(marks(*[c for c in seeds.columns if c != "id"]), 1)])
    name = F.concat_ws(":", *[F.coalesce(c, F.lit(0)) for c in ("_1", "_2", "_s1", "_s2")])
    members = stage(every.join(told, "id", "left").select("id", "total", name.alias("class")), "walk-members")
    classes = stage(members.groupBy("class").agg(F.min(F.struct("id", "total")).alias("_m"), F.count(F.lit(1)).alias("size")).select("class", F.col("_m.id").alias("src"), F.col("_m.total").alias("total"), "size"), "walk-classes")
    into = both.join(_few(classes.select("src", F.col("class").alias("_to"))), "src").select(F.col("dst").alias("id"), "_to", "weight")
    links = stage(into.join(members.select("id", "class"), "id").groupBy(F.col("class").alias("src"), F.col("_to").alias("dst")).agg(F.sum("weight").alias("weight")), "walk-classed")
    nodes = stage(classes.select(F.col("class").alias("id"), "total", "size").join(links.groupBy(F.col("src").alias("id")).agg(_parts()), "id"), "walk-nodes")
    dealt = _dealt(links, nodes)
    unstage(both), unstage(classes), unstage(links)
    return members.select("id", "class"), nodes, dealt


def diffusion(edges: DataFrame, seeds: DataFrame, restart: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, batch: str | None = None, every: int = 5) -> DataFrame:
    """(id, score) of a random walk with restart from the seeds (id, score); uniform where none is in the graph.

    With ``batch`` one walk for each of its values, side by side: (batch, id, score) of the nodes that a walk reaches; a walk without a seed in the graph has none.
    The walk goes over classes of :func:`twins`, and gives each member its class's score at the end: records that share their few neighbours cost their rounds once. Links are staged once and dealt out by source
    and replica: a node sends its score, over its sum of weights, to each of its replicas, which multiply and sum partly before messages meet at their ends. So a hub's links are no task's alone.
    Ranks are staged every few rounds, when the change since the last time is measured too, over all members.
    """
    keys = [batch] if batch else []
    given = stage(seeds.groupBy(*keys, "id").agg(F.sum("score").cast("double").alias("_s")), "walk-given")
    members, nodes, links = twins(edges, given)
    inside = stage(given.join(members, "id").groupBy(*keys, F.col("class").alias("id")).agg(F.max("_s").alias("_s"), F.sum("_s").alias("_sum")), "walk-inside")
    totals = inside.groupBy(*keys).agg(F.sum("_sum").alias("_t"))
    if batch:
        base = inside.join(totals, keys).where("_t > 0").select(*keys, "id", (F.col("_s") / F.col("_t")).alias("seed"))
    else:
        n = one_row(nodes, F.sum("size").alias("_n"))
        start = nodes.join(inside, "id", "left").join(F.broadcast(totals)).join(n)
        seed = F.when(F.coalesce("_t", F.lit(0.0)) > 0, F.coalesce("_s", F.lit(0.0)) / F.col("_t")).otherwise(1.0 / F.col("_n"))
        base = start.select("id", seed.alias("seed"), "total", "parts")
    base = stage(base, "walk-seeds")
    ranks, kept = base.withColumnRenamed("seed", "score"), None
    for i in range(1, rounds + 1):
        known = ranks.join(nodes, "id") if batch else ranks
        asked = known.select(*keys, F.col("id").alias("src"), (F.col("score") / F.col("total")).alias("_sent"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sent = links.join(asked, ["src", "part"]).groupBy(*keys, F.col("dst").alias("id")).agg(F.sum(F.col("_sent") * F.col("weight")).alias("_in"))
        met = base.join(sent, [*keys, "id"], "full_outer" if batch else "left")
        step = met.select(*keys, "id", ((1 - restart) * F.coalesce("_in", F.lit(0.0)) + restart * F.coalesce("seed", F.lit(0.0))).alias("score"), *([] if batch else ["total", "parts"]))
        if i % every and i < rounds:
            ranks = step
            continue
        new = stage(step, "walk-ranks")
        old = ranks if kept is None and every == 1 else kept
        change = F.col("size") * F.abs(F.col("score") - F.coalesce("_o", F.lit(0.0)))
        moved = None if old is None else new.join(old.select(*keys, "id", F.col("score").alias("_o")), [*keys, "id"], "left").join(nodes.select("id", "size"), "id").agg(F.sum(change)).first()[0]
        if kept is not None:
            unstage(kept)
        kept = ranks = new
        if moved is not None and moved < tolerance:
            break
    return members.join(_few(ranks.select(*keys, F.col("id").alias("class"), "score")), "class").select(*keys, "id", "score")


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """The same walk with ``damping`` as the chance to go on."""
    return diffusion(edges, seeds, 1 - damping, tolerance, rounds)


def walk_quality(ranks: DataFrame, labels: DataFrame, k: int, relevant: float = 3.0) -> DataFrame:
    """One row: precision and mean label of the first k, and the share of them that have a label."""
    tops = ranks.orderBy(F.desc("score"), "id").limit(k).join(labels, "id", "left")
    return tops.agg(F.avg((F.coalesce("label", F.lit(0)) >= relevant).cast("double")).alias("precision"), F.round(F.avg("label"), 6).alias("mean_label"), F.avg(F.col("label").isNotNull().cast("double")).alias("coverage"))


def filled(df: DataFrame, ranks: DataFrame, key: str, default: float) -> DataFrame:
    """df with the score of its node, the default outside the graph."""
    return df.join(ranks.withColumnRenamed("id", key), key, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def neighbour_means(edges: DataFrame, features: DataFrame, columns: list[str], relation: str = "relation", hops: int = 1) -> DataFrame:
    """features with, for each hop and relation, the means over the neighbours of what they had before that hop, over edges in both directions; 0 without neighbours.

    The first hop has ``{relation}_1_{column}``; hop h has ``{relation}_{h}_`` before each name of hop h - 1, so every order of relations along the way is there. The neighbours' values travel as one
    array, and the sums of all relations are taken in one aggregation. Edges are staged once and each hop's means too; nodes of more than HUB edges send theirs by broadcast, so that no task sorts a hub's edges.
    """
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), relation)
    both = stage(edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src")))).distinct(), "neighbour-edges")
    hubs = stage(both.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select("src"), "neighbour-hubs")
    cuts = 0 < hubs.count() <= BROADCAST_HUBS
    names = [r[0] for r in both.select(relation).distinct().orderBy(relation).collect()]  # the few kinds of edges
    out, current = features, list(columns)
    for hop in range(1, hops + 1):
        packed = out.select(F.col("id").alias("src"), F.array(*[number(c) for c in current]).alias("_x"))
        added = [f"{name}_{hop}_{c}" for name in names for c in current]
        if not added:
            break
        means = [F.avg(F.when(F.col(relation) == name, F.get("_x", F.lit(i)))).alias(f"{name}_{hop}_{c}") for name in names for i, c in enumerate(current)]
        if cuts:
            sent = both.join(F.broadcast(hubs), "src", "left_anti").join(packed, "src").unionByName(both.join(F.broadcast(packed.join(F.broadcast(hubs), "src", "left_semi")), "src"))
        else:
            sent = both.join(packed, "src")
        met = sent.groupBy(F.col("dst").alias("id")).agg(*means)
        out = out.join(met, "id", "left").fillna(0.0, added)
        out = stage(out, "neighbour-means") if hop < hops else out
        current = added
    return out


def two_hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, hop) of the start nodes and those within two edges of them, at their least distance."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    zero = start.select("id").distinct()
    one = both.join(zero.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    two = both.join(one.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    every = zero.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))
    return every.groupBy("id").agg(F.min("hop").cast("bigint").alias("hop"))


def similar(vectors: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.7, block: int = 16384, parts: int = 24) -> DataFrame:
    """(src, dst, weight): the k most cosine-similar other rows of each row, of those at ``least`` or more; ties to the smaller key. Exact: every two rows of
    the same number of components are compared; vectors that are null, empty, or hold null or non-finite components take no part.

    Rows are dealt to blocks of about ``block`` rows (fewer, if these hold more than a million numbers, or if that gives fewer than ``parts`` blocks), and each two blocks meet once, for both directions. A task holds one block and
    reads the other; a row is sent once for each block, and what comes out is at most k rows for each row and pair of blocks.
    """
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(sound).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    block = max(1, min(block, 2**20 // (size["d"] or 1)))
    blocks = max(1, -(-size["n"] // block), min(parts, -(-size["n"] // 512)))
    pairs = blocks * (blocks + 1) // 2
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_b")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("_o")
    met = rows.select("id", "v", F.size("v").cast("bigint").alias("_d"), own, each).select("_d", F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), (F.col("_b") > F.col("_o")).alias("_reads"), "id", "v")
    by = ["_d", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready, found, count = None, [], None, [], 0

        def gathered() -> tuple:
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(ids, kind="stable")
            return ids[order], x[order]

        def closed() -> Iterator[pa.RecordBatch]:
            if held and current[1] == current[2]:
                found.extend(similarity.all_pairs(*gathered(), *gathered(), k, least))
            if found:
                a, b, weight = (np.concatenate([f[i] for f in found]) for i in range(3))
                if current[1] != current[2]:
                    a, b, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
                at = similarity.firsts(a, b, weight, k)
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (a, b, weight)], names=["src", "dst", "weight"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            begins = np.flatnonzero(np.any(np.diff(keys, axis=0, prepend=keys[:1] - 1) != 0, axis=1)) if len(keys) else []
            for begin, end in zip(begins, [*begins[1:], len(keys)]):
                if current is None or not np.array_equal(current, keys[begin]):
                    if current is not None:
                        yield from closed()
                    current, held, ready, found, count = keys[begin], [], None, [], 0
                part = batch.slice(int(begin), int(end - begin))
                reads, ids = part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
                x = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), int(current[0]))
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                if (~reads).any():
                    held.append((ids[~reads], x[~reads]))
                if reads.any() and held:
                    ready = ready or gathered()
                    for f in similarity.all_pairs(ids[reads], x[reads], *ready, k, least):
                        found.append(f)
                        count += len(f[0])
                        if count > 2_000_000:  # what may still be among the first of either side stays
                            a, b, weight = (np.concatenate([f[i] for f in found]) for i in range(3))
                            at = np.union1d(similarity.firsts(a, b, weight, k), similarity.firsts(b, a, weight, k))
                            found = [(a[at], b[at], weight[at])]
                            count = len(found[0][0]) // 2
        if current is not None:
            yield from closed()

    dealt = met.repartition(min(pairs, 512), *by).sortWithinPartitions(*by, "_reads")
    found = dealt.mapInArrow(run, "src bigint, dst bigint, weight double")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return found.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")
