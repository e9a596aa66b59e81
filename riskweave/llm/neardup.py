"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of five words (ASCII letters and digits and all other characters; A-Z as a-z); a text of fewer words is one shingle. A
shingle's weight is its count in the document times ``1 + ln((1 + N) / (1 + max(df, floor * N)))``: shingles in fewer than
the share ``floor`` of documents weigh alike, so only those above need counting, exactly: one that has the share in the whole has it in at
least one group of documents, so each task's groups name candidates and a second pass counts them over all documents.

Equal word sequences become one node first. Each node draws consistent weighted samples; two nodes agree on a sample with the probability
of their weighted Jaccard similarity. Bands of samples make buckets. Links of a bucket to its pivot, the node that shares buckets with most others, are verified
exactly. Then, in buckets whose nodes are still in different components, nodes of different components that share a bucket are compared if 29 of
their 48 samples agree (at similarity 0.8 fewer do with a probability of 2e-4, below that of sharing no bucket): in small buckets as pairs,
in large ones block by block within tasks, where a block of one component is not compared with another of the same, and only links that join components come out.
The rule for a pair is the same in both. Classes are the connected components.

Defined results: texts without words, null ones too, are alone in their class; texts of any length are read whole; repeated rows and ids each count; a class is
named by its least doc_id (null if all are null), and by class_key, which differs between classes also where ids repeat or are null; an empty table gives an empty result; further columns are ignored by
:func:`classes` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import _text
from riskweave.llm._columns import guarded
from riskweave.llm._graph import components
from riskweave.llm._memory import lean
from riskweave.session import stage

WIDTH = 5
BANDS, ROWS = 12, 4
SIMILARITY = 0.8
FLOOR = 0.01
#: Distinct shingles of a group whose frequent ones are named together, and candidates up to which they are broadcast.
GROUP_SHINGLES = 1_000_000
BROADCAST_CANDIDATES = 4_000_000
#: Samples of which compared nodes share so many at least.
AGREEING = 29
#: Nodes up to which a bucket's rest is compared as pairs; nodes and bytes of a block of larger ones.
SMALL_BUCKET = 24
BLOCK_NODES, BLOCK_BYTES = 256, 4 << 20
#: Shingles sampled at once.
SAMPLED_AT_ONCE = 1 << 13


class Shingler:
    """Shingles of the texts of an Arrow column, a chunk at a time."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.table = _text.WordTable(_text.NON_WORDS)
        self.factors = np.random.default_rng(7).integers(0, 1 << 64, width, dtype=np.uint64) | np.uint64(1)

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, word-sequence keys as n x 2, row of each distinct shingle, shingle, count); shingles ascend within a row."""
        body, offsets = _text.utf8_parts(column)
        for i, j in _text.chunks(offsets):
            hashes, rows, _, _ = self.table.words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield i, j - i, *self._sets(hashes, rows, j - i)

    def _sets(self, hashes: np.ndarray, rows: np.ndarray, n: int):
        words = np.bincount(rows, minlength=n)
        ends = np.cumsum(words)
        starts = ends - words
        keys = np.zeros((n, 2), np.uint64)
        some = np.flatnonzero(words)
        with np.errstate(over="ignore"):
            if len(some):
                place = (np.arange(len(hashes)) - np.repeat(starts, words)).astype(np.uint64)
                for k in (0, 1):
                    mixed = _text.mix(hashes ^ _text.mix(place, 11 + k), 3 + k)
                    keys[some, k] = np.add.reduceat(mixed, starts[some]) + words[some].astype(np.uint64)
            count = np.where(words >= self.width, words - self.width + 1, np.minimum(words, 1))
            out = np.zeros(int(count.sum()), np.uint64)
            first = np.cumsum(count) - count
            if len(hashes) >= self.width:
                runs = np.zeros(len(hashes) - self.width + 1, np.uint64)
                for k in range(self.width):
                    runs += hashes[k : len(hashes) - self.width + 1 + k] * self.factors[k]
                whole = rows[: len(runs)] == rows[self.width - 1 :]
                out[np.repeat(words >= self.width, count)] = _text.mix(runs[whole], 1)
            short = np.flatnonzero((words > 0) & (words < self.width))
            out[first[short]] = keys[short, 0]
        for a, b in zip(first, first + count):
            out[a:b].sort()
        of = np.repeat(np.arange(n), count)
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(fresh)
        return keys, of[at], out[at], np.diff(np.append(at, len(out)))


class Weights:
    """Inverse document frequencies: of the frequent shingles by table, of all others the highest."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, n_docs: int, floor: float):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.idf = self._idf(df[order].astype(float), n_docs).astype(np.float32)
        self.rare = np.float32(self._idf(np.array(max(floor * n_docs, 0.0)), n_docs))

    @staticmethod
    def _idf(df, n_docs):
        return 1 + np.log((1 + n_docs) / (1 + df))

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = np.full(len(shingles), self.rare, np.float32)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            hit = self.shingles[at] == shingles
            idf[hit] = self.idf[at[hit]]
        return idf * counts.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: r and c from Gamma(2, 1), beta uniform, by parts of the shingle's hash."""

    SIZE = 1 << 12

    def __init__(self, samples: int):
        random = np.random.default_rng(20101214)
        self.r = random.gamma(2.0, 1.0, (self.SIZE, samples)).astype(np.float32) + np.float32(1e-6)
        self.log_c = np.log(random.gamma(2.0, 1.0, (self.SIZE, samples)) + 1e-12).astype(np.float32)
        self.beta = random.random((self.SIZE, samples)).astype(np.float32)
        self.samples = samples

    def sign(self, rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """n x samples fingerprints of (chosen shingle, its level); rows ascend; rows without shingles get 0."""
        best = np.full((n, self.samples), np.inf, np.float32)
        out = np.zeros((n, self.samples), np.uint64)
        for i in range(0, len(rows), SAMPLED_AT_ONCE):
            part = slice(i, i + SAMPLED_AT_ONCE)
            self._part(rows[part], shingles[part], np.log(weights[part])[:, None], best, out)
        return out

    def _part(self, rows, shingles, log_weight, best, out):
        mixed = _text.mix(shingles, 5)
        low = np.uint64(self.SIZE - 1)
        r = self.r[mixed & low]
        beta = self.beta[(mixed >> np.uint64(16)) & low]
        level = np.floor(log_weight / r + beta)
        value = self.log_c[(mixed >> np.uint64(32)) & low]
        value -= r * (level - beta)
        value -= r
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        own = rows[first]
        least = np.minimum.reduceat(value, first, axis=0)
        better = least < best[own]
        local = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        at, sample = np.nonzero((value == least[local]) & better[local])
        best[own] = np.where(better, least, best[own])
        with np.errstate(over="ignore"):
            drawn = shingles[at] + level[at, sample].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out[rows[at], sample] = _text.mix(drawn + sample.astype(np.uint64), 9)


def _docs_of(column: pa.Array, shingler: Shingler):
    for first, n, keys, rows, shingles, counts in shingler.chunks(column):
        yield first, n, keys, rows, shingles, counts


def _frequent(docs: DataFrame, text: str, floor: float) -> tuple[Weights, int]:
    """Document frequencies of all shingles in at least the share ``floor`` of the documents with words.

    There are at most mean length / floor of them, whatever the number of documents.
    """
    spark = docs.sparkSession
    column = docs.select(text)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, n = Shingler(), [], 0, 0

        def group():
            values, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"shingle": values[df >= max(1.0, floor * n)].view(np.int64), "docs": pa.nulls(int((df >= max(1.0, floor * n)).sum()), pa.int64())})

        total = 0
        for batch in batches:
            for _, _, _, rows, shingles, _ in _docs_of(batch.column(0), shingler):
                held.append(shingles)
                size += len(shingles)
                here = int((np.diff(rows, prepend=-1) > 0).sum())
                n += here
                total += here
                if size > GROUP_SHINGLES:
                    yield group()
                    held, size, n = [], 0, 0
        if held:
            yield group()
        yield pa.RecordBatch.from_pydict({"shingle": pa.array([None], pa.int64()), "docs": pa.array([total], pa.int64())})

    found = stage(column.mapInArrow(lean(named), "shingle bigint, docs bigint").groupBy("shingle").agg(F.sum("docs").alias("docs")), "shingle-candidates")
    n_docs = found.where("shingle IS NULL").agg(F.sum("docs")).first()[0] or 0
    candidates = found.where("shingle IS NOT NULL").select("shingle")
    few = candidates.count() <= BROADCAST_CANDIDATES
    known = spark.sparkContext.broadcast(np.sort(candidates.toArrow()["shingle"].to_numpy().view(np.uint64)) if few else None)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted = Shingler(), known.value
        totals = None if wanted is None else np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, _, _, shingles, _ in _docs_of(batch.column(0), shingler):
                if wanted is None:
                    values, df = np.unique(shingles, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"shingle": values.view(np.int64), "df": df.astype(np.int64)})
                elif len(wanted):
                    at = np.minimum(np.searchsorted(wanted, shingles), len(wanted) - 1)
                    totals += np.bincount(at[wanted[at] == shingles], minlength=len(wanted))
        if totals is not None:
            seen = np.flatnonzero(totals)
            yield pa.RecordBatch.from_pydict({"shingle": wanted[seen].view(np.int64), "df": totals[seen]})

    counts = column.mapInArrow(lean(counted), "shingle bigint, df bigint")
    if not few:
        counts = counts.join(candidates, "shingle", "left_semi")
    frequent = counts.groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= F.lit(floor * n_docs)).toArrow()
    known.destroy()
    return Weights(frequent["shingle"].to_numpy().view(np.uint64), frequent["df"].to_numpy(), n_docs, floor), n_docs


def _keys(keys: np.ndarray, words: np.ndarray) -> list[bytes | None]:
    return [k.tobytes() if w else None for k, w in zip(keys, words, strict=True)]


def _signed(docs: DataFrame, doc_id: str, text: str, weights) -> DataFrame:
    """(doc_id, node, bands, samples) of every document; null node without words."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, known = Shingler(), Sampler(BANDS * ROWS), weights.value
        for batch in batches:
            for first, n, keys, rows, shingles, counts in _docs_of(batch.column(1), shingler):
                drawn = sampler.sign(rows, shingles, known.of(shingles, counts), n)
                bands = drawn.reshape(n, BANDS, ROWS)
                key = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    key = _text.mix(key ^ bands[:, :, k], 21 + k)
                key ^= _text.mix(np.arange(BANDS, dtype=np.uint64), 31)[None]
                words = np.bincount(rows, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(_keys(keys, words), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(key.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in drawn.astype("<u2")], pa.binary()),
                    ],
                    names=["doc_id", "node", "bands", "samples"],
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, node binary, bands array<bigint>, samples binary")


def _contents(docs: DataFrame, weights) -> DataFrame:
    """(node, content): ascending shingles, then their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(), weights.value
        for batch in batches:
            for _, n, keys, rows, shingles, counts in _docs_of(batch.column(0), shingler):
                weight = known.of(shingles, counts)
                words = np.bincount(rows, minlength=n)
                ends = np.cumsum(words)
                packed = [shingles[e - w : e].tobytes() + weight[e - w : e].tobytes() for w, e in zip(words, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(keys, words), pa.binary()), pa.array(packed, pa.binary())], names=["node", "content"])

    return docs.select("text").mapInArrow(lean(run), "node binary, content binary").where("node IS NOT NULL")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the least over sum of the greatest weights of two contents."""
    n, m = len(a) // 12, len(b) // 12
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    u, v = np.frombuffer(a, np.float32, n, n * 8).astype(float), np.frombuffer(b, np.float32, m, m * 8).astype(float)
    at = np.searchsorted(y, x)
    hit = np.flatnonzero(at < m)
    hit = hit[y[at[hit]] == x[hit]]
    common = np.minimum(u[hit], v[at[hit]]).sum()
    return common / (u.sum() + v.sum() - common)


def _verified(pairs: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """Of (a, b), those whose contents are at least so similar."""
    left = contents.select(F.col("node").alias("a"), F.col("content").alias("_x"))
    right = contents.select(F.col("node").alias("b"), F.col("content").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            near = [weighted_jaccard(p.as_py(), q.as_py()) >= similarity - 1e-9 for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(lean(run), "a binary, b binary")


def _agreeing(a: str, b: str) -> F.Column:
    """Places in which two packed signatures agree."""
    size = BANDS * ROWS
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)),
        F.lit(0),
        lambda n, i: n + F.when(F.substring(F.col(a), i * 2 + 1, 2) == F.substring(F.col(b), i * 2 + 1, 2), F.lit(1)).otherwise(F.lit(0)),
    )


def _small(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes of different components in a small bucket, with AGREEING samples or more."""
    rows = rest.where(F.col("n") <= SMALL_BUCKET).join(nodes.select("node", "samples"), "node")
    x = rows.select("band", F.col("node").alias("a"), F.col("component").alias("_ca"), F.col("samples").alias("_sa"))
    y = rows.select("band", F.col("node").alias("b"), F.col("component").alias("_cb"), F.col("samples").alias("_sb"))
    return x.join(y, (x["band"] == y["band"]) & (x["_ca"] < y["_cb"]) & (_agreeing("_sa", "_sb") >= AGREEING)).select("a", "b").distinct()


def _large(rest: DataFrame, nodes: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components within large buckets.

    A node's home is its largest bucket; the nodes of a home are cut into blocks by hash, those of its commonest component apart. Two blocks meet
    once, if they share a bucket and are not of the same one component.
    """
    rows = rest.where(F.col("n") > SMALL_BUCKET)
    homes = rows.groupBy("node").agg(F.max(F.struct("n", "band"))["band"].alias("home"), F.first("component").alias("component"))
    homes = stage(homes.join(contents.select("node", F.octet_length("content").alias("size")), "node"), "neardup-homes")
    common = homes.groupBy("home", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("home").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    parted = homes.join(common, "home").withColumn("whole", F.when(F.col("component") == F.col("main"), F.col("main")))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("size") / BLOCK_BYTES))
    counts = parted.groupBy(F.col("home").alias("_home"), F.col("whole").alias("_whole")).agg(blocks.alias("blocks"))
    numbered = parted.join(counts, (F.col("home") == F.col("_home")) & F.col("whole").eqNullSafe(F.col("_whole")))
    number = F.xxhash64("home", F.coalesce("whole", F.lit(b"")), F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocked = numbered.select("node", "component", "whole", number.alias("block"))
    blocked = stage(blocked, "neardup-blocked")
    # a block of one component has its name, a mixed one none; only different names, or none, meet: blocks of one component never pair up, however many there are
    in_band = rows.select("band", "node").join(blocked.select("node", "block", F.coalesce("whole", F.lit(b"")).alias("whole")), "node").select("band", "block", "whole").distinct()
    in_band = stage(in_band, "neardup-in-band")
    names = in_band.select("band", "whole").distinct()
    other = names.select("band", F.col("whole").alias("_wq"))
    named = names.select("band", F.col("whole").alias("_wp")).join(other, "band").where((F.col("_wp") != F.col("_wq")) | (F.col("_wp") == F.lit(b"")))
    p = in_band.select("band", F.col("block").alias("p"), F.col("whole").alias("_wp"))
    q = in_band.select("band", F.col("block").alias("q"), F.col("whole").alias("_wq"))
    meeting = named.join(p, ["band", "_wp"]).join(q, ["band", "_wq"]).where(F.col("p") <= F.col("q")).select("p", "q").distinct()
    full = blocked.join(nodes.select("node", "samples"), "node").join(contents, "node")
    packs = stage(full.groupBy("block").agg(F.collect_list(F.struct("node", "component", "samples", "content")).alias("rows")), "neardup-blocks")
    met = meeting.join(packs.select(F.col("block").alias("p"), F.col("rows").alias("x")), "p").join(packs.select(F.col("block").alias("q"), F.col("rows").alias("y")), "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, x, y in zip(*batch.columns, strict=True):
                yield _joining(x.as_py(), None if p == q else y.as_py(), similarity)

    return met.select("p", "q", "x", "y").mapInArrow(lean(run), "a binary, b binary")


def _joining(x: list[dict], y: list[dict] | None, similarity: float) -> pa.RecordBatch:
    """Links between components of one block or two, most agreeing samples first; pairs that earlier links join are left out."""
    own = y is None
    y = x if own else y
    left, right = (np.stack([np.frombuffer(r["samples"], np.uint16) for r in rows]) for rows in (x, y))
    names = {c: i for i, c in enumerate({r["component"] for r in [*x, *y]})}
    joined = list(range(len(names)))

    def root(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    cx, cy = (np.array([names[r["component"]] for r in rows]) for rows in (x, y))
    agree = np.zeros((len(x), len(y)), np.int16)
    share = np.zeros((len(x), len(y)), bool)
    for band in range(0, left.shape[1], ROWS):
        same = [left[:, k, None] == right[None, :, k] for k in range(band, band + ROWS)]
        share |= np.logical_and.reduce(same)
        agree += sum(s.astype(np.int8) for s in same)
    near = (agree >= AGREEING) & share & (cx[:, None] != cy[None])
    i, j = np.nonzero(np.triu(near, 1) if own else near)
    links = []
    for k in np.argsort(-agree[i, j], kind="stable"):
        a, b = root(cx[i[k]]), root(cy[j[k]])
        if a != b and weighted_jaccard(x[i[k]]["content"], y[j[k]]["content"]) >= similarity - 1e-9:
            joined[a] = b
            links.append((x[i[k]]["node"], y[j[k]]["node"]))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])


def _linked(docs: DataFrame, doc_id: str, text: str, similarity: float, floor: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all documents, and (node, class_id, class_key, class_size) of all nodes."""
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(_frequent(docs, text, floor)[0])
    signed = stage(_signed(docs, doc_id, text, weights), "neardup-signed")
    nodes = stage(
        signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("samples").alias("samples")),
        "neardup-nodes",
    )
    members = nodes.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(members.join(shared, "band"), "neardup-buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    pivots = buckets.join(central, "node").groupBy("band").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    pairs = stage(buckets.join(pivots, "band").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "neardup-pairs")

    wanted = buckets.select("node").distinct().join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_rep"]), "left_semi")
    contents = stage(_contents(texts, weights).groupBy("node").agg(F.first("content").alias("content")), "neardup-contents")

    weights.destroy()  # what was made with them is staged

    links = stage(_verified(pairs, contents, similarity), "neardup-links")
    found = components(links)
    # what the pivots leave: buckets with nodes of different components
    placed = buckets.join(found, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("band")
    rest = stage(placed.join(mixed, "band"), "neardup-rest")
    more = stage(_small(rest, nodes), "neardup-more")
    extra = _verified(more, contents, similarity).unionByName(_large(rest, nodes, contents, similarity))
    extra = stage(extra, "neardup-links")
    if extra.limit(1).count():
        found = components(links.unionByName(extra))

    linked = nodes.select("node", F.struct(F.col("rep").isNull().alias("none"), "rep", "node").alias("name"), "copies").join(found, "node", "left")
    grouped = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("name").alias("least"), F.sum("copies").alias("class_size"))
    in_class = linked.where("component IS NOT NULL").join(grouped, "component").select("node", F.col("least.rep").alias("class_id"), F.hex("least.node").alias("class_key"), "class_size", (F.col("least.node") == F.col("node")).alias("names"))
    alone = linked.where("component IS NULL").select("node", F.col("name.rep").alias("class_id"), F.hex("node").alias("class_key"), F.col("copies").alias("class_size"), F.lit(True).alias("names"))
    return signed.select("doc_id", "node"), stage(in_class.unionByName(alone), "neardup-classes")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, floor: float = FLOOR) -> DataFrame:
    """One row for each document: doc_id, class_id, class_key (null for a text without words, alone in its class), class_size (documents of the class), kept (it names its class)."""
    signed, named = _linked(docs, doc_id, text, similarity, floor)
    some = signed.where("node IS NOT NULL").join(named, "node").select("doc_id", "class_id", "class_key", "class_size", (F.col("names") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
    none = signed.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("class_key"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with _node, the key of the word sequence."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first, n, keys, rows, _, _ in _docs_of(batch.column(at), shingler):
                part = batch.slice(first, n)
                node = pa.array(_keys(keys, np.bincount(rows, minlength=n)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, node], names=[*part.schema.names, "_node"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("_node", T.BinaryType())]))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, floor: float = FLOOR) -> DataFrame:
    """docs without all but one document of each class: the one that names it. Texts without words stay."""
    docs, restore = guarded(docs, {"doc_id": doc_id, "text": text})
    doc_id, text = "doc_id", "text"
    signed, named = _linked(docs, doc_id, text, similarity, floor)
    keep = stage(named.where("names").select(F.col("node").alias("_kept"), F.col("class_id").alias("_class")), "neardup-kept")
    keyed = _keyed(docs, text)
    rows = keyed.where("_node IS NOT NULL").join(keep, (F.col("_node") == F.col("_kept")) & F.col(doc_id).eqNullSafe(F.col("_class")), "left_semi")
    ids = signed.where("node IS NOT NULL").join(keep, (F.col("node") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_class")), "left_semi")
    again = stage(ids.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("_again")), "neardup-again")
    if again.limit(1).count():  # the naming document is there more than once
        once = rows.join(again, F.col("_node") == F.col("_again"), "left_anti")
        rows = once.unionByName(rows.join(again, F.col("_node") == F.col("_again"), "left_semi").dropDuplicates(["_node"]))
    return rows.unionByName(keyed.where("_node IS NULL")).transform(lambda x: restore(x, []))
