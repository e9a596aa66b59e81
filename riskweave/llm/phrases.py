"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at sentence signs and line ends, and pieces into words. Edges are grams of five words, each from the node of its first four words to that of its last four; they are
aggregated with their counts, as are the shorter grams with which a piece ends. Counts of shorter phrases are not taken from the text again: a node's flow, the sum of the
edges that leave it, and the piece ends that stop there give the count of its four words; summed over last words, and with the ends of three words, these give the counts of three words, and so on.
Where a node has one edge in and one out, all occurrences go through both, no piece begins or ends there, and the two edges and the node have one count: such edges are compacted into paths, by pointer doubling in
rounds of joins. All shorter phrases inside a path that have its count stand only within longer ones, so paths say which candidates are dropped.

Before, two passes over the texts count, by a hash with the language, all words and pairs of words, then the longer grams of which these are frequent, in sketches of 2^28 counters each; where a counter stays below the support,
no gram that it counts can be in a candidate, so grams end there as at a piece's end. This leaves all counts of candidates and of their parts exact, whatever collides. A sketch has one size for all inputs: its summary
of 32 MB is broadcast. Beyond about 10^10 pairs most counters reach the support, and grams are cut short less often; results stay the same, but more of them are shuffled.

Defined results: null texts have no pieces; the null language is ``und``; texts of any length are read whole; repeated rows each count; equal scores are ranked by count, then phrase in byte order; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import collections
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import _text
from riskweave.llm._memory import lean, release
from riskweave.session import stage, unstage

LONGEST, SUPPORT, MOST = 5, 100, 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a counter's number; its upper 12 name a slice of the sketch, the lower 16 a counter in it.
SKETCH_BITS, SLICE_BITS = 28, 12
GRAM_SLICES = 1024
#: Hashes, grams and bytes of grams that a task holds before it passes their counts on, and bytes of text handled at once.
HELD_HASHES, HELD_GRAMS, HELD_BYTES, TEXT_BYTES = 1 << 22, 1 << 18, 1 << 25, 1 << 22

_WORDS = _text.WordTable(b" \t" + BREAKS)
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Words:
    """Words of the texts of a chunk: hash (with the language), start and end byte, and how many of the next words follow it in its piece (4 at most)."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, salt: np.ndarray):
        self.body = body
        self.hash, self.row, self.start, self.end = _WORDS.words(body, offsets)
        with np.errstate(over="ignore"):
            self.hash = _text.mix(self.hash ^ salt[self.row], 1)
        n = len(self.hash)
        self.joined = np.zeros(n, bool)  # whether the next word is of the same piece
        if n > 1:
            breaks = np.concatenate([[0], np.cumsum(_BREAK[body], dtype=np.int64)])
            self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[self.start[1:]] == breaks[self.end[:-1]])

    def pairs(self) -> np.ndarray:
        """Hashes of each joined word and the next, in order."""
        at = np.flatnonzero(self.joined)
        with np.errstate(over="ignore"):
            return _text.mix(self.hash[at] * np.uint64(3) + _text.mix(self.hash[at + 1], 2), 3)


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    table = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()], np.uint64)
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.zeros(0, np.uint64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[_Words, int]]:
    """Words of chunks of a batch of (lang, text), and the number of the chunk's first row."""
    body, offsets = _text.utf8_parts(batch.column(1))
    salt = _salts(batch.column(0))
    for i, j in _text.chunks(offsets, TEXT_BYTES):
        yield _Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], salt[i:j]), i


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32)


def _often(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _counters(hashes)
    return (sketch[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _runs(w: _Words, sketch: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size from 1: places where a gram of that size begins whose words and pairs are all frequent, and a hash of each; the first sketch tells."""
    alone = _often(sketch, w.hash)
    on = np.zeros(len(alone) + longest, bool)
    at = np.flatnonzero(w.joined)
    on[at] = _often(sketch, w.pairs()) & alone[at] & alone[at + 1]
    name, goes_on = _text.mix(w.hash, 11), alone.copy()
    yield np.flatnonzero(alone), name[alone]
    for step in range(1, longest):
        goes_on &= on[step - 1 : step - 1 + len(alone)]
        there = np.flatnonzero(goes_on)
        with np.errstate(over="ignore"):
            name[there] += _text.mix(w.hash[there + step], 11 + step)
        yield there, _text.mix(name[there], step)


def frequent(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, pairs=None) -> np.ndarray:
    """Bits, one for each counter of the sketch, that say whether it reaches the support: of words and pairs, or, given a broadcast of these, of longer grams whose
    words and pairs are all frequent. docs has (lang, text).

    A task passes on, for each slice, the counters that it met and their counts (255 at most, which is above the support or adds up to it), in three bytes each; slices are summed where they meet, one after another.
    """
    low = SKETCH_BITS - SLICE_BITS

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            numbers, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(numbers >> low, np.arange((1 << SLICE_BITS) + 1))
            slices = np.flatnonzero(np.diff(cuts))
            counts = np.minimum(counts, 255).astype(np.uint8)
            lows = (numbers & ((1 << low) - 1)).astype("<u2")
            parts = [(lows[cuts[s] : cuts[s + 1]].tobytes(), counts[cuts[s] : cuts[s + 1]].tobytes()) for s in slices]
            return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["slice", "numbers", "counts"])

        for batch in batches:
            for words, _ in _chunks(batch):
                found = [words.hash, words.pairs()] if pairs is None else [names for size_of, (_, names) in enumerate(_runs(words, pairs.value, longest), 1) if size_of > 2]
                held += [_counters(x) for x in found]
                size += sum(map(len, found))
                if size >= HELD_HASHES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(1 << low, np.uint64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(total >= support, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for s, numbers, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if s != current:
                    if current is not None and (total >= support).any():
                        yield bits()
                    current = s
                    total[:] = 0
                total[np.frombuffer(numbers.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), np.uint8)
        if current is not None and (total >= support).any():
            yield bits()

    if support > 255:
        raise ValueError("counts in the sketch end at 255")
    slices = docs.mapInArrow(lean(met), "slice int, numbers binary, counts binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(1 << (SKETCH_BITS - 3), np.uint8)
    width = 1 << (low - 3)
    for r in slices.mapInArrow(lean(summed), "slice int, bits binary").toLocalIterator():  # the sketch's 32 MB at most
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def grams(docs: DataFrame, pairs, longer, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, size, c): for each place of a word the gram from there to the ``longest``-th word, the piece's end, or where it would become rare; counted.

    Grams of ``longest`` words are edges, shorter ones piece ends. ``pairs`` and ``longer`` are broadcasts of :func:`frequent`. A task packs the grams that it has counted by slices of a hash, a row
    for each slice; where a slice's rows meet, one after another, their counts are summed, so what is held are the different grams of one slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        weight = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held, key=lambda k: zlib.crc32(k[1]) % GRAM_SLICES)
            slices = np.array([zlib.crc32(k[1]) % GRAM_SLICES for k in keys], np.int32)
            cuts = np.flatnonzero(np.diff(slices, prepend=-1)).astype(np.int32)
            ends = pa.array(np.append(cuts, np.int32(len(keys))), pa.int32())
            packed = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()), pa.array([held[k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(slices[cuts]), *[pa.ListArray.from_arrays(ends, x) for x in packed]], names=["slice", "langs", "grams", "counts"])

        for batch in batches:
            langs = batch.column(0)
            for w, first in _chunks(batch):
                size, name = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.uint64)
                for length, (there, names) in enumerate(_runs(w, pairs.value, longest), 1):
                    on = size[there] == length - 1
                    if length > 2:
                        on &= _often(longer.value, names)
                    size[there[on]], name[there[on]] = length, names[on]
                places = np.flatnonzero(size)
                _, one, counts = np.unique(name[places], return_index=True, return_counts=True)
                one = places[one]
                begin, end = w.start[one], w.end[one + size[one] - 1]
                body = w.body.tobytes().translate(_LOWER)
                names = langs.take(pa.array(w.row[one] + first)).to_pylist()
                for lang, a, b, c in zip(names, begin.tolist(), end.tolist(), counts.tolist()):
                    key = lang, b" ".join(body[a:b].split())
                    held[key] = held.get(key, 0) + c
                weight += int((end - begin).sum())
                if len(held) >= HELD_GRAMS or weight >= HELD_BYTES:
                    yield flush()
                    held.clear()
                    weight = 0
        if held:
            yield flush()
        held.clear()
        release()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, collections.Counter()

        def done() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[1].count(" ") + 1 for k in keys], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "size", "c"])

        for batch in batches:
            for s, langs, found, counts in zip(*[batch.column(i) for i in range(4)]):
                if s != current:
                    if total:
                        yield done()
                    current = s
                    total.clear()
                for key, c in zip(zip(langs.values.to_pylist(), found.values.to_pylist()), counts.values.to_pylist()):
                    total[key] += c
        if total:
            yield done()

    packed = docs.mapInArrow(run, "slice int, langs array<string>, grams array<string>, counts array<bigint>")
    return packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(lean(summed), "lang string, gram string, size int, c bigint")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for w, first in _chunks(batch):
                counts += np.bincount(w.row + first, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=["lang", "n"])

    return docs.mapInArrow(lean(run), "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def flows(counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, size, f): counts of phrases of 1 to ``longest`` words from the counts of grams, longest first: flow out of a node plus the pieces that end there."""
    level = counted.where(F.col("size") == longest).select("lang", "gram", F.col("c").alias("f"))
    out = level.withColumn("size", F.lit(longest))
    for size in range(longest - 1, 0, -1):
        ends = counted.where(F.col("size") == size).select("lang", "gram", F.col("c").alias("f"))
        level = stage(level.withColumn("gram", F.substring_index("gram", " ", size)).unionByName(ends).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"phrase-flow-{size}")
        out = out.unionByName(level.withColumn("size", F.lit(size)))
    return out.select("lang", "gram", "size", "f")


def paths(counts: DataFrame, longest: int = LONGEST, support: int = SUPPORT) -> DataFrame:
    """(lang, path, words, f): edges that reach the support, compacted along unary nodes. counts is that of :func:`flows`.

    Each edge points to the one before it in its path; pointers double in rounds, until no more edges find their path's head. Edges that never do lie on cycles and are paths of their own.
    """
    edges = counts.where((F.col("size") == longest) & (F.col("f") >= support)).select("lang", "gram", "f")
    nodes = counts.where((F.col("size") == longest - 1) & (F.col("f") >= support)).select("lang", F.col("gram").alias("node"), F.col("f").alias("flow"))
    last = F.substring_index("gram", " ", 1 - longest)
    before = edges.select("lang", F.col("gram").alias("_from"), last.alias("node"), "f")
    unary = before.join(nodes, ["lang", "node"]).where("f = flow").select("lang", "_from", "node", "f")
    linked = edges.withColumn("node", F.substring_index("gram", " ", longest - 1)).join(unary, ["lang", "node", "f"], "left")
    state = stage(linked.select("lang", "gram", "f", F.coalesce("_from", "gram").alias("head"), F.col("_from").isNotNull().cast("int").alias("steps"), F.col("_from").isNull().alias("done")), "phrase-paths")
    waiting = state.where("NOT done").count()
    while waiting:
        ahead = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = state.join(ahead, ["lang", "head"]).select("lang", "gram", "f", F.when(F.col("done"), F.col("head")).otherwise(F.col("_head")).alias("head"), F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("_steps")).alias("steps"), (F.col("done") | F.col("_done")).alias("done"))
        old, state = state, stage(moved, "phrase-paths")
        unstage(old)
        left = state.where("NOT done").count()
        if left == waiting:
            break
        waiting = left
    placed = state.withColumns({"head": F.when(F.col("done"), F.col("head")).otherwise(F.col("gram")), "steps": F.when(F.col("done"), F.col("steps")).otherwise(0)})
    word = F.struct("steps", F.substring_index("gram", " ", -1).alias("word"))
    added = F.concat_ws(" ", F.substring_index("head", " ", longest - 1), F.transform(F.array_sort(F.collect_list(word)), lambda x: x["word"]))
    return placed.groupBy("lang", "head", "f").agg(added.alias("path")).select("lang", "path", (F.size(F.split("path", " "))).alias("words"), "f")


def _inner(rows: DataFrame, gram: str, sizes: list[int], count: str) -> DataFrame:
    """(lang, gram, within): phrases of the given sizes inside each row's words, with the row's count."""

    def windows(size: int) -> Column:  # rows have more words than each size
        return F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: F.array_join(F.slice("_w", i, size), " "))

    parts = [windows(size) for size in sizes]
    return rows.withColumn("_w", F.split(gram, " ")).select("lang", F.explode(F.array_distinct(F.concat(*parts))).alias("gram"), F.col(count).alias("within"))


def collocations(docs: DataFrame, longest: int = LONGEST, support: int = SUPPORT, most: int = MOST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language: of its cuts in two the least of floor(1000 a n / (l r)) is a phrase's score."""
    work = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    context = docs.sparkSession.sparkContext
    pairs = context.broadcast(frequent(work, support, longest))
    longer = context.broadcast(frequent(work, support, longest, pairs))
    counted = stage(grams(work, pairs, longer, longest), "phrase-edges")
    pairs.unpersist()
    longer.unpersist()
    counts = stage(flows(counted, longest).where(F.col("f") >= support), "phrase-counts")
    candidates = counts.where("size >= 2")
    compact = stage(paths(counts, longest, support), "phrase-compact")
    # within a path every shorter phrase stands in an edge of the path's count; the others stand in a phrase of one word more, if in any of their count
    holders = _inner(compact, "path", list(range(2, longest)), "f")
    for size in range(3, longest):
        holders = holders.unionByName(_inner(candidates.where(F.col("size") == size), "gram", [size - 1], "f"))
    most_within = holders.groupBy("lang", "gram").agg(F.max("within").alias("within"))
    kept = candidates.join(most_within, ["lang", "gram"], "left").where("within IS NULL OR 100 * within < 100 * f").select("lang", F.col("gram").alias("phrase"), "size", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumns({"_l": F.expr("substring_index(phrase, ' ', k)"), "_r": F.expr("substring_index(phrase, ' ', k - size)")})
    side = lambda name, count: counts.select("lang", F.col("gram").alias(name), F.col("f").alias(count))
    met = cuts.join(side("_l", "l"), ["lang", "_l"]).join(side("_r", "r"), ["lang", "_r"]).join(word_counts(work), "lang")
    whole = lambda *columns: "*".join(f"CAST({c} AS DECIMAL(19,0))" for c in columns)
    scored = met.withColumn("score", F.expr(f"({whole('1000 * a', 'n')}) div ({whole('l', 'r')})"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_c")).select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return lowest.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS size, w" + "".join(f" || ' ' || w{j}" for j in range(1, k)) + " AS gram FROM g" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, gram, size, f, {k} AS k, array_to_string(string_split(gram, ' ')[1:{k}], ' ') AS x, array_to_string(string_split(gram, ' ')[{k + 1}:], ' ') AS y FROM kept WHERE size > {k}" for k in range(1, LONGEST))

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece, generate_subscripts(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+'), 1) AS p FROM d),
w AS (SELECT id, lang, p, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS i FROM p),
g AS (SELECT lang, w, {', '.join(f'lead(w, {j}) OVER o AS w{j}' for j in range(1, LONGEST))} FROM w WINDOW o AS (PARTITION BY id, p ORDER BY i)),
f AS (SELECT lang, size, gram, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
kept AS (SELECT * FROM f s WHERE size >= 2 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = s.lang AND b.size > s.size AND 100 * b.f >= 100 * s.f AND contains(' ' || b.gram || ' ', ' ' || s.gram || ' '))),
c AS ({_CUTS}),
s AS (SELECT c.lang, c.gram, c.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.gram = x JOIN f r ON r.lang = c.lang AND r.gram = y JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) <= {MOST}
"""
