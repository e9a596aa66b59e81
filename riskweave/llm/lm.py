"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Tokens are the words between white space (A-Z as a-z) and one end per text. Training counts unigrams exactly and
bigrams (the end token also stands before the first word) by 64-bit hashes: tasks count groups of n-grams, split them by the hash's
leading bits into packed arrays, and merge each part; parts are small however large the corpus, as it sets the number of bits. Each part
keeps its unigram counts and a Bloom filter in which a bigram of level ``q = 1 + floor(log2(count))`` is entered q times, once for
each level up to its own. A reader probes levels 1, 2, ... until one is missing. Bigrams under ``min_count`` are not entered; all are by default.

A model of up to ``BROADCAST_BYTES`` is broadcast. A larger one stays in its parts: the distinct n-grams of chunks of documents are sent to the parts that
may hold them, and counts and levels are sent back to the chunks, so that nothing that grows with the corpus comes to the driver or into one task. Both ways probe
the same filters, so results are the same.

A token's probability is ``mixing * min(1, count(h, w) / count(h)) + (1 - mixing) * (count(w) + 1) / (N + V + 1)``.

Defined results: a null text counts as empty (one end token); rows with a null id count as id '' for the fold; with no
training rows N = V = 0; texts of any length are read whole; repeated rows count each time; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import _text
from riskweave.llm._columns import guarded
from riskweave.llm._memory import lean
from riskweave.session import stage

#: Bytes of text read at once, n-grams that a task counts together, bytes of text for each part, bytes of the largest broadcast model, bytes of text whose n-grams are looked up together.
CHUNK_BYTES = 1 << 19
GROUP_NGRAMS = 1_500_000
PART_BYTES = 4 << 20
BROADCAST_BYTES = 256 << 20
LOOKUP_BYTES = 4 << 20
#: Leading bits split at once, bits of the filter for each entry, probes for each level.
SPLIT_BITS = 12
BITS_PER_ENTRY = 12
PROBES = 4
MIXING = 0.4
MIN_COUNT = 1
END = np.uint64(0x5EED0E4DC0FFEE11)

_PACKED = "ngram int, part bigint, hashes binary, counts binary"


class Tokens:
    """Token hashes of the texts of an Arrow column, ends included, a chunk at a time."""

    def __init__(self):
        self.table = _text.WordTable(_text.SPACES)

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, tokens, tokens of each row)."""
        body, offsets = _text.utf8_parts(column)
        for i, j in _text.chunks(offsets, CHUNK_BYTES):
            hashes, rows, _, _ = self.table.words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            count = np.bincount(rows, minlength=j - i) + 1
            ends = np.cumsum(count) - 1
            out = np.full(int(count.sum()), END, np.uint64)
            inner = np.ones(len(out), bool)
            inner[ends] = False
            out[inner] = hashes
            yield i, j - i, out, count


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before; a text's first follows the end of the text before it in the chunk."""
    before = np.concatenate([[END], tokens[:-1]])
    with np.errstate(over="ignore"):
        return _text.mix(before * np.uint64(0x9E3779B97F4A7C15) ^ tokens, 41)


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    whole, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(whole, kind="stable")
    whole, n = whole[order], n[order]
    first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
    return whole[first], np.add.reduceat(n, first) if len(first) else n


def _split(ngram: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of ascending hashes by their leading bits."""
    parts = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    first = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
    for a, b in zip(first, [*first[1:], len(parts)]):
        yield ngram, int(parts[a]), hashes[a:b].tobytes(), counts[a:b].tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], names=["ngram", "part", "hashes", "counts"])


def _counted(texts: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, size = Tokens(), {1: [], 2: []}, 0

        def out():
            for ngram, arrays in held.items():
                values, counts = np.unique(np.concatenate(arrays), return_counts=True)
                yield _rows(list(_split(ngram, values, counts.astype(np.uint32), bits)))  # a group's counts are small
                arrays.clear()

        for batch in batches:
            for _, _, found, _ in tokens.chunks(batch.column(0)):
                held[1].append(found)
                held[2].append(bigrams(found))
                size += len(found)
                if size > GROUP_NGRAMS:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    return texts.mapInArrow(lean(run), _PACKED)


def _regrouped(packed: DataFrame, finish=None, bits: int = 0, schema: str = _PACKED) -> DataFrame:
    """Merges the rows of each part and splits the result by ``bits`` leading bits, or hands the whole part to ``finish``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashes, counts, size = None, [], [], 0

        def out():
            merged = _merged(hashes, counts)
            yield finish(*key, *merged) if finish else _rows(list(_split(key[0], *merged, bits)))

        for batch in batches:
            for ngram, part, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key is not None and (key != (ngram, part) or not finish and size > GROUP_NGRAMS):
                    yield from out()
                    hashes, counts, size = [], [], 0
                key = ngram, part
                hashes.append(np.frombuffer(h, np.uint64))
                counts.append(np.frombuffer(c, np.uint32 if 2 * len(c) == len(h) else np.int64).astype(np.int64))
                size += len(hashes[-1])
        if key is not None:
            yield from out()

    return packed.repartition("ngram", "part").sortWithinPartitions("ngram", "part").mapInArrow(lean(run), schema)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0**levels - 1) / 2, 0.0)


def _places(hashes: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    return (_text.mix(hashes, 100 + level * PROBES + probe) % size).astype(np.int64)


def _part_model(min_count: int):
    """Of a merged part: unigrams stay as they are; bigrams become a Bloom filter of whole 64-bit words."""

    def finish(ngram: int, part: int, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        total, n = int(counts.sum()), len(hashes)
        if ngram == 2:
            frequent = counts >= min_count
            hashes, levels = hashes[frequent], levels_of(counts[frequent])
            words = -(-max(1, int(levels.sum())) * BITS_PER_ENTRY // 64)
            bits = np.zeros(words * 64, np.uint8)
            for level in range(1, int(levels.max(initial=0)) + 1):
                inside = hashes[levels >= level]
                for probe in range(PROBES):
                    bits[_places(inside, level, probe, np.uint64(words * 64))] = 1
            first, second = np.packbits(bits, bitorder="little").tobytes(), b""
        else:
            first, second = hashes.tobytes(), counts.tobytes()
        return pa.RecordBatch.from_pydict({"ngram": pa.array([ngram], pa.int32()), "part": [part], "first": pa.array([first], pa.binary()), "second": pa.array([second], pa.binary()), "n": [n], "total": [total]})

    return finish


class Packed(NamedTuple):
    """Parts end to end, so that a reader needs no copy: hashes of unigrams and their counts in a byte each (places and counts of those of 255 and more apart), filters of bigrams, and
    the filters' parts and bytes."""

    words: bytes | bytearray
    counts: bytes | bytearray
    large_at: bytes
    large: bytes
    filters: bytes | bytearray
    parts: list[int]
    sizes: list[int]


class Parts:
    """Unigram counts and Bloom filters of some parts, in a reader's process."""

    def __init__(self, packed: Packed, bits: int):
        self.words = np.frombuffer(packed.words, np.uint64)
        self.counts = np.frombuffer(packed.counts, np.uint8)
        self.large_at, self.large = np.frombuffer(packed.large_at, np.int64), np.frombuffer(packed.large, np.int64)
        self.parts = np.array(packed.parts, np.uint64)
        size = np.array(packed.sizes, np.int64)
        self.sizes = (size * 8).astype(np.uint64)
        self.starts = (np.cumsum(size) - size) * 8
        self.filter = np.frombuffer(packed.filters, np.uint8)
        self.bits = bits

    def unigrams(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of the tokens; 0 where they are unknown or in another part."""
        out = np.zeros(len(tokens), np.int64)
        if len(self.words):
            each, back = np.unique(tokens, return_inverse=True)
            at = np.minimum(np.searchsorted(self.words, each), len(self.words) - 1)
            found = np.where(self.words[at] == each, self.counts[at], 0).astype(np.int64)
            large = np.flatnonzero(found == 255)
            found[large] = self.large[np.searchsorted(self.large_at, at[large])]
            out = found[back]
        return out

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of the bigrams, probed until one is missing; 0 where they are unknown or in another part."""
        out = np.zeros(len(hashes), np.uint8)
        if not len(self.parts):
            return out
        part = hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.parts, part), len(self.parts) - 1)
        active = np.flatnonzero(self.parts[at] == part)
        for level in range(1, 64):
            for probe in range(PROBES):
                own = at[active]
                place = self.starts[own] + _places(hashes[active], level, probe, self.sizes[own])
                active = active[(self.filter[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
            if not len(active):
                return out
            out[active] = level
        return out


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds)) == fold


def train(texts: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """The model's parts as a staged table, and the number of leading bits that names a part."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, size) / PART_BYTES))))
    packed = _counted(texts, min(bits, SPLIT_BITS))
    for done in range(2 * SPLIT_BITS, bits + SPLIT_BITS, SPLIT_BITS):  # further leading bits of a large corpus
        packed = _regrouped(packed, bits=min(done, bits))
    kinds = "ngram int, part bigint, first binary, second binary, n bigint, total bigint"
    return stage(_regrouped(packed, _part_model(min_count), schema=kinds), "lm-parts"), bits


def _chunked(docs: DataFrame, text: str) -> DataFrame:
    """docs, staged, with _chunk: rows of about LOOKUP_BYTES of text share one."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = np.diff(_text.utf8_parts(batch.column(at))[1])
            upto = held + np.cumsum(size)
            number = chunk + np.maximum(upto - 1, 0) // LOOKUP_BYTES
            if len(number):
                chunk, held = int(number[-1]), int(upto[-1]) - int(number[-1] - chunk) * LOOKUP_BYTES
            yield batch.append_column("_chunk", pa.array(number, pa.int64()))

    return stage(docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("_chunk", T.LongType())])), "lm-chunks")


def _answers(chunked: DataFrame, text: str, model: DataFrame, bits: int) -> DataFrame:
    """(_chunk, ngram, hashes, values) of the distinct n-grams of each chunk, from the parts that they belong to; unknown ones are left out."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, at, held = Tokens(), None, {1: [], 2: []}

        def out():
            for ngram, arrays in held.items():
                whole = np.unique(np.concatenate(arrays))
                rows = list(_split(ngram, whole, np.zeros(len(whole), np.uint8), bits))
                arrays.clear()
                yield pa.RecordBatch.from_pydict({"ngram": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int64()), "chunk": pa.array([at] * len(rows), pa.int64()), "first": pa.array([r[2] for r in rows], pa.binary()), "second": pa.nulls(len(rows), pa.binary())})

        for batch in batches:
            number = batch.column(0).to_numpy()
            for first, n, found, count in tokens.chunks(batch.column(1)):
                of, twos = np.repeat(number[first : first + n], count), bigrams(found)
                cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
                for i, j in zip([0, *cuts], [*cuts, len(of)]):
                    if at is not None and at != int(of[i]):
                        yield from out()
                    at = int(of[i])
                    held[1].append(np.append(np.unique(found[i:j]), END))
                    held[2].append(twos[i:j])
        if at is not None:
            yield from out()

    asked = chunked.select("_chunk", text).mapInArrow(lean(asking), "ngram int, part bigint, chunk bigint, first binary, second binary")
    held = model.select("ngram", "part", F.lit(None).cast("bigint").alias("chunk"), "first", "second")

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["chunk"] is None:
                    ones = row["ngram"] == 1
                    at, known = (row["ngram"], row["part"]), Parts(Packed(row["first"], *_small(row["second"]), b"", [], []) if ones else Packed(b"", b"", b"", b"", row["first"], [row["part"]], [len(row["first"])]), bits)
                elif at == (row["ngram"], row["part"]):
                    hashes = np.frombuffer(row["first"], np.uint64)
                    values = known.unigrams(hashes) if row["ngram"] == 1 else known.levels(hashes)
                    some = values > 0
                    out.append((row["chunk"], row["ngram"], hashes[some].tobytes(), values[some].tobytes()))
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], names=["_chunk", "ngram", "hashes", "values"])

    both = held.unionByName(asked).repartition("ngram", "part").sortWithinPartitions("ngram", "part", F.col("chunk").asc_nulls_first())
    return both.mapInArrow(lean(answering), "_chunk bigint, ngram int, hashes binary, values binary")


class _Found:
    """Counts and levels of a chunk's n-grams, as answered."""

    def __init__(self, answers: list[tuple[int, bytes, bytes]]):
        self.known = {}
        for ngram in (1, 2):
            hashes = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for n, h, _ in answers if n == ngram)])
            values = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(v, np.int64 if n == 1 else np.uint8) for n, _, v in answers if n == ngram)])
            self.known[ngram] = np.unique(hashes, return_index=True), values

    def _of(self, ngram: int, hashes: np.ndarray) -> np.ndarray:
        (keys, first), values = self.known[ngram]
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[first[at]], 0)

    def unigrams(self, tokens: np.ndarray) -> np.ndarray:
        return self._of(1, tokens)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self._of(2, hashes)


_SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scorer(n_train: int, n_words: int, mixing: float):
    """A function of (column of texts, model) that gives (first row, rows, Arrow arrays of _SCORES) a chunk at a time."""

    def scored(column: pa.Array, known: Parts | _Found) -> Iterator[tuple[int, int, list[pa.Array]]]:
        end = known.unigrams(np.array([END]))
        for first, n, found, count in Tokens().chunks(column):
            c = known.unigrams(found)
            h = np.concatenate([end, c[:-1]])
            plain = (c + 1) / (n_train + n_words + 1)
            model_p = mixing * np.minimum(1.0, count_of(known.levels(bigrams(found)).astype(np.int64)) / np.maximum(h, 1)) + (1 - mixing) * plain
            begin = np.cumsum(count) - count
            sums = [np.add.reduceat(x, begin) for x in ((c > 0).astype(np.int64), np.log10(plain), np.log10(model_p))]
            yield first, n, [pa.array(x) for x in (count.astype(np.int64), sums[0], np.full(len(count), n_train, np.int64), sums[1], sums[2])]

    return scored


def _small(counts: bytes) -> tuple[bytes, bytes, bytes]:
    """Counts (64 bits each) in a byte each, at most 255, and the places and counts of those of 255 and more."""
    n = np.frombuffer(counts, np.int64)
    large = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes(), n[large].tobytes()


def _packed(model: DataFrame) -> Packed:
    """The whole model on the driver, fetched a partition at a time into place; its size is checked before."""
    sizes = model.select("ngram", "part", F.octet_length("first").alias("n")).orderBy("ngram", "part").collect()  # a row for each part
    ends = {1: 0, 2: 0}
    at = {}
    for r in sizes:
        at[r["ngram"], r["part"]] = ends[r["ngram"]]
        ends[r["ngram"]] += r["n"]
    twos = [r for r in sizes if r["ngram"] == 2]
    words, counts, filters, large = bytearray(ends[1]), bytearray(ends[1] // 8), bytearray(ends[2]), []
    for r in model.select("ngram", "part", "first", "second").toLocalIterator():
        i = at[r["ngram"], r["part"]]
        if r["ngram"] == 1:
            words[i : i + len(r["first"])] = r["first"]
            small, places, values = _small(r["second"])
            counts[i // 8 : i // 8 + len(small)] = small
            large.append((i // 8, np.frombuffer(places, np.int64) + i // 8, values))
        else:
            filters[i : i + len(r["first"])] = r["first"]
    large.sort(key=lambda x: x[0])
    return Packed(words, counts, b"".join(x[1].tobytes() for x in large), b"".join(x[2] for x in large), filters, [r["part"] for r in twos], [r["n"] for r in twos])


def _with_broadcast(docs: DataFrame, text: str, model: DataFrame, bits: int, scored) -> DataFrame:
    at = docs.columns.index(text)
    value = docs.sparkSession.sparkContext.broadcast((_packed(model), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Parts(*value.value)
        for batch in batches:
            for first, n, made in scored(batch.column(at), known):
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *_NAMES])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_SCORES).fields]))


def _with_lookups(docs: DataFrame, text: str, model: DataFrame, bits: int, scored) -> DataFrame:
    """Answers and documents meet by chunk: a task holds the answers of one chunk at a time."""
    chunked = _chunked(docs, text)
    answers = _answers(chunked, text, model, bits)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]
    rows = chunked.select("_chunk", F.lit(0).alias("ngram"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("values"), *docs.columns)
    both = answers.select("_chunk", "ngram", "hashes", "values", *nothing).unionByName(rows)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], None
        for batch in batches:
            chunk, ngram = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | ((ngram[1:] == 0) != (ngram[:-1] == 0))) + 1
            for i, j in zip([0, *cuts], [*cuts, len(chunk)]):
                if i == j:
                    continue
                if at != chunk[i]:
                    at, held, known = chunk[i], [], None
                part = batch.slice(i, j - i)
                if ngram[i]:
                    held += zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))
                    continue
                if known is None:
                    known, held = _Found(held), []
                texts = part.select(columns)
                for first, n, made in scored(texts.column(columns.index(text)), known):
                    some = texts.slice(first, n)
                    yield pa.RecordBatch.from_arrays([*some.columns, *made], names=[*columns, *_NAMES])

    met = both.repartition("_chunk").sortWithinPartitions("_chunk", F.desc("ngram"))
    return met.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_SCORES).fields]))


_NAMES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, min_count: int = MIN_COUNT, mixing: float = MIXING) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score (unigrams alone) and score; trained on the rows outside the fold."""
    docs, restore = guarded(docs, {"_doc": doc_id, "text": text})
    model, bits = train(docs.where(~held_out("_doc", folds, fold)).select("text"), min_count)
    sums = model.agg(F.sum(F.when(F.col("ngram") == 1, F.col("total"))), F.sum(F.when(F.col("ngram") == 1, F.col("n"))), F.sum(F.octet_length("first") + F.octet_length("second"))).first()
    n_train, n_words, size = (x or 0 for x in sums)
    way = _with_broadcast if size <= BROADCAST_BYTES else _with_lookups
    out = way(docs, "text", model, bits, _scorer(n_train, n_words, mixing))
    return restore(out.withColumn("held_out", held_out("_doc", folds, fold)), ["held_out", *_NAMES])
