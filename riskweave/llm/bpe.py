"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (base64 token, rank) becomes a ``tokenizers`` BPE model: every byte is written as one printable
character (the byte-to-character table), every token of several bytes becomes the merges that make it, and a
word that is a token as a whole is taken at once. Decoding reverses the character table; characters whose bytes are split over tokens
come together again because bytes are joined before they are read as UTF-8.

Defined results: a null text counts as empty (no ids, empty bytes); ids that are null, or of which one is, decode to null; an id
outside the vocabulary raises ValueError; rows keep all their other columns, but a result replaces a column of its name; repeated rows and empty tables stay. Long texts are cut
only where white space follows another character, where no match of the pattern can span.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm._columns import without
from riskweave.llm._memory import lean

#: Characters split into words at once, and bytes of the words kept encoded in a process (with WORD_BYTES for what Python adds to each); both bound memory only.
CHUNK_CHARS = 1 << 20
KEPT_BYTES = 32 << 20
WORD_BYTES = 200
_MODELS: dict[tuple[str, str], BytePairCodec] = {}


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every way to make a token from two tokens, by the rank of the result.

    Where two ways of one token can overlap (p q r with pq = qr), the left one goes first, as
    the leftmost pair of the least rank is merged first.
    """
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        n = len(token)
        cuts = [i for i in range(1, n) if token[:i] in ranks and token[i:] in ranks]
        if len(cuts) > 1:
            leads = [i for i in cuts if token[i:] == token[: n - i] and 2 * i >= n]
            cuts = leads[::-1] + [i for i in cuts if i not in leads]
        out += [(token[:i], token[i:]) for i in cuts]
    return out


class BytePairCodec:
    """Encoder and decoder of one rank file. Lives in a task's process; see :func:`codec`."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.models import BPE

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        self.model = BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[(name[a], name[b]) for a, b in _merges(ranks)], ignore_merges=True, cache_capacity=0)
        self.words = regex.compile(pattern).findall
        self.shown = dict(enumerate(shown))
        self.kept: dict[str, bytes] = {}
        self.held = 0
        self.missing = [b for b in range(256) if bytes([b]) not in ranks]
        reverse = {c: b for b, c in enumerate(shown)}
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = bytes(reverse[c] for c in name[token])
        self.length = np.array([len(t or b"") for t in tokens], np.int64)
        self.known = np.array([t is not None for t in tokens], bool)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        #: Continuation bytes of UTF-8; a token that begins with one begins inside a character.
        self.inside = np.array([bool(t) and 0x80 <= t[0] < 0xC0 for t in tokens], bool)

    def pack(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        out = []
        for part in _parts(text):
            words = self.words(part)
            if self.held > KEPT_BYTES:
                self.kept.clear()
                self.held = 0
            for word in set(words).difference(self.kept):
                mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
                ids = self.kept[word] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))
                self.held += len(mapped) + len(ids) + WORD_BYTES
            out += map(self.kept.__getitem__, words)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pack(text), "<u4")

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character that each token has bytes of; tokens that share a character overlap."""
        if len(ids) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        body = np.frombuffer(text.encode("utf-8"), np.uint8)
        character = np.cumsum((body & 0xC0) != 0x80)
        ends = np.cumsum(self.length[ids.astype(np.int64)])
        starts = np.concatenate([[0], ends[:-1]])
        return character[starts] - 1, character[ends - 1]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; whole characters come together from the tokens that share them."""
        ids = ids.astype(np.int64)
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.length) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        length = self.length[ids]
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(self.start[ids] - first, length)
        return self.bytes[at].tobytes()


_CUT = regex.compile(r"(?<=\S)(?=\s)")


def _parts(text: str) -> Iterator[str]:
    """Pieces of at least CHUNK_CHARS characters, cut where white space follows another character."""
    begin = 0
    while len(text) - begin > CHUNK_CHARS:
        cut = _CUT.search(text, begin + CHUNK_CHARS)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    if begin < len(text):
        yield text[begin:]


def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of this process, built once."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = BytePairCodec(path, pattern)
    return _MODELS[path, pattern]


def _add(df: DataFrame, source: str, columns: dict[str, str], make) -> DataFrame:
    """df with columns from ``make(source column) -> list of Arrow arrays``; they replace columns of their names."""
    df = without(df, list(columns))
    added = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    schema = T.StructType([*df.schema.fields, *added.fields])
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, at):
                made = make(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *columns])

    return df.mapInArrow(lean(run), schema)


def _slices(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch whose column holds about ``most`` bytes at most."""
    column = batch.column(at)
    rows = max(1, int(batch.num_rows * most / max(most, column.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array<int>), ``packed`` (ids as little-endian unsigned 32-bit integers) and ``n_tokens``; with offsets
    also ``starts`` and ``ends``, the characters that each token covers."""
    kinds = {"ids": "array<int>", "packed": "binary", "n_tokens": "bigint"} | ({"starts": "array<int>", "ends": "array<int>"} if offsets else {})

    def make(column: pa.Array) -> list[pa.Array]:
        model = codec(path, pattern)
        texts = [x or "" for x in column.to_pylist()]
        packed = [model.pack(x) for x in texts]
        ids = [np.frombuffer(x, "<u4") for x in packed]
        out = [_lists(ids), pa.array(packed, pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
        pairs = [model.spans(*x) for x in zip(texts, ids, strict=True)] if offsets else []
        return out + [_lists([x[k] for x in pairs]) for k in (0, 1) if offsets]

    return _add(df, text, kinds, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (the bytes) and ``decoded_text`` (read as UTF-8, U+FFFD for what isn't)."""

    def make(column: pa.Array) -> list[pa.Array]:
        model = codec(path, pattern)
        out = [None if x is None or None in x else model.decode(np.array(x, np.int64)) for x in column.to_pylist()]
        return [pa.array(out, pa.binary()), pa.array([None if x is None else x.decode("utf-8", "replace") for x in out], pa.string())]

    return _add(df, ids, {"decoded": "binary", "decoded_text": "string"}, make)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: adds ``n_tokens``, ``packed``, ``decoded`` and ``n_split``, the number of tokens that begin inside a character."""

    def make(column: pa.Array) -> list[pa.Array]:
        model = codec(path, pattern)
        packed = [model.pack(x or "") for x in column.to_pylist()]
        ids = [np.frombuffer(x, "<u4") for x in packed]
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array(packed, pa.binary()),
            pa.array([model.decode(x) for x in ids], pa.binary()),
            pa.array([int(model.inside[x.astype(np.int64)].sum()) for x in ids], pa.int64()),
        ]

    return _add(df, text, {"n_tokens": "bigint", "packed": "binary", "decoded": "binary", "n_split": "bigint"}, make)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of packed ids and of decoded bytes, n_split."""
    return coded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
