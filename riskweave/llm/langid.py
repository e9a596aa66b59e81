"""Language identification by hierarchical discrimination.

A linear one-versus-rest support vector machine on hashed byte n-grams first names the language family; within the family, one-versus-one linear machines
decide between each pair of its languages by votes, ties by the sum of margins. Families with one language need no second step.

Training takes a bounded sample: of each language the ``per_language`` rows with the least hash of their id and text (SAMPLE rows in all), whole texts. Only text and lang
of rows outside the held-out fold are read for it. Prediction sees the text alone.

Defined results: a null text, or one without any letter, is ``und`` with score 0; so is everything if no row can be learned from;
one learned language is predicted for all other texts with score 1; texts of any length are read whole, a piece at a time; equal machines' votes go to the first language in order;
repeated rows each give a row; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import _text
from riskweave.llm._columns import without
from riskweave.llm._memory import lean
from riskweave.llm.lm import held_out
from riskweave.session import stage

#: Rows that a classifier is fitted on at most: of each language, and of all. Where there are more languages than rows, the most frequent have one each.
PER_LANGUAGE = 600
SAMPLE = 6000
DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3, 4)
EPOCHS = 12
#: Bytes of text counted at once.
PIECE_BYTES = 1 << 19
REGULAR = 1e-4
UNDETERMINED = "und"

# fixed values: families of languages by ISO 639-1 code; others form a family each
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, rows, unit vectors) of the texts' hashed byte n-grams, a chunk at a time; A-Z as a-z, digits and ASCII signs as one byte."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    fold[list(_text.NON_WORDS)] = np.uint64(32)
    fold[48:58] = np.uint64(32)
    body, offsets = _text.utf8_parts(column)
    for i, j in _text.chunks(offsets, most=PIECE_BYTES, most_rows=256):
        n = j - i
        out = np.zeros((n, DIMENSIONS), np.float32)
        # a text longer than a piece is counted piece by piece; n-grams that begin in a piece may end in the next one
        for begin in range(int(offsets[i]), int(offsets[j]), PIECE_BYTES):
            end = min(int(offsets[j]), begin + PIECE_BYTES)
            upto = min(int(offsets[j]), end + max(ORDERS) - 1)
            part = fold[body[begin:upto]]
            rows = np.searchsorted(offsets[i : j + 1], np.arange(begin, upto), "right") - 1 if n > 1 else np.zeros(upto - begin, np.int64)
            _count(part, rows, end - begin, out)
        np.log1p(out, out=out)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        yield i, n, out / np.maximum(norm, 1e-9)


def _count(part: np.ndarray, rows: np.ndarray, begins: int, out: np.ndarray) -> None:
    """Adds the n-grams of the bytes that begin among the first ``begins`` of them to out, by row and cell."""
    code = np.zeros(len(part), np.uint64)
    for k in ORDERS:
        if len(part) < k:
            break
        code = code[: len(part) - k + 1] * np.uint64(256) + part[k - 1 :]
        inside = rows[: len(code)] == rows[k - 1 :]
        inside[begins:] = False
        cell = (_text.mix(code[inside], k) % np.uint64(DIMENSIONS)).astype(np.int64)
        at = rows[: len(code)][inside]
        # rows ascend, so a block of rows is a run of cells: no array of all rows times all cells of counts is kept twice
        step = max(1, (1 << 20) // DIMENSIONS)
        for a in range(0, len(out), step):
            b = min(len(out), a + step)
            low, high = np.searchsorted(at, [a, b])
            if low < high:
                out[a:b] += np.bincount((at[low:high] - a) * DIMENSIONS + cell[low:high], minlength=(b - a) * DIMENSIONS).reshape(b - a, DIMENSIONS)


def train_svm(x: np.ndarray, y: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights and bias of a linear support vector machine: subgradient steps on hinge loss, averaged; classes weigh alike. y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    random = np.random.default_rng(seed)
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for a in range(0, len(y), 32):
            at = order[a : a + 32]
            t += 1
            rate = 1 / (REGULAR * (t + 100))
            wrong = y[at] * (x[at] @ w) < 1
            w *= 1 - rate * REGULAR
            w += rate / len(at) * ((y[at] * weight[at] * wrong) @ x[at])
            norm = np.sqrt(w @ w) * np.sqrt(REGULAR)
            if norm > 1:
                w /= norm
            if epoch >= EPOCHS // 2:
                mean += w
    return (mean / max(1e-9, np.sqrt(mean @ mean))).astype(np.float32)


class Model:
    """The machines of a set of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        lang = np.array(langs)
        family = np.array([family_of(z) for z in langs])
        self.families = {f: sorted({z for z in self.langs if family_of(z) == f}) for f in sorted(set(family))}
        names = list(self.families)
        self.first = {f: train_svm(x, np.where(family == f, 1.0, -1.0)) for f in names} if len(names) > 1 else {}
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = train_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0))
        margins = [np.abs(x @ w[:-1] + w[-1]) for w in [*self.first.values(), *self.pairs.values()]]
        #: Half of the sample's margins are larger; a margin of this size has score 0.88.
        self.scale = 2 / max(1e-6, float(np.median(np.concatenate(margins)))) if margins else 1.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = list(self.families)
        score = np.ones(len(x))
        chosen = np.zeros(len(x), np.int64)
        if self.first:
            margin = np.stack([x @ w[:-1] + w[-1] for w in self.first.values()], 1)
            chosen = margin.argmax(1)
            score = self._sure(margin[np.arange(len(x)), chosen])
        out = np.empty(len(x), object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(chosen == k)
            members = self.families[name]
            votes = np.zeros((len(rows), len(members), 2))
            least = np.ones((len(rows), len(members)))
            for a, b in combinations(members, 2):
                w = self.pairs[a, b]
                margin = x[rows] @ w[:-1] + w[-1]
                for lang, sign in ((a, 1), (b, -1)):
                    i = members.index(lang)
                    votes[:, i, 0] += sign * margin > 0
                    votes[:, i, 1] += sign * margin
                    least[:, i] = np.minimum(least[:, i], self._sure(sign * margin))
            best = (votes[:, :, 0] * 1e6 + votes[:, :, 1]).argmax(1)
            out[rows] = [members[i] for i in best]
            score[rows] *= least[np.arange(len(rows)), best]
        return list(out), score

    def _sure(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.scale * margin))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "_key", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of a bounded sample of (key, text, lang): at most per_language rows of each language come together."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.md5(F.concat(F.length(key).cast("string"), F.lit(":"), F.col(key), F.col(text))).alias("_order"))
    # rows by language and leading digits of the hash: what lies beyond the digits that hold enough rows is left out before rows are ranked
    digits = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int").alias("_digits")
    sizes = stage(rows.groupBy("lang", digits).agg(F.count(F.lit(1)).alias("_n")), "langid-sizes")
    counts = sizes.groupBy("lang").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "lang").limit(SAMPLE).collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, SAMPLE // len(counts)))
    chosen = rows.sparkSession.createDataFrame([(r["lang"],) for r in counts], "lang string")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = sizes.join(F.broadcast(chosen), "lang").withColumn("_before", before).where(F.col("_before") < per_language).groupBy("lang").agg(F.max("_digits").alias("_upto"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order"))
    # the last of the least hashes of a language is found without the texts; equal rows have equal hashes, so rows are ranked again
    near = rows.select("lang", "_order", digits).join(F.broadcast(known), "lang").where(F.col("_digits") <= F.col("_upto"))
    hashes = near.select("lang", "_order").withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    last = hashes.groupBy("lang").agg(F.max("_order").alias("_last"))
    some = rows.join(F.broadcast(last), "lang").where(F.col("_order") <= F.col("_last")).select("lang", "text", "_order")
    sample = some.withColumn("_rank", rank).where(F.col("_rank") <= per_language).drop("_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, x in features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, n).select([0, 2]).columns, pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "_order", "x"])

    got = sample.mapInArrow(lean(run), "lang string, _order string, x binary").toArrow().sort_by([("lang", "ascending"), ("_order", "ascending")])
    if not len(got):
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in got["x"]]).astype(np.float32)
    return Model(x, got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = without(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, n, x in features(batch.column(at)):
                part = batch.slice(first, n)
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in part.column(at).to_pylist()], bool)
                names, score = known.predict(x) if known is not None else ([UNDETERMINED] * n, np.zeros(n))
                names = [a if ok else UNDETERMINED for a, ok in zip(names, letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows outside the fold."""
    out = held_out(doc_id, folds, fold)
    labelled = docs.where(~out).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(labelled, per_language=per_language)
    return predict(without(docs, ["held_out"]), model, text).withColumn("held_out", out)
