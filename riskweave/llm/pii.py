"""Personal data: patterns, and information-theoretic sanitisation of terms that reveal what they match.

Every value that the patterns find (email, ip, card, phone) is a protected entity. Its context is taken twice, over the whole corpus: the words (two letters or
more) among the ``WINDOW`` on each side of it, and all words of the documents that hold it. With contexts of entity e, occurrences of term t, their co-occurrences and all words counted (by
document: documents of each, and all documents), the disclosure of e by t is ``PMI(e, t) / IC(e) = 1 + log p(e | t) / -log p(e)``: 1 if t stands only near e, 0 if independent.
Terms seen with the entity in ``SUPPORT`` contexts or more that point to it more often than not (``p(e | t) >= 1/2``) and disclose ``GENERALISE`` or more by either count are listed. A listed
term is generalised to a placeholder, at ``REMOVE`` or more removed, wherever it stands, also in texts that do not hold the entity; words that a span covers go with it.
Texts with neither personal data nor a listed term stay as they are.

Defined results: null texts count as empty, and stay null when sanitised; texts of any length are read whole; of spans of a kind that could overlap the leftmost stands; repeated rows count each time; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm._columns import guarded
from riskweave.llm._memory import lean
from riskweave.session import stage

# fixed values: kinds and their patterns, in the order in which equal starts are listed
KINDS = ["email", "ip", "card", "phone", "term"]
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# the same matches in linear time: parts that no other match can share are never given back, and a run that fails is passed as a whole
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")

WINDOW = 4
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.98
#: Distinct words that a task counts together.
GROUP_WORDS = 400_000
#: Terms, and bytes of them, up to which they are broadcast; more are joined by shuffling.
BROADCAST_TERMS = 200_000
BROADCAST_BYTES = 8 << 20

_WORD = re.compile(r"[^\W\d_]{2,}")
_RUN = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern: from each ``@`` back over the run before it, but not into the match before, and on over the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
        else:
            last = at + 1
        at = text.find("@", last)


def _is_address(dotted: str) -> bool:
    parts = [p.lstrip("0") for p in dotted.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every match that passes its test, by start, then kind as listed. Takes time in proportion to the text, whatever it holds."""
    out = [(a, b, 0) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _DOTTED.finditer(text) if m[1] and _is_address(m[0])]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def _hash(value: str) -> int:
    """A signed 64-bit hash that is the same in every process."""
    x = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def words(text: str) -> list[str]:
    """The words of two letters or more, lower case."""
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


def _free(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Whether no span covers a part of [start, end)."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return free


def contexts(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[str, str]], set[str], set[str]]:
    """(entity, term) of the words near each entity, the entities, and the words of the text; without words that a span covers."""
    near, entities, free = [], set(), _free(spans)
    runs = [m.span() for m in _RUN.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    terms = [text[a:b].lower() if b - a >= 2 and free(a, b) else None for a, b in runs]
    for a, b, kind in spans:
        entity = kind + ":" + re.sub(r"[\s().-]", "", text[a:b].lower())
        entities.add(entity)
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        near += [(entity, t) for t in [*terms[max(0, i - WINDOW) : i], *terms[j : j + WINDOW]] if t is not None]
    return near, entities, {t for t in terms if t is not None}


def _found(texts: DataFrame) -> DataFrame:
    """(near, entities, words) of the texts that hold an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string())]))
        for batch in batches:
            near, entities, held = [], [], []
            for value in batch.column(0).to_pylist():
                if spans := find(value or ""):
                    beside, known, terms = contexts(value, spans)
                    near.append([{"entity": _hash(e), "term": t} for e, t in beside])
                    entities.append([_hash(e) for e in known])
                    held.append(list(terms))
            yield pa.RecordBatch.from_arrays([pa.array(near, pairs), pa.array(entities, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.string()))], names=["near", "entities", "words"])

    return texts.mapInArrow(lean(run), "near array<struct<entity:bigint,term:string>>, entities array<bigint>, words array<string>")


def _few(terms: DataFrame) -> bool:
    """Whether the terms are few and short enough to broadcast."""
    n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return n <= BROADCAST_TERMS and size <= BROADCAST_BYTES


def _term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n, docs): occurrences of the terms and documents that hold them, and of all words and all documents under the null term, counted over all texts."""
    few = _few(terms)
    known = texts.sparkSession.sparkContext.broadcast(frozenset(terms.toArrow()["term"].to_pylist()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        docs: Counter[str] = Counter()
        total, rows, wanted = 0, 0, known.value

        def out():
            made = pa.RecordBatch.from_pydict({"term": pa.array([None, *counts], pa.string()), "n": pa.array([total, *counts.values()], pa.int64()), "docs": pa.array([rows, *(docs[w] for w in counts)], pa.int64())})
            counts.clear()
            docs.clear()
            return made

        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = words(value or "")
                total, rows = total + len(found), rows + 1
                held = set(found) if wanted is None else wanted.intersection(found)
                if held:
                    docs.update(held)
                    counts.update(found if wanted is None else [w for w in found if w in held])
                if len(counts) > GROUP_WORDS:
                    yield out()
                    total = rows = 0
        yield out()

    counted = texts.mapInArrow(lean(run), "term string, n bigint, docs bigint")
    if not few:
        counted = counted.join(terms, "term", "left_semi").unionByName(counted.where("term IS NULL"))
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def revealing(texts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, disclosure) of the terms of all texts (one column) that reveal an entity."""
    found = stage(_found(texts), "pii-found")
    near = stage(found.select(F.explode("near").alias("x")).select("x.*").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint")), "pii-near")
    beside = near.groupBy("entity").agg(F.sum("joint").alias("n_entity"))
    # a pair in that many documents needs an entity in as many: the others' documents are not spread out
    holding = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    within = found.select("words", F.explode("entities").alias("entity")).join(holding, "entity", "left_semi").select("entity", F.explode("words").alias("term"))
    within = within.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("joint")).where(F.col("joint") >= support)
    often = near.where(F.col("joint") >= support).join(beside, "entity").withColumn("by", F.lit("n")).unionByName(within.join(holding, "entity").withColumn("by", F.lit("docs")))
    often = stage(often, "pii-joint")
    counts = stage(_term_counts(texts, stage(often.select("term").distinct(), "pii-terms")), "pii-counts")
    total = F.broadcast(counts.where("term IS NULL").select(F.col("n").alias("n_all"), F.col("docs").alias("docs_all")))  # one row
    rated = often.join(counts, "term").join(total)
    by_words = F.col("by") == "n"
    of, whole = F.when(by_words, F.col("n")).otherwise(F.col("docs")), F.when(by_words, F.col("n_all")).otherwise(F.col("docs_all"))
    information = -F.log(F.least(F.lit(1.0), F.col("n_entity") / F.greatest(whole, F.lit(1))))
    given = F.least(F.lit(1.0), F.col("joint") / F.greatest(of, "joint"))
    disclosure = F.when(information > 0, F.greatest(F.lit(0.0), 1 + F.log(given) / information)).otherwise(F.lit(0.0))
    return rated.where(given >= 0.5).select("term", disclosure.alias("disclosure")).where(F.col("disclosure") >= generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def marked(text: str, spans: list[tuple[int, int, str]], known: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, disclosure) of the listed terms wherever they stand in the text, but not where a span covers them."""
    if not known or known.keys().isdisjoint(words(text)):
        return []
    free = _free(spans)
    return [(m.start(), m.end(), known[w]) for m in _WORD.finditer(text) if (w := m[0].lower()) in known and free(*m.span())]


def _with_known(work: DataFrame, listed: DataFrame) -> DataFrame:
    """work (_text, ...) with _known, the listed terms that its text holds; for lists that are too long to broadcast."""
    rows = stage(work.withColumn("_uid", F.monotonically_increasing_id()), "pii-rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held := list(set(words(value or ""))):
                    yield pa.RecordBatch.from_pydict({"_uid": pa.array([uid] * len(held), pa.int64()), "term": pa.array(held, pa.string())})

    held = rows.select("_uid", "_text").mapInArrow(lean(run), "_uid bigint, term string").join(listed, "term")
    known = held.groupBy("_uid").agg(F.collect_list(F.struct("term", "disclosure")).alias("_known"))
    return rows.join(known, "_uid", "left").drop("_uid")


def _applied(work: DataFrame, support: int, generalise: float, make: Callable[[list[tuple]], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """_rest, and ``fields``: what ``make`` gives of (text, spans, terms) of a batch of work (_text, _rest)."""
    texts = work.select("_text")
    listed = stage(revealing(texts, support, generalise), "pii-listed")
    few = _few(listed)
    pairs = listed.toArrow() if few else None
    known = work.sparkSession.sparkContext.broadcast(dict(zip(pairs["term"].to_pylist(), pairs["disclosure"].to_pylist())) if few else None)
    rows = work.select("_text", "_rest") if few else _with_known(work, listed).select("_text", "_rest", "_known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            lists = [known.value] * len(values) if few else [{x["term"]: x["disclosure"] for x in k or []} for k in batch.column(2).to_pylist()]
            spans = [find(x or "") for x in values]
            terms = [marked(x or "", a, k) for x, a, k in zip(values, spans, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *make(list(zip(values, spans, terms)))], names=["_rest", *(f.name for f in fields)])

    return rows.mapInArrow(lean(run), T.StructType([work.schema["_rest"], *fields]))


def detect(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """docs without the text, with spans (start, end, kind) of the patterns and terms (start, end, disclosure), both by start."""
    work, restore = guarded(docs, {"_text": text})

    def make(rows: list[tuple]) -> list[pa.Array]:
        spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s, _ in rows]
        terms = [[{"start": a, "end": b, "disclosure": d} for a, b, d in t] for _, _, t in rows]
        place = [("start", pa.int32()), ("end", pa.int32())]
        return [pa.array(spans, pa.list_(pa.struct([*place, ("kind", pa.string())]))), pa.array(terms, pa.list_(pa.struct([*place, ("disclosure", pa.float64())])))]

    fields = T.StructType.fromDDL("spans array<struct<start:int,end:int,kind:string>>, terms array<struct<start:int,end:int,disclosure:double>>").fields
    found = _applied(work, support, generalise, make, fields)
    return restore(found.withColumn("_text", F.lit(None)), ["spans", "terms"]).drop(text)


def _joined(items: str) -> F.Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """Counts of the kinds, SHA-256 of the pattern spans, and all spans in one string."""
    kinds = KINDS[:4]
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind")))
    merged = F.array_sort(F.transform(F.concat("spans", terms), lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"])))
    whole = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined("spans"), 256).alias("base_sha256"), whole.alias("spans"))


def cleaned(text: str, spans: list[tuple[int, int, str]], terms: list[tuple[int, int, float]]) -> str:
    """The text with a placeholder for each span; terms of high disclosure go without one. Overlapping spans become one."""
    out, at = [], 0
    cuts = sorted([(a, b, f"[{kind.upper()}]") for a, b, kind in spans] + [(a, b, "[TERM]" if d < REMOVE else "") for a, b, d in terms])
    for a, b, mark in cuts:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """docs with personal data, and the terms that reveal it in any text, replaced; texts with neither stay as they are."""
    work, restore = guarded(docs, {"_text": text})
    field = work.schema["_text"]

    def make(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([cleaned(x, s, t) if s or t else x for x, s, t in rows], pa.string())]

    return restore(_applied(work, support, generalise, make, [field]), [])
