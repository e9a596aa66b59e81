"""Relevance of texts to vocabularies: vendors, products, words, techniques, fuzzy terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from riskweave.functions import vocabulary as V
from riskweave.functions.expressions import contains_any, contains_words, flag, phrases, short_or_long, word_pattern
from riskweave.operators.joins import dealt_hits, fits, matches
from riskweave.session import stage


def health_vendor(text: Column) -> Column:
    """First vendor, in the vocabulary's order, one of whose terms stands in the lower-case text as whole words."""
    return F.coalesce(*[F.when(contains_words(text, terms), F.lit(name)) for name, terms in V.HEALTH_VENDOR_TERMS.items()])


def health_score(df: DataFrame, column: str = "description") -> DataFrame:
    """df with matched_vendor, has_product, has_keyword, health_score (0.5, 0.3, 0.2) and health_flag (over 0.3)."""
    text = F.col("_lowered")  # a column of its own, lowered once for all terms
    products = [t for terms in V.HEALTH_PRODUCT_TERMS.values() for t in terms]
    out = df.withColumn("_lowered", F.lower(F.coalesce(F.col(column), F.lit("")))).withColumns({"matched_vendor": health_vendor(text), "has_product": flag(short_or_long(text, products)), "has_keyword": flag(short_or_long(text, V.HEALTH_KEYWORDS))}).drop("_lowered")
    score = F.when(F.col("matched_vendor").isNotNull(), 0.5).otherwise(0.0) + F.col("has_product") * 0.3 + F.col("has_keyword") * 0.2
    return out.withColumn("health_score", F.round(F.least(F.lit(1.0), score), 6)).withColumn("health_flag", flag(F.col("health_score") > 0.3))


def health_coverage(scored: DataFrame) -> DataFrame:
    """(vendor, n, flagged, mean_score), texts without a vendor as ``none``."""
    return scored.groupBy(F.coalesce("matched_vendor", F.lit("none")).alias("vendor")).agg(F.count(F.lit(1)).alias("n"), F.sum("health_flag").alias("flagged"), F.round(F.avg("health_score"), 6).alias("mean_score"))


def pattern_flag(df: DataFrame, patterns: list[str], column: str = "description", name: str = "pattern_flag") -> DataFrame:
    """1 where a pattern stands in the text: those of letters, digits, ``_``, ``-`` and spaces as whole words, others anywhere."""
    import re

    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    parts = [word_pattern(p) if re.fullmatch(r"[a-z0-9_\-\s]+", p) else re.escape(p) for p in map(str.lower, patterns)]
    return df.withColumn(name, flag(text.rlike("|".join(parts))) if parts else F.lit(0))


def vocabulary_rows(spark) -> DataFrame:
    """(type, key, pattern, active) of the built-in vocabularies."""
    rows = [("vendor", k, t, 1) for k, terms in V.HEALTH_VENDOR_TERMS.items() for t in terms]
    rows += [("product", k, t, 1) for k, terms in V.HEALTH_PRODUCT_TERMS.items() for t in terms]
    rows += [("keyword", "keyword", t, 1) for t in V.HEALTH_KEYWORDS]
    return spark.createDataFrame(rows, "type string, key string, pattern string, active int")


def techniques(texts: DataFrame, key: str, column: str, vocabulary: DataFrame) -> DataFrame:
    """(key, ids, n): sorted distinct technique ids of the vocabulary (term, technique) whose terms stand in the text as whole words."""
    hits = matches(texts, key, F.col(column), vocabulary)
    return hits.groupBy(key).agg(F.array_sort(F.collect_set("technique")).alias("ids")).withColumn("n", F.size("ids"))


def technique_info(hits: DataFrame, info: DataFrame) -> DataFrame:
    """hits (key, ids, n) with ``names``: the names of the ids in their order, by the table (technique, name); unknown ids are left out."""
    long = hits.select("*", F.posexplode("ids").alias("_p", "technique")).join(info.select("technique", "name"), "technique", "left")
    keys = [c for c in hits.columns if c != "ids"]
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("_p", "name")))), lambda x: x["name"])
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "technique"))), lambda x: x["technique"]).alias("ids"), named.alias("names"))


def first_names(hits: DataFrame, key: str, most: int) -> DataFrame:
    """(key, names): the first ``most`` distinct names of the hits (key, name, priority), by priority then name."""
    best = hits.groupBy(key, "name").agg(F.min("priority").alias("priority"))
    ordered = F.array_sort(F.collect_list(F.struct("priority", "name")))
    return best.groupBy(key).agg(F.slice(F.transform(ordered, lambda x: x["name"]), 1, most).alias("names"))


def catalogue_hits(texts: DataFrame, key: str, column: str, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """(key, products): the first ``most`` catalogue names, by priority then name, of the vocabulary (term, name, priority)."""
    return first_names(matches(texts, key, F.col(column), vocabulary), key, most).withColumnRenamed("names", "products")


def catalogue_match(texts: DataFrame, key: str, column: str, vendors: DataFrame, products: DataFrame, most: int = 3) -> DataFrame:
    """(key, flag, matched) of all texts in two stages: vendor names (name, priority) of five characters or more anywhere in the text; where none is, product
    names (name, priority) as whole words. ``matched`` holds the first ``most`` by priority, marked ``vendor:`` or ``product:``."""
    rows = texts.select(key, column)
    named = vendors.select(F.lower("name").alias("name"), "priority").where(F.length("name") > 4)
    by_vendor = first_names(contained(rows, key, column, named.withColumn("term", F.col("name")), 5), key, most).withColumn("kind", F.lit("vendor:"))
    others = rows.join(by_vendor, key, "left_anti")
    by_product = first_names(matches(others, key, F.col(column), products.withColumn("term", F.col("name"))), key, most).withColumn("kind", F.lit("product:"))
    found = by_vendor.unionByName(by_product)
    marked = F.transform("names", lambda n: F.concat(F.col("kind"), n))
    return rows.select(key).join(found, key, "left").select(key, flag(F.col("names").isNotNull()).alias("flag"), F.coalesce(marked, F.array().cast("array<string>")).alias("matched"))


#: Wanted runs, of a few characters each, up to which they are broadcast themselves; beyond, a filter of them is.
BROADCAST_RUNS = 200_000
#: Bits of the filter of anchors that is broadcast: 64 KB, whatever the number of terms.
FILTER_BITS = 1 << 19


def _grams(column: Column, least: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{least}}}))"), 1))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def _passing(texts: DataFrame, key: str, column: str, wanted: DataFrame, least: int) -> DataFrame:
    """(key, _g): the distinct runs of ``least`` characters of each text that are wanted (_g); where these are many, that a filter of them lets through, which is one row of 2^19 bits."""
    if wanted.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        every = texts.select(key, F.explode(_grams(F.lower(F.coalesce(F.col(column), F.lit(""))), least)).alias("_g"))
        return every.join(F.broadcast(wanted.select("_g")), "_g", "left_semi").select(key, "_g")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = wanted.select(place("_g").alias("_h")).groupBy(F.floor(F.col("_h") / 64).cast("int").alias("_w")).agg(F.bit_or(_bit(F.col("_h"))).alias("_b"))
    filled = words.agg(F.map_from_entries(F.collect_list(F.struct("_w", "_b"))).alias("_m"))
    bits = F.broadcast(filled.select(F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint"))).alias("_bits")))

    def let_through(g: Column) -> Column:
        at = place(g)
        return F.get("_bits", F.floor(at / 64).cast("int")).bitwiseAND(_bit(at)) != 0

    found = texts.select(key, _grams(F.lower(F.coalesce(F.col(column), F.lit(""))), least).alias("_all")).join(bits)
    return found.select(key, F.explode(F.filter("_all", let_through)).alias("_g"))


def anchored(texts: DataFrame, key: str, column: str, terms: DataFrame, least: int = 4) -> DataFrame:
    """terms of ``least`` characters or more with _t, the lower-case term, and _g, its anchor: of its runs of ``least`` characters the one in the fewest texts (the first of equals)."""
    wanted = terms.where(F.length("term") >= least).withColumn("_t", F.lower("term"))
    runs = wanted.select("_t").distinct().select("_t", F.posexplode(_grams(F.col("_t"), least)).alias("_at", "_g"))
    counts = _passing(texts, key, column, stage(runs.select("_g").distinct(), "term-runs"), least).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = runs.join(counts, "_g", "left").groupBy("_t").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_at", "_g"))["_g"].alias("_g"))
    return wanted.join(rarest, "_t")


#: Terms up to which each is tested on each text, without anchors.
FEW_TERMS = 32


def _terms_of(terms: list[str], least: int) -> Callable[[str], list[str]]:
    """The terms, of ``least`` characters or more, that stand in a text."""
    runs = {t: list(dict.fromkeys(t[i : i + least] for i in range(max(1, len(t) - least + 1)))) for t in terms}
    shared = Counter(r for of in runs.values() for r in of)
    anchored: dict[str, list[str]] = {}
    for t, of in runs.items():
        anchored.setdefault(min(of, key=shared.__getitem__), []).append(t)
    if len(terms) <= FEW_TERMS:
        return lambda text: [t for t in terms if t in text]
    # a term whose lower case is shorter than ``least`` is its own anchor
    lengths = sorted({len(a) for a in anchored})
    return lambda text: [t for n in lengths for a in anchored.keys() & {text[i : i + n] for i in range(len(text) - n + 1)} for t in anchored[a] if t in text]


def contained(texts: DataFrame, key: str, column: str, terms: DataFrame, least: int = 4) -> DataFrame:
    """(key, ...) of the terms (term, ...) of ``least`` characters or more that stand anywhere in a lower-case text, within words too; keys are taken to be unique.

    A term is looked for by an anchor, a run of ``least`` characters of it. Terms of a checked size go to the tasks, which test those whose anchor a text has where they read it; an anchor is then the run
    that the fewest terms have. More terms stay a table, and an anchor is the run that the fewest texts have: texts give only runs that a filter of all anchors lets through, as rows without the text,
    and the few pairs that meet are tested on the text.
    """
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    named = stage(terms.where(F.length("term") >= least).withColumn("_t", F.lower("term")), "contained-terms")
    if fits(named, BROADCAST_RUNS):
        each = [r[0] for r in named.select("_t").distinct().collect()]  # of checked size
        return dealt_hits(texts, key, lowered, _terms_of(each, least), "_t").join(F.broadcast(named), "_t").drop("_t")
    wanted = stage(anchored(texts, key, column, terms, least), "term-anchors")
    pairs = _passing(texts, key, column, wanted.select("_g").distinct(), least).join(wanted, "_g").drop("_g")
    return texts.select(key, lowered.alias("_x")).join(pairs, key).where(F.col("_x").contains(F.col("_t"))).drop("_x", "_t")


def mentioned(texts: DataFrame, key: str, column: str, terms: DataFrame, least: int = 4) -> DataFrame:
    """texts whose lower-case text holds a term of ``least`` characters or more anywhere, within words too."""
    hits = contained(texts, key, column, terms.select(F.lower("term").alias("term")).distinct(), least)
    return texts.join(hits.select(key).distinct(), key, "left_semi")


def term_list(texts: DataFrame, columns: list[str], stop_words: list[str], low: int = 5, high: int = 80, most: int = 3000) -> DataFrame:
    """(term): the first ``most``, in order, of the distinct phrases and short texts of the columns with ``low`` to ``high`` characters. The limit is the list's size."""
    each = [texts.select(F.explode(phrases(F.col(c), stop_words)).alias("term")) for c in columns]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.where(F.length("term").between(low, high)).distinct().orderBy("term").limit(most)


def fuzzy_flag(texts: DataFrame, key: str, column: str, terms: DataFrame, anchors: list[str], threshold: float = 0.6) -> DataFrame:
    """(key, similarity, flag) of all texts: flagged if the best cosine is ``threshold`` or more, or a term stands in the text, and an anchor word stands in it too."""
    best = fuzzy_scores(texts, key, column, terms)
    short = terms.agg(F.coalesce(F.min(F.length("term")), F.lit(1))).first()[0]
    inside = mentioned(texts, key, column, terms, max(1, short)).select(key, F.lit(1).alias("_in"))
    out = texts.select(key, column).join(best, key, "left").join(inside, key, "left")
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    near = (F.coalesce("best", F.lit(0.0)) >= threshold) | F.col("_in").isNotNull()
    return out.select(key, F.coalesce("best", F.lit(0.0)).alias("similarity"), flag(near & contains_any(text, anchors)).alias("flag"))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of ``low`` to ``high`` characters of each word between blanks; a padded word no longer than n gives itself once and no longer runs."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " "), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        parts = []
        for n in range(low, high + 1):
            # n = low always; a longer n only while the word is longer than the n before
            grows = F.lit(True) if n == low else size > n - 1
            parts.append(F.when(grows, _runs(padded, size, n)).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(words, of))


def _runs(padded: Column, size: Column, n: int) -> Column:
    def run(i: Column) -> Column:
        return F.substring(padded, i, F.lit(n))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), run)


def _weighted(texts: DataFrame, key: str, column: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit vectors (term, g, w, idf) of terms and (key, g, v, idf) of texts over character runs weighted by count and ``ln((1 + N) / (1 + df)) + 1``, both fitted on the terms. Text runs that no term has go before rows meet."""
    t = terms.select(F.col("term"), F.explode(char_grams(F.col("term"))).alias("g")).groupBy("term", "g").agg(F.count(F.lit(1)).alias("tf"))
    n = F.broadcast(terms.agg(F.count(F.lit(1)).alias("_n")))
    idf = t.groupBy("g").agg(F.count(F.lit(1)).alias("df")).join(n).select("g", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(rows: DataFrame, name: str, value: str) -> DataFrame:
        heavy = rows.join(idf, "g").select(name, "g", (F.col("tf") * F.col("idf")).alias("_w"), "idf")
        norms = heavy.groupBy(name).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        return heavy.join(norms, name).select(name, "g", (F.col("_w") / F.col("_norm")).alias(value), "idf")

    d = texts.select(key, F.explode(char_grams(F.col(column))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))
    return unit(t, "term", "w"), unit(d, key, "v")


def _prefix(vectors: DataFrame, name: str, value: str, threshold: float) -> DataFrame:
    """The runs of each vector, rarest first, without those last ones whose norm stays below the threshold: two vectors that share only such runs cannot reach it."""
    rest = F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(name).orderBy("idf", F.desc("g")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return vectors.withColumn("_rest", rest).where(F.sqrt("_rest") >= threshold - 1e-9).select(name, "g")


def fuzzy_candidates(texts: DataFrame, key: str, column: str, terms: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term) pairs that share a run of both prefixes, and the staged vectors: every pair whose cosine reaches the threshold is among them, since the rarest run that it shares is in both prefixes."""
    t, d = (stage(x, name) for x, name in zip(_weighted(texts, key, column, terms), ("fuzzy-terms", "fuzzy-texts")))
    return _prefix(d, key, "v", threshold).join(_prefix(t, "term", "w", threshold), "g").select(key, "term").distinct(), t, d


#: Weights, zeros included, up to which the vectors of all terms go to the tasks as one matrix.
MATRIX = 4_000_000


def _matrix(texts: DataFrame, key: str, column: str, terms: DataFrame) -> tuple[list[str], list[tuple[str, float]], np.ndarray] | None:
    """Terms, runs with their idf, and unit vectors of the terms (terms x runs), if they have at most MATRIX weights."""
    units = stage(_weighted(texts, key, column, terms)[0], "fuzzy-terms")
    rows, columns = units.agg(F.count_distinct("term"), F.count_distinct("g")).first()
    if not 0 < rows * columns <= MATRIX:
        return None
    each = units.collect()  # of checked size
    named, runs = sorted({r["term"] for r in each}), sorted({(r["g"], r["idf"]) for r in each})
    row, at = {t: i for i, t in enumerate(named)}, {g: i for i, (g, _) in enumerate(runs)}
    out = np.zeros((len(named), len(runs)))
    for r in each:
        out[row[r["term"]], at[r["g"]]] = r["w"]
    return named, runs, out


def _cosines(texts: DataFrame, key: str, column: str, matrix: tuple[list[str], list[tuple[str, float]], np.ndarray], least: float | None) -> DataFrame:
    """(key, term, cosine): of each text with a run of the terms the best term, or all of cosine ``least`` or more. The texts of one key count as one.

    Texts come in order of key, and a task counts runs for a block of keys at a time; a word's runs are looked up once while it is remembered.
    """
    named, runs, units = matrix
    idf, at = np.array([x for _, x in runs]), {g: i for i, (g, _) in enumerate(runs)}
    most, schema = max(1, min(1024, (1 << 21) // max(1, len(runs)))), StructType([StructField(key, texts.schema[key].dataType), StructField("term", StringType()), StructField("cosine", DoubleType())])

    def of(word: str) -> list[int]:
        padded = f" {word} "
        return [at[g] for n in (3, 4, 5) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, flat, owner, kind = {}, [], [], [], None
        counts = np.zeros(most * len(runs))

        def fold() -> None:
            nonlocal flat, owner
            if flat:
                counts[:] += np.bincount(np.array(flat) + np.repeat([o for o, _ in owner], [n for _, n in owner]) * len(runs), minlength=len(counts))
            flat, owner = [], []

        def block() -> pa.RecordBatch:
            fold()
            v = counts.reshape(most, -1)[: len(keys)] * idf
            dots, length = v @ units.T, np.sqrt((v * v).sum(1, keepdims=True))
            cosine = dots / np.where(length > 0, length, 1.0)
            if least is None:
                who = np.flatnonzero(length[:, 0] > 0)
                what = cosine[who].argmax(1)
            else:
                who, what = np.nonzero((dots > 0) & (cosine >= least - 1e-6))
            out = [pa.array([keys[i] for i in who], kind), pa.array([named[j] for j in what], pa.string()), pa.array(cosine[who, what])]
            keys.clear()
            counts[:] = 0
            return pa.RecordBatch.from_arrays(out, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not keys or keys[-1] != name:
                    if len(keys) == most:
                        yield block()
                    keys.append(name)
                before = len(flat)
                for word in text.split(" "):
                    if word:
                        if word not in known:
                            if len(known) >= 50_000:
                                known.clear()
                            known[word] = of(word)
                        flat += known[word]
                owner.append((len(keys) - 1, len(flat) - before))
                if len(flat) > 1_000_000:
                    fold()
        if keys:
            yield block()

    plain = F.trim(F.regexp_replace(F.lower(F.col(column)), r"\s+", " "))
    rows = texts.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, plain.alias("_x"))
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def fuzzy_matches(texts: DataFrame, key: str, column: str, terms: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(key, term, cosine) of all texts and terms whose cosine is ``threshold`` or more: by the matrix of the terms where it is small, else a similarity join by prefixes, verified on the whole vectors."""
    if (matrix := _matrix(texts, key, column, terms)) is not None:
        return _cosines(texts, key, column, matrix, threshold).where(F.round("cosine", 9) >= threshold)
    pairs, t, d = fuzzy_candidates(texts, key, column, terms, threshold)
    dots = pairs.join(t, "term").join(d.select(key, "g", "v"), [key, "g"]).groupBy(key, "term").agg(F.sum(F.col("v") * F.col("w")).alias("cosine"))
    return dots.where(F.round("cosine", 9) >= threshold)


def fuzzy_scores(texts: DataFrame, key: str, column: str, terms: DataFrame) -> DataFrame:
    """(key, best): largest cosine of a text with a term, over character runs weighted by count and ``ln((1 + N) / (1 + df)) + 1``, both fitted on the terms.

    The terms' vectors are one matrix where it is small; else their weights stay a table. Text runs outside of them have no weight and go before rows meet.
    """
    if (matrix := _matrix(texts, key, column, terms)) is not None:
        return _cosines(texts, key, column, matrix, None).select(key, F.col("cosine").alias("best"))
    t = terms.select(F.col("term"), F.explode(char_grams(F.col("term"))).alias("g")).groupBy("term", "g").agg(F.count(F.lit(1)).alias("tf"))
    n = F.broadcast(terms.agg(F.count(F.lit(1)).alias("_n")))
    idf = t.groupBy("g").agg(F.count(F.lit(1)).alias("df")).join(n).select("g", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = t.join(idf, "g").select("term", "g", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norms, "term").select("term", "g", (F.col("w") / F.col("norm")).alias("w"))
    d = texts.select(key, F.explode(char_grams(F.col(column))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))
    d = d.join(idf, "g").select(key, "g", (F.col("tf") * F.col("idf")).alias("v"))
    lengths = d.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = d.join(unit, "g").groupBy(key, "term").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dots.join(lengths, key).groupBy(key).agg(F.max(F.col("dot") / F.col("length")).alias("best"))
