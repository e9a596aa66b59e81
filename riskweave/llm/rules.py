"""Quality rules whose cutoffs are chosen so that the risk of rejecting good documents is limited.

Labelled documents are dealt into two halves by a hash of their id. One half proposes: for each stratum (language) the steps of all rules, a step being one
rule at one cutoff, are put into one path by the share of bad documents among what they reject, a rule's cutoffs from lenient to strict. The other half, the holdout, certifies: it walks
the path, and each prefix of it is tested with the exact binomial distribution: were the chance of rejecting a good document above ``risk``, so few
rejections would be seen with probability ``alpha`` at most. The walk ends before the first prefix that fails, so a stratum's tests need no correction among themselves (each is made only if all
before it passed); between strata ``alpha`` is divided by their number. With probability 1 - ``alpha`` or more, the rules therefore reject at most a share
``risk`` of the good documents of every stratum at once. A stratum with too few labels for any prefix to pass gets no cutoffs.

Defined results: null texts have no words and fail the base rules; texts of any length are read whole; the null language is the stratum ``und``; repeated rows each count;
a document with several labels is good only if all say so, null labels and labels of no document count for nothing; documents without an id get a verdict like all others but no label; steps that catch
equal shares stand in order of rule name and cutoff; an empty table of documents or labels gives an empty result or no cutoffs; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.tails import binomial_at_most, binomial_upper
from riskweave.llm import _text
from riskweave.llm._columns import guarded
from riskweave.llm._memory import lean
from riskweave.session import stage

#: rule -> (numerator, denominator, factor, above, cutoffs from lenient to strict): rejected where factor * numerator is above (or below) cutoff * denominator.
RULES: dict[str, tuple[str, str, int, bool, tuple[int, ...]]] = {
    "duplicate_lines": ("n_dup_lines", "n_lines", 100, True, (90, 80, 70, 60, 50, 40, 30, 20)),
    "few_words_a_line": ("n_words", "n_lines", 10, False, (10, 12, 15, 20, 25, 30)),
    "long_words": ("word_chars", "n_words", 10, True, (300, 200, 150, 120, 110, 100, 90)),
    "repeated_windows": ("n_repeat_words", "n_words", 100, True, (45, 40, 35, 30, 25, 20, 15, 10)),
    "short_words": ("word_chars", "n_words", 10, False, (20, 25, 30, 35, 40)),
    "symbols": ("n_symbols", "word_chars", 1000, True, (400, 300, 200, 150, 120, 100, 80, 60, 40, 30, 20, 10)),
}
RISK, ALPHA = 0.05, 0.05
#: A step is proposed only if bad documents are this share or more of all that its rule rejects up to its cutoff.
LEAST_SHARE = 0.5
#: Rows up to which the table of steps, a summary of strata and cutoffs, is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000
LEAST_WORDS, MOST_REPEATED = 50, 50

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_WORDS, _LINES = _text.WordTable(_text.SPACES, fold=False), _text.WordTable(b"\n", fold=False)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LATER = np.zeros(256, bool)  # bytes that go on with a code point
_LATER[0x80:0xC0] = True


def _upto(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _later_copies(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its hash stands earlier in its row, and whether it stands there twice or more."""
    if len(rows) == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((np.arange(len(rows)), hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    later, many = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    later[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return later, many


def _measured(body: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The statistics of the texts, by name in the order of STATISTICS."""
    n = len(offsets) - 1
    hashes, rows, starts, ends = _WORDS.words(body, offsets)
    points, symbols = _upto(~_LATER[body]), _upto(_SYMBOL[body])
    per_row = lambda r, weights=None: np.bincount(r, weights, n).astype(np.int64)
    word_chars = per_row(rows, points[ends] - points[starts])
    with np.errstate(over="ignore"):
        window = _text.mix(_text.mix(hashes[:-2], 1) + _text.mix(hashes[1:-1], 2) + _text.mix(hashes[2:], 3)) if len(hashes) > 2 else np.zeros(0, np.uint64)
    whole = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    _, many = _later_copies(rows[whole], window[whole])
    covered = np.zeros(len(rows), bool)
    for shift in range(3):
        covered[whole[many] + shift] = True
    line_hash, line_rows, line_starts, line_ends = _LINES.words(body, offsets)
    inside = _upto(_WORDS.is_word[body])
    worded = inside[line_ends] > inside[line_starts]
    line_rows = line_rows[worded]
    again, _ = _later_copies(line_rows, line_hash[worded])
    return [per_row(rows), word_chars, symbols[offsets[1:]] - symbols[offsets[:-1]], per_row(line_rows[again]), per_row(rows[covered]), per_row(line_rows)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, without the text, with the columns of STATISTICS."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others).schema
    for name in STATISTICS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = _text.utf8_parts(batch.column(batch.schema.get_field_index(text)))
            parts = [_measured(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in _text.chunks(offsets)]
            values = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in others], *values], names=[*others, *STATISTICS])

    return docs.mapInArrow(lean(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _level(rule: tuple) -> Column:
    """The place, from 1, of the first cutoff of the rule's ladder at which a row is rejected; null where none does."""
    top, bottom, factor, above, cutoffs = rule
    value, limit = factor * F.col(top), lambda c: c * F.col(bottom)
    return F.coalesce(*[F.when(value > limit(c) if above else value < limit(c), i) for i, c in enumerate(cutoffs, 1)])


def labelled(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Measured documents with a label: good, and proposes (whether they are of the half that does)."""
    known = labels.where(F.col(quality).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg((F.min(quality) >= 1).alias("good"))
    half = F.md5(F.col(id_col).cast("string")) < F.lit("8")
    return measured.join(known, F.col(id_col) == F.col("_label_id")).withColumn("proposes", half).drop("_label_id")


def path(known: DataFrame, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, level, cutoff, bad, good, place): the steps of each stratum in the order in which they are certified. ``bad`` and ``good`` count what the rule
    rejects up to its cutoff of the proposing half; a rule has no step before it catches a bad document, nor from where good ones prevail. A row for each stratum, rule and cutoff: a summary."""
    names = list(rules)
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), _level(rules[r]).alias("level")) for r in names])
    seen = known.where(F.col("proposes") & ~base_failed()).select("stratum", "good", F.explode(levels).alias("x")).where("x.level IS NOT NULL")
    counts = seen.groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.level").alias("level")).agg(F.count_if(~F.col("good")).alias("_b"), F.count_if("good").alias("_g"))
    ladder = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("level"), F.lit(c).alias("cutoff")) for r in names for i, c in enumerate(rules[r][4], 1)])
    steps = counts.select("stratum").distinct().select("stratum", F.inline(ladder)).join(counts, ["stratum", "rule", "level"], "left").fillna(0, ["_b", "_g"])
    upto = Window.partitionBy("stratum", "rule").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.withColumns({"bad": F.sum("_b").over(upto), "good": F.sum("_g").over(upto)}).where("bad > 0")
    falling = sums.withColumn("_share", F.min(F.col("bad") / (F.col("bad") + F.col("good") + 1)).over(upto))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("_share"), "rule", "level"))
    return falling.where(F.col("_share") >= LEAST_SHARE).select("stratum", "rule", "level", "cutoff", "bad", "good", place.alias("place"))


def _placed(rows: DataFrame, steps: DataFrame, rules: dict) -> DataFrame:
    """rows with place and rule of the first step of their stratum's path that rejects them; null where none does."""
    listed = steps.groupBy("stratum").agg(F.collect_list(F.struct("place", "rule", "level")).alias("_steps"))  # not above the cutoffs of all rules
    if listed.count() <= BROADCAST_ROWS // sum(len(r[4]) for r in rules.values()):
        listed = F.broadcast(listed)
    found = F.create_map(*[x for r in rules for x in (F.lit(r), _level(rules[r]))])
    met = rows.withColumn("_levels", found).join(listed, "stratum", "left")
    # a step rejects what a more lenient cutoff of its rule rejects
    first = F.array_min(F.filter("_steps", lambda s: s["level"] >= F.col("_levels")[s["rule"]]))
    return met.withColumn("_first", first).withColumns({"place": F.col("_first.place"), "failed_rule": F.col("_first.rule")}).drop("_levels", "_steps", "_first")


def _mapped(function, *columns: Column, kind: str) -> Column:
    """A function of one value of each column, over rows of a summary."""
    return F.pandas_udf(lambda *values: pd.Series([function(*row) for row in zip(*values)]), kind)(*columns)


def certify(known: DataFrame, steps: DataFrame, risk: float = RISK, alpha: float = ALPHA, rules: dict = RULES) -> DataFrame:
    """(stratum, place, rule, level, cutoff, n, rejected, bound, passes): for each prefix of a stratum's path the good documents of the holdout, how many of them it
    rejects, the exact upper bound of that share at the stratum's level, and whether this and all shorter prefixes keep the risk. A row for each step."""
    held = _placed(known.where(F.col("good") & ~F.col("proposes") & ~base_failed()), steps, rules).groupBy("stratum", "place").agg(F.count(F.lit(1)).alias("_c"))
    totals = held.groupBy("stratum").agg(F.sum("_c").alias("n"))
    strata = totals.agg(F.count(F.lit(1)).alias("_strata"))  # one row
    upto = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = steps.join(totals, "stratum").join(held, ["stratum", "place"], "left").fillna(0, ["_c"]).withColumn("rejected", F.sum("_c").over(upto)).join(F.broadcast(strata))
    level = F.lit(float(alpha)) / F.col("_strata")
    passed = walked.withColumn("_chance", _mapped(lambda k, n: binomial_at_most(int(k), int(n), risk), F.col("rejected"), F.col("n"), kind="double")).withColumn("_ok", (F.col("_chance") <= level).cast("int"))
    bound = _mapped(lambda k, n, a: binomial_upper(int(k), int(n), a), F.col("rejected"), F.col("n"), level, kind="double")
    return passed.withColumns({"passes": F.min("_ok").over(upto) == 1, "bound": bound}).select("stratum", "place", "rule", "level", "cutoff", "n", "rejected", "bound", "passes")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA, rules: dict = RULES, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", quality: str = "quality") -> tuple[DataFrame, DataFrame]:
    """docs without their text, with STATISTICS, base_failed, failed_rule (of the method; null if none) and kept; and the table of :func:`certify`.

    Texts are measured once; what goes on are a few numbers for each document.
    """
    work, restore = guarded(docs, {id_col: id_col, text: text, stratum: stratum})
    named = work.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("und")))
    measured = stage(measure(named, text), "quality-measured")
    known = stage(labelled(measured.select(id_col, "stratum", *STATISTICS), labels, id_col, quality), "quality-labelled")
    steps = stage(path(known, rules), "quality-path")
    tested = stage(certify(known, steps, risk, alpha, rules), "quality-tests")
    chosen = steps.join(tested.where("passes").select("stratum", "place"), ["stratum", "place"])
    placed = _placed(measured, chosen, rules)
    out = placed.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("place").isNull())
    return restore(out.withColumn(text, F.lit(None).cast("string")), [*STATISTICS, "base_failed", "failed_rule", "kept"]).drop(text), tested


def _level_sql(rule: tuple) -> str:
    top, bottom, factor, above, cutoffs = rule
    return "CASE " + " ".join(f"WHEN {factor} * {top} {'>' if above else '<'} {c} * {bottom} THEN {i}" for i, c in enumerate(cutoffs, 1)) + " END"


_LADDER = ", ".join(f"('{r}', {i})" for r, rule in RULES.items() for i in range(1, len(rule[4]) + 1))
_LEVELS = " UNION ALL ".join(f"SELECT id, stratum, doc_id, base_failed, '{r}' AS rule, {_level_sql(rule)} AS level FROM m" for r, rule in RULES.items())

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w, w1, w2) AS c FROM g WHERE w2 IS NOT NULL) WHERE c >= 2),
rw AS (SELECT id, count(DISTINCT i + s) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS s) GROUP BY 1),
l AS (SELECT id, unnest(string_split(t, chr(10))) AS l FROM d),
ll AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
ww AS (SELECT id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY 1),
m0 AS (SELECT id, doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN ww USING (id) LEFT JOIN ll USING (id) LEFT JOIN rw USING (id)),
m AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m0),
k AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
x AS ({_LEVELS}),
kx AS (SELECT x.*, good, md5(doc_id::VARCHAR) < '8' AS proposes FROM x JOIN k USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, rule, level, count(*) FILTER (WHERE NOT good) AS b, count(*) FILTER (WHERE good) AS g FROM kx WHERE proposes AND level IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT stratum, rule, level, sum(coalesce(b, 0)) OVER o AS bad, sum(coalesce(g, 0)) OVER o AS good FROM (SELECT DISTINCT stratum FROM c) CROSS JOIN (VALUES {_LADDER}) AS ladder(rule, level) LEFT JOIN c USING (stratum, rule, level) WINDOW o AS (PARTITION BY stratum, rule ORDER BY level)),
p AS (SELECT stratum, rule, level, row_number() OVER (PARTITION BY stratum ORDER BY share DESC, rule, level) AS place FROM (SELECT *, min(bad::DOUBLE / (bad::DOUBLE + good::DOUBLE + 1)) OVER (PARTITION BY stratum, rule ORDER BY level) AS share FROM s WHERE bad > 0) WHERE share >= {LEAST_SHARE}),
f AS (SELECT id, min(place) AS place FROM x JOIN p ON x.stratum = p.stratum AND x.rule = p.rule AND p.level >= x.level GROUP BY 1),
h AS (SELECT m.id, m.stratum, place FROM m JOIN k USING (doc_id) LEFT JOIN f USING (id) WHERE good AND md5(doc_id::VARCHAR) >= '8' AND NOT base_failed),
n AS (SELECT stratum, count(*) AS n, count(*) OVER () AS strata FROM h GROUP BY 1),
q AS (SELECT p.stratum, p.place, n, strata, count(h.id) AS rejected FROM p JOIN n USING (stratum) LEFT JOIN h ON h.stratum = p.stratum AND h.place <= p.place GROUP BY 1, 2, 3, 4),
e AS (SELECT stratum, place, rejected >= n AS every, list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {ALPHA} / strata AS ok FROM q),
u AS (SELECT stratum, coalesce(min(place) FILTER (WHERE every OR NOT ok), max(place) + 1) AS first_failing FROM e GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND NOT coalesce(place < first_failing, false) AS kept FROM m LEFT JOIN f USING (id) LEFT JOIN u ON u.stratum = m.stratum
"""
