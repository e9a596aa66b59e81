"""Substring and similarity joins: equal to all pairs, and how many rows they meet."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import expressions as X
from riskweave.operators import text_match as TM
from riskweave.operators.joins import matches


def corpus(n=400, seed=3):
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfgklmnprstv" for b in "aeiou"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(2, 4)))
    common = ["system", "remote", "attacker", "version"]
    terms = [" ".join([r.choice(common), word(), word()]) for _ in range(150)]
    texts = []
    for i in range(n):
        words = [word() if r.random() < 0.6 else r.choice(common) for _ in range(r.randrange(3, 12))]
        kind = r.random()
        if kind < 0.2:
            words.insert(1, "xx" + r.choice(terms).upper() + "yy")
        elif kind < 0.5:
            words = r.choice(terms).split() + words[: r.randrange(2)]
        texts.append((i, " ".join(words)))
    return [*texts, (1000, None), (1001, ""), (1002, "x" * 50_000 + terms[0])], terms


@pytest.mark.parametrize("most", [0, 200_000])
def test_anchors_find_what_stands_anywhere(spark, monkeypatch, most):
    monkeypatch.setattr(TM, "BROADCAST_RUNS", most)
    texts, terms = corpus()
    terms = [*terms, "abc", "System", terms[0]]
    df, t = spark.createDataFrame(texts, "k int, d string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = sorted((r["k"], r["term"]) for r in TM.contained(df, "k", "d", t).collect())
    assert got == sorted((k, x) for k, d in texts for x in terms if len(x) >= 4 and x.lower() in (d or "").lower())
    wanted = TM.anchored(df, "k", "d", t)
    passed = TM._passing(df, "k", "d", wanted.select("_g").distinct(), 4).count()
    every = df.select(F.explode(TM._grams(F.lower(F.coalesce("d", F.lit(""))), 4))).count()
    first = df.select(F.explode(TM._grams(F.lower(F.coalesce("d", F.lit(""))), 4)).alias("g")).join(t.select(F.substring(F.lower("term"), 1, 4).alias("g")), "g").count()
    assert passed < every / 4 and TM._passing(df, "k", "d", wanted.select("_g").distinct(), 4).join(wanted, "_g").count() < first / 4
    assert TM.contained(df, "k", "d", t.limit(0)).count() == 0 and TM.contained(df.limit(0), "k", "d", t).count() == 0


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_texts_of_one_key_count_as_one(spark, monkeypatch, most):
    """Scores and matches by matrix and by joins agree: repeated, missing and empty keys and texts, odd blanks, blocks of few keys."""
    texts, terms = corpus()
    rows = [(k if k % 9 else 0, d) for k, d in texts if k < 100 or k in (1000, 1001)] + [(None, terms[0]), (7, "\t" + terms[1] + "\u00a0x\n"), (8, "İstanbul ΣΑΣ"), (5000, terms[2] * 50)]
    df, t = spark.createDataFrame(rows, "k int, d string"), spark.createDataFrame([(x,) for x in terms], "term string")
    monkeypatch.setattr(TM, "MATRIX", 0)
    want = {(r["k"], r["term"]): r["cosine"] for r in TM.fuzzy_matches(df, "k", "d", t, 0.4).collect()}
    best = {r["k"]: r["best"] for r in TM.fuzzy_scores(df, "k", "d", t).collect()}
    monkeypatch.setattr(TM, "MATRIX", most)
    plan = TM.fuzzy_scores(df, "k", "d", t)
    assert ("Generate" not in plan._jdf.queryExecution().toString()) == bool(most)  # no text is dealt out in runs
    got, mine = {(r["k"], r["term"]): r["cosine"] for r in TM.fuzzy_matches(df, "k", "d", t, 0.4).collect()}, {r["k"]: r["best"] for r in plan.collect()}
    assert got.keys() == want.keys() and mine.keys() == best.keys()
    assert all(abs(got[p] - c) < 1e-9 for p, c in want.items()) and all(abs(mine[k] - b) < 1e-9 for k, b in best.items())
    assert TM.fuzzy_scores(df, "k", "d", t.limit(0)).count() == 0 and TM.fuzzy_scores(df.limit(0), "k", "d", t).count() == 0


def test_runs_are_looked_up_where_texts_are_read(spark):
    texts, terms = corpus()
    texts = [*texts[:150], (2000, terms[3].upper().replace(" ", " ,\n") + "; " + terms[4] + "s")]
    df = spark.createDataFrame(texts, "k int, d string")
    t = spark.createDataFrame([*[(x, i) for i, x in enumerate(terms)], ("version", 900), ("VERSION", 901), ("--", 902), ("?!", 903)], "term string, n int")
    hits = lambda most: sorted((r["k"], r["term"], r["n"]) for r in matches(df, "k", F.col("d"), t, most).collect())
    assert hits(200_000) == hits(0) and len(hits(0)) > 50
    assert "Generate" not in matches(df, "k", F.col("d"), t)._jdf.queryExecution().toString()
    assert "Generate" not in TM.contained(df, "k", "d", t)._jdf.queryExecution().toString()


def test_terms_are_searched_before_patterns(spark):
    """Tests of several terms agree with one pattern of all, and terms are searched for plainly first."""
    terms = ["ge healthcare", "c++", "pump", "a.b", "x-ray"]
    texts = ["", None, "ge  healthcare", "ge\nhealthcare x", "gehealthcare", "pumps", "a pump.", "axb", "a.b", "c++ x", "xc++x", "x-rays x-ray", "healthcare"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, d string")
    d, words, anywhere = F.col("d"), "|".join(X.word_pattern(t) for t in terms), "|".join(map(re.escape, terms))
    out = df.select("k", X.contains_words(d, terms).alias("w"), d.rlike(words).alias("w2"), X.contains_any(d, terms).alias("a"), d.rlike(anywhere).alias("a2"), X.contains_any(d, []).alias("e"))
    assert all(r["w"] == r["w2"] and r["a"] == r["a2"] and r["e"] in (True, None) for r in out.collect())
    plan = df.select(X.contains_any(d, terms))._jdf.queryExecution().toString()
    assert "RLIKE" not in plan.upper() and "Contains" in plan


def test_similarity_join_meets_few_pairs(spark):
    texts, terms = corpus()
    df, t = spark.createDataFrame(texts, "k int, d string"), spark.createDataFrame([(x,) for x in terms], "term string")
    words, vectors = (x.collect() for x in TM._weighted(df, "k", "d", t))
    w = {}
    for r in words:
        w.setdefault(r["term"], {})[r["g"]] = r["w"]
    v = {}
    for r in vectors:
        v.setdefault(r["k"], {})[r["g"]] = r["v"]
    cosine = {(k, x): sum(a * w[x].get(g, 0.0) for g, a in grams.items()) for k, grams in v.items() for x in w}
    want = {p: c for p, c in cosine.items() if round(c, 9) >= 0.6}
    got = {(r["k"], r["term"]): r["cosine"] for r in TM.fuzzy_matches(df, "k", "d", t).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - c) < 1e-9 for p, c in want.items()) and len(want) > 50
    best = {r["k"]: r["best"] for r in TM.fuzzy_scores(df, "k", "d", t).collect()}
    assert {k for k, b in best.items() if round(b, 9) >= 0.6} == {k for k, _ in got}
    met = TM.fuzzy_candidates(df, "k", "d", t)[0].count()
    assert met <= sum(c > 0 for c in cosine.values()) / 10
