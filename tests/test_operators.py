"""Operators on tiny frames with expected values worked out by hand."""

import datetime as dt
import inspect
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import expressions as X
from riskweave.operators import aggregates as A
from riskweave.operators import evaluate as E
from riskweave.operators import features as B
from riskweave.operators import filters as L
from riskweave.operators import fusion as U
from riskweave.operators import graph as G
from riskweave.operators import joins as J
from riskweave.operators import labels as LB
from riskweave.operators import models as M
from riskweave.operators import quality as D
from riskweave.operators import ranking as R
from riskweave.operators import scoring as S
from riskweave.operators import splits as SP
from riskweave.operators import stats as T
from riskweave.operators import text_match as TM


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clean_keeps_values_and_drops_unreadable_dates(spark):
    df = frame(spark, [("a", None, None, "2024-01-01"), ("b", -1.0, 0.5, "2024-01-02"), ("c", 11.5, 0.1, "invalid-date"), ("d", 11.5, 0.1, "2024-01-03")], "cve_id string, cvss double, epss_score double, published string")
    got = {r["cve_id"]: (r["cvss"], r["epss_score"]) for r in L.clean(df).collect()}
    assert got == {"a": (11.5, 0.0), "b": (-1.0, 0.5), "d": (11.5, 0.1)}


def test_filters_ignore_absent_columns_and_take_zero(spark):
    df = frame(spark, [("a", 0.0), ("b", 5.0)], "cve_id string, cvss double")
    assert L.select_records(df, max_cvss=0.0, kev_only=True).count() == 1


def test_violations(spark):
    df = frame(spark, [("X-1", 11.0, 2.0, 9, "short"), ("CVE-2024-1234", 5.0, 0.5, 3, "A long enough description")], "cve_id string, cvss double, epss_score double, label int, description string")
    got = {r["cve_id"]: r["violations"] for r in L.violations(df).collect()}
    assert got == {"X-1": ["bad_id", "cvss_range", "epss_range", "label_range", "short_description"], "CVE-2024-1234": []}


def test_coercion(spark):
    train = frame(spark, [("1",), ("x",), ("y",)], "c string")
    a, b = L.coerce_pair(train, frame(spark, [("y",), ("z",), (None,)], "c string"), "c")
    assert sorted(r[0] for r in a.select("c").collect()) == [1.0, 2.0, 3.0] and sorted(r[0] for r in b.select("c").collect()) == [0.0, 0.0, 3.0]


def test_week_keys(spark):
    days = [(dt.datetime(2023, 1, 1),), (dt.datetime(2022, 1, 1),), (dt.datetime(2024, 12, 31),)]
    got = [tuple(r) for r in frame(spark, days, "t timestamp").select(X.sunday_week(F.col("t")), X.monday_week(F.col("t"))).collect()]
    assert [g[0] for g in got] == [d[0].strftime("%Y-%U") for d in days] and got[0][1] == "2022-12-26/2023-01-01"


def test_vendor_heuristics(spark):
    texts = ["acme before 2.1 allows x", "flaw in widget version 3", "Foo has a bug", "Bar 1.2 crash", "the", "", None, "!! x"]
    got = [r[0] for r in frame(spark, [(t,) for t in texts], "d string").select(X.vendor_of(F.col("d"))).collect()]
    assert got == ["acme", "widget", "foo", "bar", "the", "unknown_vendor", "unknown_vendor", "unknown_vendor"]


def test_interval_joins(spark):
    r = frame(spark, [("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], "cve_id string, published timestamp")
    h = frame(spark, [("a", dt.date(2024, 1, 31), 0.4), ("a", dt.date(2024, 2, 1), 0.9), ("b", dt.date(2023, 12, 31), 0.9)], "cve_id string, epss_date date, epss_score double")
    assert [tuple(x) for x in J.best_in_window(r, h, 30).collect()] == [("a", 0.4)]
    e = frame(spark, [("a", dt.date(2024, 1, 31)), ("b", dt.date(2023, 12, 1))], "cve_id string, date_added date")
    got = {x["cve_id"]: (x["within"], x["prior"], x["later"]) for x in J.dated_hit(r, e, 30).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 1, 0)}
    labels = {x["cve_id"]: (x["temporal_label"], x["temporal_confidence"], x["temporal_source"]) for x in LB.forward_label(r.withColumn("cvss", F.lit(5.0)), h, e, 30).collect()}
    assert labels == {"a": (3, 1.0, "kev_within_horizon"), "b": (3, 1.0, "kev_prior")}


def test_vector_parse_and_compatible_form(spark):
    df = frame(spark, [("CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:H/A:H",)], "cvss_vector string")
    assert B.vector_features(df).first()["cvss_c"] == 1.0 and B.vector_features(df, compat=True).first()["cvss_c"] == 3.0


def test_exploitation_rates(spark):
    rows = [("microsoft x", "CWE-787", int(i < 20)) for i in range(30)] + [("cisco y", "CWE-79", int(i < 5)) for i in range(20)] + [("other", "CWE-200", 0) for _ in range(50)]
    vendors, weaknesses = B.historical_risk(frame(spark, rows, "description string, cwe string, kev_flag int"))
    assert {r["vendor"]: round(r["rate"], 6) for r in vendors.collect()} == {"microsoft": round(20 / 30, 6), "cisco": 0.25}
    assert {r["cwe_id"] for r in weaknesses.collect()} == {"CWE-787", "CWE-79", "CWE-200"}


def test_crosstab_has_margins(spark):
    got = {(r["a"], r["b"]): r["n"] for r in A.crosstab(frame(spark, [(1, 0), (1, 1), (2, 0)], "x int, y int"), "x", "y").collect()}
    assert got == {("1", "0"): 1, ("1", "1"): 1, ("2", "0"): 1, ("1", "all"): 2, ("2", "all"): 1, ("all", "0"): 2, ("all", "1"): 1, ("all", "all"): 3}


def scores(spark, labels, values, model="m", group="g"):
    return frame(spark, [(f"k{i}", group, model, float(y), float(s)) for i, (y, s) in enumerate(zip(labels, values))], "cve_id string, week string, model string, label double, score double")


def test_ranking_measures(spark):
    perfect = E.macro(scores(spark, [3, 2, 1, 0], [4, 3, 2, 1]), "week", [4]).first()
    assert perfect["ndcg_4"] == 1.0
    assert E.macro(scores(spark, [3, 2, 1, 0], [1, 2, 3, 4]), "week", [4]).first()["ndcg_4"] < 0.7
    ap = E.macro(scores(spark, [3, 0, 2, 0, 1], [5, 4, 3, 2, 1]), "week", [5]).first()
    assert ap["ap_5"] == pytest.approx(0.833333, abs=1e-6)
    assert E.macro(scores(spark, [0, 0], [2, 1]), "week", [2]).first()["ndcg_2"] == 0.0
    assert E.macro(scores(spark, [3], [1]), "week", [5]).count() == 0
    tied = E.linear_ndcg(scores(spark, [1, 0], [1, 1]), "week", 2).first()["ndcg"]
    assert tied == pytest.approx(0.5 * (1 + 1 / math.log2(3)))


def test_global_rank_is_total_and_dense(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = R.global_rank(df, [F.desc("v"), F.asc("id")], "rank", 5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and got[0]["id"] == 6


def test_splits(spark):
    days = [(f"CVE-{i:04d}", dt.datetime(2018, 1, 1) + dt.timedelta(days=10 * i), i % 4) for i in range(200)]
    df = frame(spark, days, "cve_id string, published timestamp, label int")
    dated = SP.by_date(df, "2022-01-01", 8)
    assert {r["split"] for r in dated.collect()} == {"train", "val", "test"} and not SP.leakage(dated).first()["leaks"]
    assert {r["split"]: r["count"] for r in SP.by_share(df, 0.7, 0.15).groupBy("split").count().collect()} == {"train": 140, "val": 30, "test": 30}
    folds = SP.stratified_folds(df, 5, "label").groupBy("fold", "label").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {10}
    grouped = SP.group_folds(df.withColumn("week", X.month_key(F.col("published"))), 5, "week")
    assert grouped.groupBy("week").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    wide = SP.expanding_folds(df, 3).groupBy("fold", "role").agg(F.min("published").alias("a"), F.max("published").alias("b")).collect()
    by = {(r["fold"], r["role"]): r for r in wide}
    assert all(by[f, "train"]["b"] < by[f, "test"]["a"] for f in (1, 2, 3))


def test_paired_tests(spark):
    rows = [("a", "b", 1.0 + i, 0.5 + i * 0.9) for i in range(12)]
    pairs = frame(spark, rows, "model_a string, model_b string, a double, b double")
    w = T.wilcoxon(pairs, ["model_a", "model_b"]).first()
    assert w["n"] == 12 and w["w"] == 0 and w["p"] < 0.01
    assert T.wilcoxon(pairs.limit(3), ["model_a", "model_b"]).first()["p"] == 1.0
    tests = frame(spark, [("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    holm = {r["name"]: round(r["p_holm"], 6) for r in T.holm(tests, 0.05, "name").collect()}
    assert holm == {"x": 0.03, "z": 0.06, "y": 0.06}
    v = frame(spark, [("a", 3.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)], "m string, v double")
    assert T.cliffs_delta(v, F.col("m") == "a", "v").first()["delta"] == 0.75


def test_fusion(spark):
    s = frame(spark, [("x", "a", 3.0), ("y", "a", 2.0), ("x", "b", 1.0), ("y", "b", 5.0)], "cve_id string, model string, score double")
    assert {r["cve_id"]: r["score"] for r in U.borda(s).collect()} == {"x": 3, "y": 3}
    assert {r["cve_id"]: round(r["score"], 9) for r in U.reciprocal_rank(s).collect()} == {k: round(1 / 61 + 1 / 62, 9) for k in "xy"}
    weights = U.fitted_weights(s.withColumn("label", F.when(F.col("cve_id") == "x", 1).otherwise(0)))
    assert {r["model"]: round(r["weight"], 6) for r in weights.collect()} == {"a": 1.0, "b": 0.0}


def test_walks(spark):
    edges = frame(spark, [("A", "B", 2.0), ("B", "C", 1.0)], "src string, dst string, weight double")
    r = {x["id"]: x["score"] for x in G.diffusion(edges, frame(spark, [("A", 1.0)], "id string, score double")).collect()}
    assert r["A"] > r["C"] and abs(sum(r.values()) - 1) < 1e-5
    none = G.diffusion(edges, frame(spark, [("Z", 1.0)], "id string, score double"))
    assert abs(sum(x["score"] for x in none.collect()) - 1) < 1e-5
    seeds = frame(spark, [("s", "A", 1.0), ("t", "C", 1.0)], "walk string, id string, score double")
    both = {(x["walk"], x["id"]): x["score"] for x in G.diffusion(edges, seeds, batch="walk").collect()}
    assert both["s", "A"] == pytest.approx(r["A"], abs=1e-4) and both["t", "C"] > both["t", "A"]


def test_health_texts(spark):
    texts = ["Epic EHR flaw in patient portal", "Philips medical MRI scanner", "WordPress XSS", "PACS buffer overflow", "epicenter of history"]
    got = [(r["matched_vendor"], r["health_flag"]) for r in TM.health_score(frame(spark, [(t,) for t in texts], "description string")).collect()]
    assert got == [("epic", 1), ("philips", 1), (None, 0), (None, 1), (None, 0)]


def test_fuzzy_runs(spark):
    t = frame(spark, [("ab",), ("a b",), ("abc",)], "t string")
    assert [r[0] for r in t.select(TM.char_grams(F.col("t"))).collect()] == [[" ab", "ab ", " ab "], [" a ", " b "], [" ab", "abc", "bc ", " abc", "abc ", " abc "]]
    terms = frame(spark, [("infusion pump",), ("router",)], "term string")
    got = {r["k"]: r["best"] for r in TM.fuzzy_scores(frame(spark, [(1, "infusion pump"), (2, "zzz"), (3, "router x")], "k int, d string"), "k", "d", terms).collect()}
    assert got[1] == pytest.approx(1.0) and 2 not in got and got[3] > 0.9


def test_contributions_add_up(spark):
    df = frame(spark, [("a", 1.0, 0.5), ("b", 0.0, 0.1)], "cve_id string, kev_flag double, epss_score double")
    w = {"kev_flag": 0.6, "epss_score": 0.4}
    got = {(r["cve_id"], r["feature"]): r["contribution"] for r in S.contributions(df, w).collect()}
    assert got["a", "kev_flag"] == pytest.approx(0.3) and got["b", "epss_score"] == pytest.approx(-0.08)


def test_quality_reports(spark):
    df = frame(spark, [("CVE-2024-0001", 5.0, dt.datetime(2024, 1, 1), "x" * 60), ("CVE-2024-0001", None, None, ""), ("bad", 12.0, dt.datetime(2030, 1, 1), "short")], "cve_id string, cvss double, published timestamp, description string")
    got = {r["issue"]: r["n"] for r in D.record_issues(df, "2024-06-01").collect()}
    assert got == {"repeated_id": 1, "bad_id": 1, "missing_cvss": 1, "bad_cvss": 1, "missing_date": 1, "future_date": 1, "older_than_two_years": 0, "empty_description": 1, "short_description": 1}
    assert D.contract({"cves": df}, {"cves": ["cve_id", "cwe"], "log": []}) == [("log", ""), ("cves", "cwe")]


def test_pairwise_ranker_beats_one_feature(spark):
    k = spark.range(400).withColumn("a", (F.col("id") * 37 % 101) / 101).withColumn("b", (F.col("id") * 53 % 97) / 97)
    rows = k.select(F.col("id").cast("string").alias("cve_id"), (F.col("id") % 8).cast("string").alias("week"), F.floor(2 * F.col("a") + 2 * F.col("b")).alias("label"), "a", "b")
    train = M.training_rows(rows, ["a", "b"])
    weights = M.fit_pairwise(train, ["a", "b"])
    assert all(r["weight"] > 0 for r in weights.collect())
    assert M.quality(M.linear_scores(train, weights)) > M.quality(train.withColumn("score", F.col("a")))


def test_trees_are_saved_with_their_card(spark, tmp_path):
    rows = M.training_rows(spark.range(60).select(F.col("id").cast("string").alias("cve_id"), F.lit("w").alias("week"), (F.col("id") % 3).alias("label"), (F.col("id") % 3).cast("double").alias("x")), ["x"])
    model = M.fit_trees(rows, ["x"], depth=2, rounds=3)
    M.save(model, str(tmp_path), ["x"], {"ndcg": 1.0}, 60)
    assert M.scored(M.load(str(tmp_path)), rows).count() == 60 and spark.read.json(f"{tmp_path}/card").first()["n_train"] == 60


def test_terms_of_any_length_and_signs_match_whole_words(spark):
    texts = frame(spark, [(1, "A flaw: remote code execution in the wild over HTTP/2."), (2, "remote, code; execution"), (3, "remote-code execution"), (4, None), (5, "C++ parser")], "k int, t string")
    terms = ["remote code execution in the wild over http 2", "remote code execution", "c++ parser", "http/2", "()"]
    for broadcast_rows in (2000, 0):
        got = {(r["k"], r["term"]) for r in J.matches(texts, "k", F.col("t"), frame(spark, [(t,) for t in terms], "term string"), broadcast_rows).collect()}
        assert got == {(1, terms[0]), (1, terms[1]), (1, terms[3]), (2, terms[1]), (5, terms[2])}
    assert J.matches(texts, "k", F.col("t"), frame(spark, [], "term string")).count() == 0


def test_terms_in_texts_of_many_words_take_linear_time(spark):
    """100,000 words of which a term's first word is every second: minutes where a text is split again for each of them."""
    text = "flaw in " * 50_000 + "remote code execution"
    texts, terms = frame(spark, [(1, text), (2, "none")], "k int, t string"), frame(spark, [("flaw here",), ("in flaw",), ("remote code execution",)], "term string")
    start = time.perf_counter()
    assert {(r["k"], r["term"]) for r in J.matches(texts, "k", F.col("t"), terms).collect()} == {(1, "in flaw"), (1, "remote code execution")}
    assert time.perf_counter() - start < 60


def test_codes_of_a_large_category_are_joined_without_broadcast(spark):
    table = frame(spark, [(f"{i:04d}", 1) for i in range(300)], "c string, n int")
    plan = lambda small: table.join(small, "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(J.checked(table.select("c"))) and "broadcast" not in plan(J.checked(table.select("c"), most_rows=299))
    assert "broadcast" not in plan(J.checked(table.select("c"), most_bytes=100))


def test_sums_before_cross_ranges_and_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") % 5).alias("n"))
    want, upto = {}, {}
    for i in range(500):
        want[i] = upto.get(i % 3, 0)
        upto[i % 3] = want[i] + i % 5
    assert {r["v"]: r["s"] for r in R.sums_before(df, ["g"], [F.asc("v")], {"s": "n"}).collect()} == want
    whole = {r["v"]: r["s"] for r in R.sums_before(df, [], [F.desc("v")], {"s": "n"}).collect()}
    assert whole[499] == 0 and whole[0] == sum(i % 5 for i in range(1, 500))


def test_best_then_fill_takes_missing_scores_last(spark):
    df = frame(spark, [("a", "x", 1.0), ("b", "x", None), ("c", "y", 0.1), ("d", "x", 0.9), ("e", "z", None)], "k string, g string, s double")
    assert [r["k"] for r in R.best_then_fill(df, "g", "s", "k", 4).collect()] == ["a", "c", "e", "d"]


def test_preference_pairs_are_the_same_however_they_are_dealt(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").cast("string").alias("cve_id"), F.lit("w").alias("week"), (F.col("id") % 3).alias("label"), F.col("id").cast("double").alias("x"))
    train = M.training_rows(rows, ["x"])
    pairs = lambda: sorted((r["first"], r["x"]) for r in M.preference_pairs(train, ["x"], 4).collect())
    whole = pairs()
    monkeypatch.setattr(M, "BLOCK", 7)
    assert pairs() == whole and len(whole) > 100


def test_catalogue_in_two_stages_and_technique_names(spark):
    texts = frame(spark, [("a", "Epic Systems portal and Acme Health viewer"), ("b", "the viewer pro of a vendor"), ("c", "reviewer process"), ("d", None)], "k string, t string")
    vendors = frame(spark, [("Acme Health", 1), ("epic systems", 2), ("epic", 3)], "name string, priority int")
    products = frame(spark, [("viewer pro", 1), ("viewer", 2), ("portal", 3)], "name string, priority int")
    got = {r["k"]: (r["flag"], r["matched"]) for r in TM.catalogue_match(texts, "k", "t", vendors, products).collect()}
    assert got == {"a": (1, ["vendor:acme health", "vendor:epic systems"]), "b": (1, ["product:viewer pro", "product:viewer"]), "c": (0, []), "d": (0, [])}
    hits = frame(spark, [("a", ["T1", "T9"], 2)], "k string, ids array<string>, n int")
    named = TM.technique_info(hits, frame(spark, [("T1", "One")], "technique string, name string")).first()
    assert named["ids"] == ["T1", "T9"] and named["names"] == ["One"]


def test_cutoff_split_slices_and_intervals(spark):
    days = [(f"CVE-{i:04d}", dt.datetime(2018, 1, 1) + dt.timedelta(days=i)) for i in range(100)]
    df = frame(spark, days, "cve_id string, published timestamp")
    got = {r["split"]: r["count"] for r in SP.by_cutoff(df, "2018-03-01").groupBy("split").count().collect()}
    assert got == {"train": 51, "val": 9, "test": 40}
    s = frame(spark, [(f"r{i}", "m", float(i), int(i >= 8), i % 2) for i in range(10)], "cve_id string, model string, score double, label int, side int")
    table = {r["slice"]: r for r in E.slice_metrics(s, {"all": F.lit(True), "odd": F.col("side") == 1}, [2]).collect()}
    assert table["all"]["ndcg_2"] == 1.0 and table["all"]["relevant"] == 2 and table["odd"]["precision_2"] == 0.5
    assert {r["k"]: r["precision"] for r in E.precision_at(s, [1, 4], 1).collect()} == {1: 1.0, 4: 0.5}
    ends = T.interval(SP.bootstrap(s, 50), "label").first()
    assert ends["low"] < ends["mean"] < ends["high"] and abs(ends["mean"] - 0.2) < 0.1


def test_bootstrap_ensemble_flags_a_tenth(spark):
    rows = [(f"r{i:02d}", m, float((i * p) % 17), i % 4) for i in range(40) for m, p in (("a", 3), ("b", 5))]
    out = U.bootstrap_ensemble(frame(spark, rows, "cve_id string, model string, score double, label int"), 6).collect()
    assert len(out) == 40 and sum(r["uncertain"] for r in out) == 4 and all(r["deviation"] >= 0 for r in out)


def test_similar_leaves_out_what_is_no_vector(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [])], "id int, v array<double>")
    assert {(r["src"], r["dst"]) for r in G.similar(v, "id", "v", 3, 0.5).collect()} == {(1, 2), (2, 1)}


def test_similar_compares_all_pairs_of_few_and_of_many_hits(spark, monkeypatch):
    from riskweave.operators import similarity

    monkeypatch.setattr(similarity, "PROBED", 64)
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((500, 16)), np.ones((300, 16)) + 0.1 * r.standard_normal((300, 16))])  # in one part hardly a pair is similar, in the other all are
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    cosine = np.round(unit @ unit.T, 9)
    np.fill_diagonal(cosine, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -cosine[i]))[:5] if cosine[i, j] >= 0.5}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    for block, parts in ((200, 24), (16384, 24), (16384, 1)):
        got = G.similar(df, "id", "e", 5, 0.5, block, parts).collect()
        assert len(got) == len(want) and {(q["src"], q["dst"]) for q in got} == want
    assert inspect.signature(G.similar).parameters["block"].default >= 16384  # rows are sent once for each block, so that blocks are large


def test_similar_sends_a_row_once_for_each_block(spark):
    df = spark.range(4000).select("id", F.array(F.sin("id"), F.cos("id")).alias("e"))
    assert G.similar(df.where("id < 0"), "id", "e").count() == 0
    dealt = G.similar(df, "id", "e", 3, 0.9, 1000)._jdf.queryExecution().toString()
    assert "collect_list" not in dealt  # no block is one row of the shuffle


def test_texts_are_dealt_by_size(spark):
    texts = spark.createDataFrame([(i, "é" * 50) for i in range(100)] + [(100, None)], "doc_id long, text string")
    dealt = X.dealt_by_size(texts, "doc_id", "text", 1000)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 101
    assert X.dealt_by_size(texts.limit(0), "doc_id", "text").count() == 0
