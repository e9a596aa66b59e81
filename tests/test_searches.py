"""Searches over many rankers at once, each against NumPy over the same pairs."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.expressions import hash_bucket
from riskweave.operators import models as M
from riskweave.operators import searches
from riskweave.operators.splits import bootstrap
from tests.test_mechanisms import FEATURES, ROWS, ndcg, planted


def plain_fit(pairs, times, setting, rounds, w=None, done=0):
    """Weights after the stated steps; pairs: (first, pair_weight, x) with how often each counts."""
    w = np.zeros(3) if w is None else np.array(w)
    kept = [(f, p * t, x) for (f, p, x), t in zip(pairs, times) if t]
    if not kept:
        return w
    first, pull, x = np.array([k[0] for k in kept]), np.array([k[1] for k in kept]), np.array([k[2] for k in kept])
    for i in range(done, done + rounds):
        won = 1 / (1 + np.exp(-x @ w))
        g, h = (pull * (won - first)) @ x / pull.sum(), (pull * won * (1 - won)) @ (x * x) / pull.sum()
        move = setting["step"] * setting["decay"] ** i * (g + setting["regular"] * w) / (h + 0.1 * h.mean() + setting["regular"])
        w = w - np.clip(move, -1, 1)
    return w


@pytest.fixture(scope="module")
def planted_rows(spark):
    rows = planted(500, 9, 21)
    rows = [(r[0], "g0" if int(r[0][1:]) % 3 == 0 else r[1], *r[2:]) for r in rows]  # one group holds more than a third
    return rows, spark.createDataFrame(rows, ROWS).repartition(3)


def pairs_of(df, per_row=4):
    found = M.preference_pairs(df, FEATURES, per_row).collect()
    return [r["group"] for r in found], [(r["first"], r["pair_weight"], [r[c] for c in FEATURES]) for r in found]


def scores_of(rows, w):
    return {r[0]: float(np.dot(w, r[4:])) for r in rows}


def test_grid_equals_fits_one_by_one(planted_rows):
    rows, df = planted_rows
    options = {"step": [0.2, 0.7], "regular": [0.01, 0.5], "decay": [1.0, 0.8]}
    got = {r["params"]: (r["rounds"], r["ndcg"]) for r in searches.grid(df, FEATURES, options, folds=3, rounds=5, every=2, k=10).collect()}
    groups, pairs = pairs_of(df)
    fold = {r["group"]: r["f"] for r in df.select("group", hash_bucket("group", 3).alias("f")).distinct().collect()}
    assert set(fold.values()) == {0, 1, 2} and len(got) == 8
    for step, regular, decay in itertools.product(*options.values()):
        setting, best = {"step": step, "regular": regular, "decay": decay}, (0, -1.0)
        for rounds in (2, 4, 5):
            fits = [plain_fit(pairs, [fold[g] != f for g in groups], setting, rounds) for f in range(3)]
            value = sum(ndcg([r for r in rows if fold[r[1]] == f], scores_of(rows, w)) for f, w in enumerate(fits)) / 3
            if value > best[1] + 1e-9:
                best = (rounds, value)
        found = got[f"step={step:g}, regular={regular:g}, decay={decay:g}"]
        assert found[0] == best[0] and found[1] == pytest.approx(best[1], abs=1e-6)


def test_steps_go_on_where_they_stopped(planted_rows):
    _, df = planted_rows
    pairs = M.preference_pairs(df, FEATURES, 4)
    members = F.array(F.struct(F.lit(0).alias("model"), F.lit(1.0).alias("times")))
    setting = {"step": 0.4, "regular": 0.01, "decay": 0.9}
    some = searches.fit_many(pairs, FEATURES, members, [setting, setting], 2)
    more = searches.fit_many(pairs, FEATURES, members, [setting, setting], 2, some, 2)
    whole = plain_fit(pairs_of(df)[1], itertools.repeat(1), setting, 4)
    assert np.allclose(more[0], whole, rtol=1e-9) and more[1] == [0.0, 0.0, 0.0]  # nothing teaches the second


def test_ensemble_counts_groups_as_often_as_drawn(planted_rows):
    rows, df = planted_rows
    groups, pairs = pairs_of(df)
    drawn = collections.defaultdict(dict)
    for r in bootstrap(df.select("group").distinct(), 4, "group").collect():
        drawn[r["replica"]][r["group"]] = r["times"]
    each = [scores_of(rows, plain_fit(pairs, [drawn[i].get(g, 0) for g in groups], searches.PLAIN, 6)) for i in range(4)]
    odd = df.limit(1).select(F.lit("empty").alias("cve_id"), *[F.lit(None).cast("double").alias(c) for c in FEATURES])
    got = {r["cve_id"]: r for r in searches.ensemble(df, df.select("cve_id", *FEATURES).unionByName(odd), FEATURES, 4, rounds=6).collect()}
    assert len(got) == len(rows) + 1 and (got["empty"]["mean"], got["empty"]["deviation"]) == (0.0, 0.0)
    for i in each[0]:
        values = [s[i] for s in each]
        assert got[i]["mean"] == pytest.approx(np.mean(values), abs=1e-9) and got[i]["deviation"] == pytest.approx(np.std(values), abs=1e-9)


def test_runs_are_fits_of_samples(planted_rows):
    rows, df = planted_rows
    groups, pairs = pairs_of(df)
    got = {(r["run"], r["feature"]): r["importance"] for r in searches.importance_runs(df, FEATURES, (0.0, 0.5, 1.0), ("a", "b"), rounds=4).collect()}
    assert len(got) == 3 * 2 * 3
    for share, seed in itertools.product((0.0, 0.5, 1.0), ("a", "b")):
        place = {r["group"]: r["u"] for r in df.select("group", hash_bucket("group", 1_000_000, seed).alias("u")).distinct().collect()}
        inside = {g for g, u in place.items() if u < share * 1_000_000}
        w = plain_fit(pairs, [g in inside for g in groups], searches.PLAIN, 4)
        kept = [r for r in rows if r[1] in inside]
        for i, c in enumerate(FEATURES):
            want = np.mean([abs(r[4 + i] * w[i]) for r in kept]) if kept else 0.0
            assert got[f"{share}/{seed}", c] == pytest.approx(want, abs=1e-9)


def test_searches_of_nothing_and_unknown_options(spark):
    none = spark.createDataFrame([], ROWS)
    got = searches.grid(none, FEATURES, {"step": [0.1, 0.2]}, rounds=2).collect()
    assert [r["ndcg"] for r in got] == [0.0, 0.0]
    assert searches.ensemble(none, none, FEATURES, 2, rounds=1).count() == 0
    assert {r["importance"] for r in searches.importance_runs(none, FEATURES, (0.5,), ("a",), rounds=1).collect()} == {0.0}
    with pytest.raises(ValueError):
        searches.grid(none, FEATURES, {"leaves": [20.0]})


def test_models_add_no_shuffle_of_pairs(spark, planted_rows):
    """What is exchanged is one row for each model and task, however many models learn from a pair."""
    _, df = planted_rows
    pairs = M.stage(M.preference_pairs(df, FEATURES, 4), "plan-pairs")
    members = F.transform(searches._each(27), lambda m: searches._member(m, F.lit(1.0)))
    weights = [[0.0] * 3] * 27
    dealt = searches._weighed(pairs.select("first", *FEATURES, F.explode(members).alias("m")).select("first", *FEATURES, "m.model"), FEATURES, weights, "_margin").groupBy("model").agg(F.sum("_margin"))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(model") == 1 and "SortMergeJoin" not in plan


def test_models_meet_pairs_as_matrices_and_judges_see_first_rows(spark, planted_rows):
    """A round deals no pair out to models one by one, and a look at the grid sorts at most k rows for each group, model and batch."""
    rows, df = planted_rows
    packs = searches.packed(M.preference_pairs(df, FEATURES, 4), FEATURES, F.transform(searches._each(3), lambda m: searches._member(m, F.lit(1.0))), 3)
    found = searches.sums(packs, [[0.1, 0.2, -0.3]] * 27, 3)
    _, pairs = pairs_of(df)
    assert sorted(found) == list(range(27)) and found[5][0] == pytest.approx(sum(p for _, p, _ in pairs), rel=1e-12)
    g = sum(p * (1 / (1 + np.exp(-np.dot(x, [0.1, 0.2, -0.3]))) - f) * np.array(x) for f, p, x in pairs)
    assert np.allclose(found[26][1], g, rtol=1e-9)
    one = df.withColumn("_fold", F.lit(0)).coalesce(1).sortWithinPartitions("group")
    got = searches.firsts(one, FEATURES, [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0]], 1, 5).collect()
    groups = {r[1] for r in rows}
    assert len(got) == 2 * 5 * len(groups)
    for group in groups:
        inside = [r for r in rows if r[1] == group]
        assert {r["cve_id"] for r in got if r["week"] == group and r["model"] == 0} == {r[0] for r in sorted(inside, key=lambda r: (-r[4], r[0]))[:5]}
        assert {r["cve_id"] for r in got if r["week"] == group and r["model"] == 1} == {r[0] for r in sorted(inside)[:5]}  # all scores are equal
