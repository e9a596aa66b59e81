"""Approximate similarity, listwise ranking, quantiles, metrics of hot groups, exact tails, hops, sliding budgets, model searches: each against a plain computation."""

import collections
import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import tails
from riskweave.operators import evaluate as E
from riskweave.operators import graph as G
from riskweave.operators import listwise, pairwise, quantiles, similarity
from riskweave.operators import models as M
from riskweave.operators import stats as T
from riskweave.streaming import jobs


def test_approximate_graph_finds_nearly_all_neighbours(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((300, 24))
    x = centres[r.integers(0, 300, 3000)] + 0.7 * r.standard_normal((3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(1500)]  # a third of all rows are one vector
    odd = [(9000, None), (9001, [float("nan")] * 24), (9002, [0.0] * 24), (9003, []), (9004, [1.0, None]), (9005, [1.0, 2.0]), (9006, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "id long, e array<double>").repartition(4)
    got = {(q["src"], q["dst"]): q["weight"] for q in similarity.approximate(df, "id", "e", per_bucket=64).collect()}
    want = {(q["src"], q["dst"]): q["weight"] for q in G.similar(df, "id", "e").collect()}
    shared = got.keys() & want.keys()
    assert len(shared) >= 0.9 * len(want) and all(got[p] == want[p] for p in shared)
    copies = {p for p in want if p[0] >= 5000 and p[0] < 9000}
    assert copies <= got.keys() and (9005, 9006) in got and max(collections.Counter(p[0] for p in got).values()) <= 10
    assert similarity.approximate(df.limit(0), "id", "e").count() == 0


def test_rows_look_only_where_their_balls_reach(spark):
    r = np.random.default_rng(4)
    x = np.round(np.column_stack([r.standard_normal((4000, 3)), 3.0 * (r.random(4000) < 0.1), np.ones(4000)]), 3)  # few dimensions, one of them with two values
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    got = {(q["src"], q["dst"]): q["weight"] for q in similarity.approximate(df, "id", "e", per_bucket=64).collect()}
    assert got == {(q["src"], q["dst"]): q["weight"] for q in G.similar(df, "id", "e").collect()}  # all of them, as all balls are small
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    tree = similarity.grown(unit, 6, 7, 0)
    cosine = unit @ unit.T
    tenth = np.sort(cosine, axis=1)[:, -11]
    row, leaf, more = similarity.reached(tree, unit, 2 - 2 * tenth + similarity.SLACK, 24)
    touched, own = set(zip(row.tolist(), leaf.tolist())), similarity.leaves(tree, unit)
    assert len(row) < 12 * 4000 and more.mean() < 0.05  # where each row was sent 72 times
    assert all((int(i), int(own[j])) in touched for i, j in zip(*np.nonzero(cosine >= tenth[:, None])) if not more[i])


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    r = np.random.default_rng(2)
    x = np.ones(8) + 0.01 * r.standard_normal((400, 8))  # all in one bucket or two
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    got = {(q["src"], q["dst"]) for q in similarity.approximate(df, "id", "e", k=5, per_bucket=400).collect()}
    want = {(q["src"], q["dst"]) for q in G.similar(df, "id", "e", 5).collect()}
    assert len(got & want) >= 0.95 * len(want)


FEATURES = ["x", "y", "z"]


def planted(n=1200, groups=12, seed=4):
    """Labels follow x among the best rows, and y (misleading there) among the others."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, z = (r.gauss(0, 1) for _ in range(3))
        good = 2 * x + 0.3 * r.gauss(0, 1)
        label = 4 if good > 3 else 3 if good > 2.2 else 1 if y > 0 and good < 0.5 else 0
        out.append((f"c{i:05d}", f"g{r.randrange(groups)}", float(label), r.choice([0.5, 1.0]), x, y, z))
    return out


ROWS = "cve_id string, group string, label double, weight double, x double, y double, z double"


def one_round(rows, weights, k, near):
    grad, hess = np.zeros(3), np.zeros(3)
    for _, members in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        m = sorted(members, key=lambda r: (-float(np.dot(weights, r[4:])), r[0]))
        ideal = sum((2**v - 1) / math.log2(i + 2) for i, v in enumerate(sorted((r[2] for r in m), reverse=True)[:k]))
        if not ideal:
            continue
        d = [1 / math.log2(i + 2) if i < k else 0.0 for i in range(len(m))]
        for i, a in enumerate(m):
            for j in range(i + 1, min(len(m), i + near + 1)):
                b = m[j]
                if a[2] == b[2]:
                    continue
                sign, x = (1 if a[2] > b[2] else -1), np.array(a[4:]) - np.array(b[4:])
                wrong = 1 / (1 + math.exp(sign * float(np.dot(weights, x))))
                pull = (a[3] + b[3]) / 2 * abs((2 ** a[2] - 2 ** b[2]) * (d[i] - d[j])) / ideal
                grad -= pull * wrong * sign * x
                hess += pull * wrong * (1 - wrong) * x * x
    return grad, hess


def test_listwise_round_equals_numpy_and_beats_pairs(spark, monkeypatch):
    monkeypatch.setattr(listwise, "BLOCK", 64)
    rows = planted()
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    ready = listwise.prepared(df, FEATURES, 10)
    weights = {"x": 0.3, "y": 0.2, "z": -0.1}
    grad, hess = listwise.gradient(ready, weights, 10, 7)
    want = one_round(rows, [0.3, 0.2, -0.1], 10, 7)
    assert np.allclose([grad[c] for c in FEATURES], want[0], rtol=1e-9) and np.allclose([hess[c] for c in FEATURES], want[1], rtol=1e-9)
    fitted = M.quality(M.linear_scores(df, listwise.fit(df, FEATURES, rounds=8, near=20)), 10)
    pairwise = M.quality(M.linear_scores(df, M.fit_pairwise(df, FEATURES, rounds=20)), 10)
    assert fitted > pairwise


def test_quantiles_of_many_distinct_values(spark):
    df = spark.range(1_000_000).select((F.xxhash64("id") / 1e9).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).cast("double").alias("b"), F.exp(F.xxhash64("id", F.lit(1)) / 1e17).alias("c"), F.lit(None).cast("double").alias("d"))
    shares = [0.0, 0.05, 0.5, 0.733, 0.95, 1.0]
    got = quantiles.quantiles(df, {c: F.col(c) for c in "abcd"}, shares)
    want = df.agg(*[F.percentile(c, shares).alias(c) for c in "abcd"]).first()
    for c in "abc":
        assert [got[c][q] for q in shares] == pytest.approx(want[c], rel=1e-12)
    assert set(got["d"].values()) == {None}
    few = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (2.0,), (None,)], "a double")
    assert quantiles.medians(few, {"a": F.col("a")})["a"] == 1.5


def test_metrics_of_one_group_that_holds_all_rows(spark):
    """Only the first rows of each task's share of a group reach the shuffle that puts them in order."""
    n = 40_000
    scores = spark.range(n).repartition(8).select(F.format_string("c%06d", "id").alias("cve_id"), F.when(F.col("id") >= 0, "w").alias("week"), (F.xxhash64("id") % 4).cast("double").alias("label"), F.when(F.col("id") >= 0, "m").alias("model"), (F.xxhash64("id", F.lit(5)) / 1e18).alias("score")).withColumn("label", F.abs("label"))
    rows = sorted(((-r["score"], r["cve_id"], r["label"]) for r in scores.collect()))
    got = E.grouped_metrics(scores, "week", [10, 50]).first()
    for k in (10, 50):
        top, best = [r[2] for r in rows[:k]], sorted((r[2] for r in rows), reverse=True)[:k]
        dcg, ideal = (sum((2**v - 1) / math.log2(i + 2) for i, v in enumerate(x)) for x in (top, best))
        hits = [i + 1 for i, v in enumerate(top) if v >= 2]
        assert got[f"ndcg_{k}"] == pytest.approx(dcg / ideal) and got[f"precision_{k}"] == pytest.approx(len(hits) / k)
        assert got[f"recall_{k}"] == pytest.approx(len(hits) / sum(r[2] >= 2 for r in rows)) and got[f"ap_{k}"] == pytest.approx(sum((j + 1) / p for j, p in enumerate(hits)) / len(hits))
    for plan in (E.grouped_metrics(scores, "week", [10]), E.linear_ndcg(scores, "week", 10)):
        assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    ties = spark.createDataFrame([("m", "w", s, v) for s, v in [(3.0, 1.0), (3.0, 0.0), (2.0, 2.0), (1.0, 0.0)]] + [("m", "none", 1.0, 0.0)], "model string, week string, score double, label double")
    out = E.linear_ndcg(ties, "week", 3).collect()
    assert len(out) == 1 and out[0]["ndcg"] == pytest.approx((0.5 + 0.5 / math.log2(3) + 2 / 2) / (2 + 1 / math.log2(3)))


def test_tails_equal_tables():
    # two-sided 5 % points of Student's t
    for df, t in [(4, 2.776445), (9, 2.262157), (19, 2.093024), (49, 2.009575)]:
        assert tails.student_two_sided(t, df) == pytest.approx(0.05, abs=1e-6)
    # critical values of the signed-rank sum at 5 %, two-sided: the largest w whose tail is not above
    for n, w in [(6, 0), (7, 2), (8, 3), (10, 8), (15, 25), (20, 52), (25, 89)]:
        assert tails.signed_rank_two_sided(w, n) <= 0.05 < tails.signed_rank_two_sided(w + 1, n)
    assert tails.signed_rank_two_sided(0, 5) == 2 / 32 and abs(tails.signed_rank_two_sided(434, 50) - 0.05) < 0.005
    for k, n, p in [(0, 10, 0.3), (3, 20, 0.2), (40, 900, 0.05)]:
        assert tails.binomial_at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
        assert tails.binomial_at_most(k, n, tails.binomial_upper(k, n, 0.01)) == pytest.approx(0.01, rel=1e-6)


def test_tests_use_exact_tails(spark):
    r = random.Random(6)
    rows = [("x", r.gauss(0.4, 1), 0.0) for _ in range(12)] + [("few", 1.0, 0.0)] * 3 + [("ties", float(i % 3 - 1) or 2.0, 0.0) for i in range(20)]
    pairs = spark.createDataFrame(rows, "m string, a double, b double")
    d = [a for m, a, _ in rows if m == "x"]
    ranks = {v: i + 1 for i, v in enumerate(sorted(d, key=abs))}
    w = min(sum(k for v, k in ranks.items() if v > 0), sum(k for v, k in ranks.items() if v < 0))
    signs = [sum(k for k, on in zip(range(1, 13), choice) if on) for choice in itertools.product([0, 1], repeat=12)]
    got = {x["m"]: x for x in T.wilcoxon(pairs, ["m"]).collect()}
    assert got["x"]["w"] == w and got["x"]["p"] == pytest.approx(min(1, 2 * sum(s <= w for s in signs) / len(signs))) and got["few"]["p"] == 1.0 and 0 < got["ties"]["p"] <= 1
    t = {x["m"]: x for x in T.paired_t(pairs, ["m"]).collect()}
    want = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(12))
    assert t["x"]["t"] == pytest.approx(want) and t["x"]["p"] == pytest.approx(tails.student_two_sided(want, 11)) and t["few"]["p"] == 1.0


def test_hops_over_two_relations(spark):
    edges = [("a", "b", "r1"), ("b", "c", "r1"), ("a", "d", "r2"), ("d", "f", "r2")]
    x = {"a": 1.0, "b": 2.0, "c": 4.0, "d": 8.0, "f": 16.0, "alone": 5.0}
    near = collections.defaultdict(set)
    for s, t, k in edges:
        near[s, k].add(t)
        near[t, k].add(s)
    level = {i: {"x": v} for i, v in x.items()}
    want = {i: dict(v) for i, v in level.items()}
    for hop in (1, 2):
        level = {i: {f"{k}_{hop}_{c}": sum(level[j][c] for j in near[i, k]) / len(near[i, k]) if near[i, k] else 0.0 for k in ("r1", "r2") for c in level[i]} for i in x}
        for i in x:
            want[i] |= level[i]
    out = G.neighbour_means(spark.createDataFrame(edges, "src string, dst string, relation string"), spark.createDataFrame(list(x.items()), "id string, x double"), ["x"], hops=2)
    assert {r["id"]: {c: r[c] for c in out.columns if c != "id"} for r in out.collect()} == want
    assert want["d"]["r2_2_r2_1_x"] == np.mean([8.0, 8.0])


def test_sliding_budget_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    first = [(i, 1, at(i)) for i in range(0, 130)] + [(500 + i, 2, at(10)) for i in range(5)] + [(600, 3, at(5))]
    again = [(i, 1, at(i)) for i in range(100, 130)] + [(200, 1, at(125)), (201, 1, at(126)), (700, 4, at(5000))]  # repeated, and late within the watermark
    late = [(900, 1, at(20)), (901, 4, at(9000))]
    schema = "event_id long, user_id long, ts timestamp"
    for i, part in enumerate((first, again, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = jobs.drained(jobs.sliding_budget(stream, 80, 60, "10 minutes").select("user_id", "event_id", "n"), "b", f"{tmp_path}/ck", sink=f"{tmp_path}/out")
    kept = {e[0]: e for e in first + again}.values()
    assert {(r["user_id"], r["event_id"]) for r in out.collect()} == {(u, i) for i, u, t in kept if sum(v == u and t - datetime.timedelta(seconds=60) <= s <= t for _, v, s in kept) > 80}
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    out = jobs.drained(jobs.sliding_budget(stream, 3, 60, "10 minutes").select("user_id", "event_id", "n"), "b2", f"{tmp_path}/ck2", sink=f"{tmp_path}/out2")
    rows = list({e[0]: e for e in first + again + late}.values())
    want = {(u, i, min(4, n)) for i, u, t in rows if t < at(8000) and (n := sum(v == u and t - datetime.timedelta(seconds=60) <= s <= t for _, v, s in rows)) > 3}
    assert {tuple(r) for r in out.collect()} == want
    table = spark.createDataFrame(rows, schema)
    assert {(r["user_id"], min(4, r["n"])) for r in jobs.sliding_counts(table).where("n > 3").collect()} == {(u, n) for u, _, n in want}


def ndcg(rows, score, k=10):
    """Mean over groups of two rows or more, of (cve_id, group, label, ...) rows."""
    out = []
    for _, members in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        m = sorted(members, key=lambda r: (-score[r[0]], r[0]))
        if len(m) >= 2:
            dcg, ideal = (sum((2**v - 1) / math.log2(i + 2) for i, v in enumerate(x)) for x in ([r[2] for r in m[:k]], sorted((r[2] for r in m), reverse=True)[:k]))
            out.append(dcg / ideal if ideal else 0.0)
    return round(sum(out) / len(out), 6)


def linear(rows, weights):
    return {r[0]: sum(w * r[4 + FEATURES.index(c)] for c, w in weights.items()) for r in rows}


@pytest.fixture(scope="module")
def halves(spark):
    rows = planted(600, 8, 9)
    train, test = [r for r in rows if r[1] < "g5"], [r for r in rows if r[1] >= "g5"]
    return train, test, spark.createDataFrame(train, ROWS), spark.createDataFrame(test, ROWS)


def weights_of(table):
    return {r["feature"]: r["weight"] for r in table.collect()}


def test_batch_scores_and_quality(spark, halves):
    train, test, a, b = halves
    w = weights_of(M.fit_pairwise(a, FEATURES, per_row=6, rounds=10))
    scores = linear(test, w)
    assert M.quality(M.linear_scores(b, spark.createDataFrame(list(w.items()), "feature string, weight double"))) == pytest.approx(ndcg(test, scores), abs=1e-6)
    table = spark.createDataFrame([*w.items(), ("absent", 3.0)], "feature string, weight double")
    ids = spark.createDataFrame([(r[0].lower(),) for r in test[::3]], "cve_id string")
    got = [(r["cve_id"], round(r["score"], 9)) for r in M.batch_scores(b, table, 7, ids).collect()]
    want = sorted(((-scores[r[0]], r[0]) for r in test[::3]))[:7]
    assert got == [(i, round(-s, 9)) for s, i in want]


def test_ablation_and_scales(halves):
    train, test, a, b = halves
    variants = {"x": ["x"], "y": ["y"], "all": FEATURES}
    pairs = M.preference_pairs(a, FEATURES)
    got = {r["variant"]: r for r in M.ablation(a, b, variants, rounds=10).collect()}
    for place, (name, columns) in enumerate(variants.items()):
        assert got[name]["ndcg"] == pytest.approx(ndcg(test, linear(test, weights_of(M.fit_pairs(pairs, columns, rounds=10)))), abs=2e-3) and (got[name]["place"], got[name]["features"]) == (place, len(columns))
    assert got["x"]["ndcg"] > got["y"]["ndcg"]
    scaled = {r["scale"]: r["ndcg"] for r in M.confidence_scales(a, b, FEATURES, (0.5, 4.0), rounds=10).collect()}
    for s, value in scaled.items():
        w = weights_of(M.fit_pairwise(a.withColumn("weight", F.least(F.lit(2.0), F.greatest(F.lit(0.05), F.col("weight") * s))), FEATURES, rounds=10))
        assert value == pytest.approx(ndcg(test, linear(test, w)), abs=2e-3)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rankers_fitted_together_equal_those_fitted_one_by_one(spark, halves, parts):
    train, _, a, _ = halves
    more = [(f"{r[0]}'{n}", r[1] if n else None, *r[2:]) for r in train for n in (0, 1)] + [(None, *train[0][1:]), (train[1][0], train[1][1], None, *train[1][3:])]
    for rows in (a, spark.createDataFrame(more, a.schema)):
        pairs, variants = M.preference_pairs(rows, FEATURES, 8), [["x"], ["y"], FEATURES, FEATURES[::-1]]
        hashed, order = M.by_hash(rows, FEATURES, "cve_id")
        cut = hashed.repartitionByRange  # some parts hold fewer rows than a row meets
        hashed.repartitionByRange = lambda *by: cut(parts, *by)
        frames = pairwise.packed(hashed, order, FEATURES, 8)
        for rounds in (2, 10):
            for columns, got in zip(variants, pairwise.fitted(frames, FEATURES, variants, 8, rounds=rounds)):
                assert got == pytest.approx(weights_of(M.fit_pairs(pairs, columns, rounds=rounds)), rel=1e-6, abs=1e-9)


def test_packed_rows_hold_each_pair_once(spark):
    rows = spark.createDataFrame([(f"k{i}", f"g{i % 3}", float(i * i % 4), 1.0 + i % 2, float(i), float(i % 5)) for i in range(190)], "cve_id string, group string, label double, weight double, x double, y double")
    for parts in (1, 3, 60):
        hashed, order = M.by_hash(rows, ["x", "y"], "cve_id")
        cut = hashed.repartitionByRange
        hashed.repartitionByRange = lambda *by: cut(parts, *by)
        got = np.zeros(6)
        for frame in pairwise.packed(hashed, order, ["x", "y"], 8):
            got += sum((np.array(r["s"]) for r in frame.where("s IS NOT NULL").collect()), np.zeros(6))
        w, x, y = (F.col(c) for c in ("pair_weight", "x", "y"))
        want = M.preference_pairs(rows, ["x", "y"], 8).agg(*[F.sum(c) for c in (w, w * w, w * x, w * y, w * x * x, w * y * y)]).first()
        assert list(got) == pytest.approx(list(want), rel=1e-9)


def test_ablation_reads_rows_once_a_round_for_all_variants(halves, monkeypatch):
    _, _, a, b = halves
    fitted, rounds, losses = [], [], pairwise.losses
    monkeypatch.setattr(M, "LogisticRegression", lambda **x: fitted.append(1))
    monkeypatch.setattr(pairwise, "losses", lambda packs, weights, n: rounds.append(len(weights)) or losses(packs, weights, n))
    assert M.ablation(a, b, {f"v{i}": FEATURES for i in range(20)}, rounds=4).count() == 20
    assert not fitted and rounds[0] == 20 and len(rounds) < 12
    got = M.ablation(a.limit(0), b, {"x": ["x"], "all": FEATURES}, rounds=2).collect()  # without pairs all weights are 0
    assert [(r["variant"], r["features"]) for r in got] == [("x", 1), ("all", len(FEATURES))] and len({r["ndcg"] for r in got}) == 1
    assert {r["ndcg"] for r in M.ablation(a, b.limit(0), {"x": ["x"]}, rounds=2).collect()} == {0.0}


def test_scales_share_their_pairs(halves, monkeypatch):
    _, _, a, b = halves
    made, plain = [], M.preference_pairs
    monkeypatch.setattr(M, "preference_pairs", lambda *x, **more: made.append(1) or plain(*x, **more))
    assert M.confidence_scales(a, b, FEATURES, (0.5, 1.0, 4.0), rounds=3).count() == 3 and len(made) == 1
    assert {r["ndcg"] for r in M.confidence_scales(a, b.limit(0), FEATURES, (1.0,), rounds=2).collect()} == {0.0}


def test_pairs_sort_by_a_stored_hash_and_read_rows_once(halves):
    _, _, a, _ = halves
    pairs = M.preference_pairs(a, FEATURES)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if " Sort [" in line and "md5" in line]  # a sort takes an expression anew at each comparison
    assert "Union" not in plan
    sides = {r["x"] for r in a.select("cve_id").withColumn("x", (M.hash_bucket("cve_id", 2) == 0) == F.substring(F.md5("cve_id"), 8, 1).isin(*"02468ace")).collect()}
    assert sides == {True}


def test_grid_uses_whole_groups_and_all_combinations(spark, halves):
    train, _, a, _ = halves
    grid = {"depth": [1, 3], "rounds": [2], "step": [0.1, 0.3]}
    got = {r["params"]: r["ndcg"] for r in M.grid_search(a, FEATURES, grid, folds=2).collect()}
    assert len(got) == 4
    fold = {r["group"]: r["f"] for r in a.select("group", M.hash_bucket("group", 2).alias("f")).distinct().collect()}
    params = {"depth": 3, "rounds": 2, "step": 0.3}
    values = []
    for f in range(2):
        held = [r for r in train if fold[r[1]] == f]
        model = M.fit_trees(a.where(F.col("group").isin([g for g, x in fold.items() if x != f])), FEATURES, **params)
        values.append(ndcg(held, {r["cve_id"]: r["score"] for r in M.scored(model, spark.createDataFrame(held, ROWS)).collect()}))
    assert got[str(params)] == pytest.approx(sum(values) / 2, abs=2e-3)


def test_ensemble_is_mean_and_deviation_of_replicas(halves):
    from riskweave.operators.splits import bootstrap

    train, test, a, b = halves
    drawn = bootstrap(a.select("group").distinct(), 2, "group").collect()
    scores = []
    for replica in (0, 1):
        times = {r["group"]: r["times"] for r in drawn if r["replica"] == replica}
        kept = a.where(F.col("group").isin(list(times))).withColumn("weight", F.col("weight") * F.create_map(*[F.lit(x) for g in times.items() for x in g])[F.col("group")])
        scores.append(linear(test, weights_of(M.fit_pairwise(kept, FEATURES))))
    got = {r["cve_id"]: r for r in M.ensemble(a, b, FEATURES, 2).collect()}
    for i in scores[0]:
        pair = [scores[0][i], scores[1][i]]
        assert got[i]["mean"] == pytest.approx(np.mean(pair), abs=1e-6) and got[i]["deviation"] == pytest.approx(np.std(pair), abs=1e-6)


def test_importances(spark, halves):
    train, test, a, b = halves
    found = M.importances(M.fit_trees(a, FEATURES, depth=3, rounds=3), FEATURES)
    first = M.importance_table(found, 2).orderBy("place").collect()
    assert first[0]["feature"] == "x" and len(first) == 2 and sum(r["importance"] for r in found.collect()) == pytest.approx(1.0)
    assert first[0]["share"] == pytest.approx(first[0]["importance"])
    w = M.fit_pairwise(a, FEATURES, rounds=10)
    drop = {r["feature"]: r["drop"] for r in M.permutation_importance(b, w, FEATURES).collect()}
    assert drop["x"] > drop["z"]
    runs = M.importance_runs(a, FEATURES, (0.7,), ("s",), rounds=10).collect()
    part = M.hash_sample(a, 0.7, salt="s")
    weights, rows = weights_of(M.fit_pairwise(part, FEATURES, rounds=10)), part.collect()
    for r in runs:
        assert r["importance"] == pytest.approx(np.mean([abs(x[r["feature"]] * weights[r["feature"]]) for x in rows]), abs=1e-6)


def test_stacking_equals_ridge(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 2)) * [1.0, 3.0]
    y = 0.7 * x[:, 0] - 0.2 * x[:, 1] + 0.1 * r.standard_normal(300)
    wide = spark.createDataFrame([(f"c{i}", float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "cve_id string, a double, b double, label double")
    scores, weights = M.stacking(wide, ["a", "b"])
    # features and label are standardised, then one penalty of half the squared weights for each row
    sx, sy = x.std(0), y.std()
    z, t = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    beta = np.linalg.solve(z.T @ z / 300 + np.eye(2) / sy, z.T @ t / 300) * sy / sx
    assert [r["weight"] for r in weights.orderBy("model").collect()] == pytest.approx(beta.tolist(), rel=1e-4)
    got = {r["cve_id"]: r["score"] for r in scores.collect()}
    assert [got[f"c{i}"] for i in range(300)] == pytest.approx((y.mean() + (x - x.mean(0)) @ beta).tolist(), rel=1e-3, abs=1e-4)
    labelled = wide.withColumn("label", F.when(F.col("label") > 0, 3.0).otherwise(0.0))
    for kind in ("logistic", "forest"):
        out = {r["cve_id"]: r["score"] for r in M.stacking(labelled, ["a", "b"], kind)[0].collect()}
        high, low = [out[f"c{i}"] for i in range(300) if y[i] > 0], [out[f"c{i}"] for i in range(300) if y[i] <= 0]
        assert np.mean([h > v for h in high for v in low]) > 0.9
