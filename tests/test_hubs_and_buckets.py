"""Walks over hubs, and tables in buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as G
from riskweave.operators.sinks import BucketedTable


def solved(edges, seeds, restart):
    ids = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for s, d, v in edges:
        w[at[s], at[d]] += v
        w[at[d], at[s]] += v
    p = w / w.sum(1, keepdims=True)
    e = np.array([seeds.get(x, 0.0) for x in ids])
    e = e / e.sum() if e.sum() else np.full(len(ids), 1 / len(ids))
    return dict(zip(ids, restart * np.linalg.solve(np.eye(len(ids)) - (1 - restart) * p.T, e)))


@pytest.mark.parametrize("hub", [3, 10_000])
def test_walk_stops_at_the_solution(spark, monkeypatch, hub):
    monkeypatch.setattr(G, "HUB", hub)
    edges = [("h", f"n{i}", 1.0 + i % 3) for i in range(40)] + [(f"n{i}", f"n{i + 1}", 2.0) for i in range(0, 30, 2)]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    for seeds in ({"n3": 2.0, "n5": 1.0}, {"elsewhere": 1.0}):
        got = {r["id"]: r["score"] for r in G.diffusion(table, spark.createDataFrame(list(seeds.items()), "id string, score double"), restart=0.3, tolerance=1e-10).collect()}
        want = solved(edges, seeds, 0.3)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    both = spark.createDataFrame([("a", "n3", 1.0), ("b", "h", 1.0), ("c", "elsewhere", 1.0)], "walk string, id string, score double")
    rows = G.diffusion(table, both, restart=0.3, tolerance=1e-10, batch="walk").collect()
    assert {r["walk"] for r in rows} == {"a", "b"}
    for walk, seed in (("a", "n3"), ("b", "h")):
        want = solved(edges, {seed: 1.0}, 0.3)
        assert all(abs(r["score"] - want[r["id"]]) < 1e-9 for r in rows if r["walk"] == walk)


def test_twins_walk_as_one(spark):
    """Nodes of the same neighbours, weights and seeds become one class, and the walk over classes is the walk over nodes."""
    edges = [(f"r{i}", f"w{i % 3}", 1.0 + (i % 2)) for i in range(300)] + [(f"r{i}", "w0", 0.5) for i in range(0, 300, 5)] + [("w0", "w1", 1.0), ("r1", "r1", 2.0)]
    table = spark.createDataFrame(edges, "src string, dst string, weight double")
    seeds = {f"r{i}": 1.0 + i % 2 for i in range(0, 300, 7)}
    given = spark.createDataFrame(list(seeds.items()), "id string, _s double")
    members, nodes, links = G.twins(table, given)
    assert members.count() == 303 and nodes.count() < 40 and links.count() < 120
    assert nodes.agg(F.sum("size")).first()[0] == 303
    got = {r["id"]: r["score"] for r in G.diffusion(table, given.withColumnRenamed("_s", "score"), restart=0.7, tolerance=1e-10).collect()}
    want = solved(edges, seeds, 0.7)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    walks = given.select(F.when(F.col("_s") > 1, "a").otherwise("b").alias("walk"), "id", F.col("_s").alias("score"))
    rows = G.diffusion(table, walks, restart=0.7, tolerance=1e-10, batch="walk").collect()
    for walk, size in (("a", 2.0), ("b", 1.0)):
        want = solved(edges, {x: v for x, v in seeds.items() if v == size}, 0.7)
        mine = {r["id"]: r["score"] for r in rows if r["walk"] == walk}
        assert mine.keys() == want.keys() and all(abs(mine[x] - want[x]) < 1e-9 for x in want)


def test_star_is_cut(spark):
    """A node of 200,000 edges is dealt to replicas: no source and replica holds more than about HUB of them."""
    star = spark.range(200_000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.lit(1.0).alias("weight"))
    links, nodes = G.cut(star)
    held = links.groupBy("src", "part").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert held[0] < 1.2 * G.HUB and nodes.where("id = 'hub'").first()["parts"] == 20
    largest = links.repartition(16, "src", "part").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 0.35 * 400_000


def test_means_over_hubs(spark, monkeypatch):
    """A hub sends its values by broadcast, not through one task's join; the means are those without hubs."""
    edges = spark.createDataFrame([(f"n{i}", f"h{i % 2}", "of") for i in range(60)] + [("n1", "n2", "near"), ("n1", "h0", "near")], "src string, dst string, relation string")
    nodes = spark.createDataFrame([*[(f"n{i}", float(i)) for i in range(60)], ("h0", 5.0), ("h1", None)], "id string, x double")
    plain = sorted(map(tuple, G.neighbour_means(edges, nodes, ["x"], hops=2).collect()))
    monkeypatch.setattr(G, "HUB", 20)
    cut = G.neighbour_means(edges, nodes, ["x"], hops=2)
    assert "Union" in cut._jdf.queryExecution().toString() and sorted(map(tuple, cut.collect())) == plain


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", "cve_id", 64)
    assert table.read() is None
    old = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("cve_id"), F.lit("old").alias("published"), F.col("id").cast("double").alias("x"))
    assert len(table.upsert(old, 0)) == 64
    first = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t/data/v=0").glob("bucket=*")}
    new = spark.createDataFrame([(f"c{i}", "new", -1.0, "m") for i in (3, 3, 7, 9999)], "cve_id string, published string, x double, more string")
    touched = table.upsert(new, 1)
    assert 1 <= len(touched) <= 3 and {p.name for p in (tmp_path / "t/data/v=1").glob("bucket=*")} == {f"bucket={b}" for b in touched}
    read = {f.split("/data/")[1].rsplit("/", 1)[0] for f in table.read().inputFiles()}
    assert read == {f"v={1 if int(b[7:]) in touched else 0}/{b}" for b in first}
    rows = {r["cve_id"]: r for r in table.read().collect()}
    assert len(rows) == 5001 and rows["c3"]["x"] == -1.0 and rows["c3"]["published"] == "old" and rows["c3"]["more"] == "m" and rows["c4"]["more"] is None and rows["c9999"]["published"] == "new"
    assert table.upsert(new, 1) == [] and table.versions() == [0, 1]  # a replay
    assert table.read(0).count() == 5000
    with pytest.raises(ValueError):
        BucketedTable(spark, f"file://{tmp_path}/t").upsert(new, -1)
    # a writer that died before its commit leaves nothing that is read, and the version is written anew
    (tmp_path / "t/data/v=2/bucket=0").mkdir(parents=True)
    assert table.read().count() == 5001
    table.upsert(new.where("cve_id = 'c7'"), 2)
    gone = table.expire(1)
    assert table.versions() == [2] and len(gone) >= 1 and {r["cve_id"]: r["x"] for r in table.read().collect()}["c7"] == -1.0 and table.read().count() == 5001
    assert {r["cve_id"] for r in table.read().where("x = -1").collect()} == {"c3", "c7", "c9999"}
