"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """(node, component) of every node of the edges; a component's name is its least node.

    Each round a node takes the least name among its neighbours' and its own, then the name of that name, so
    names travel twice as far each round. Rounds are staged; they end when no name changes.
    """
    both = stage(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "cc-edges")
    names = stage(both.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("component")), "cc-names")
    for _ in range(most_rounds):
        named = names.select(F.col("node").alias("other"), F.col("component").alias("_c"))
        least = both.join(named, "other").groupBy("node").agg(F.min("_c").alias("_m"))
        step = names.join(least, "node").select("node", "component", F.least("component", "_m").alias("_n"))
        far = names.select(F.col("node").alias("_n"), F.col("component").alias("_f"))
        step = stage(step.join(far, "_n").select("node", F.least("_n", "_f").alias("component"), (F.least("_n", "_f") != F.col("component")).alias("_new")), "cc-names")
        changed = step.where("_new").limit(1).count()
        unstage(names)
        names = step
        if not changed:
            return names.select("node", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
