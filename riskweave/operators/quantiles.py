"""Exact quantiles by selection in rounds: no state grows with the number of rows or of distinct values."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a round cuts the kept one into, values of a range that are fetched and sorted, and accuracy of the sketch that proposes the cuts.
CUTS, FEW, ACCURACY = 64, 1000, 2000


def order_values(df: DataFrame, wanted: dict[str, tuple[Column, list[int]]]) -> dict[str, dict[int, float]]:
    """For each name, whose column's values that are not null are put in order, the values at the given places from 0.

    A round proposes cuts of each place's range from a sketch of the values within, counts the values at and between all cuts of a column exactly, and keeps the range that holds the place; until the place is at a cut, or its range
    holds so few values that they are fetched. All names and places take part in the same passes; what a pass aggregates is a few numbers for each of them.
    """
    names = list(wanted)
    values = df.select(*[wanted[name][0].cast("double").alias(f"v{i}") for i, name in enumerate(names)])
    long = values.unpivot([], values.columns, "column", "value").where("value IS NOT NULL")
    out: dict[str, dict[int, float]] = {name: {} for name in names}
    # (column's number, low, high] -> places that lie in it
    ranges: dict[tuple, set[int]] = {(i, None, None): set(wanted[name][1]) for i, name in enumerate(names)}
    shares = [i / CUTS for i in range(CUTS + 1)]

    def inside(span: tuple) -> Column:
        i, low, high = span
        test = F.col(f"v{i}").isNotNull()
        test = test if low is None else test & (F.col(f"v{i}") > F.lit(low))
        return F.when(test if high is None else test & (F.col(f"v{i}") <= F.lit(high)), F.col(f"v{i}"))

    while ranges:
        spans = list(ranges)
        sketch = values.agg(*[F.percentile_approx(inside(s), shares, ACCURACY).alias(f"s{j}") for j, s in enumerate(spans)]).first()
        cuts = {i: sorted({x for s, found in zip(spans, sketch) if s[0] == i for x in [*(found or []), *[x for x in s[1:] if x is not None]]}, key=lambda x: (x != x, x)) for i in {s[0] for s in spans}}
        listed = F.create_map(*[x for i, found in cuts.items() for x in (F.lit(f"v{i}"), F.array(*map(F.lit, found)).cast("array<double>"))])
        binned = long.where(F.col("column").isin([f"v{i}" for i in cuts])).withColumn("_cuts", listed[F.col("column")]).withColumn("_bin", F.size(F.filter("_cuts", lambda x: x < F.col("value"))))
        counts = binned.groupBy("column", "_bin", F.coalesce(F.get("_cuts", F.col("_bin")) == F.col("value"), F.lit(False)).alias("_at")).agg(F.count(F.lit(1)).alias("n")).collect()  # two for each cut at most
        held = {(r["column"], r["_bin"], r["_at"]): r["n"] for r in counts}
        left: dict[tuple, set[int]] = {}
        few: dict[tuple, dict[int, int]] = {}
        for (i, _, _), places in ranges.items():
            for place in places:
                before, low = 0, None
                for j, cut in enumerate([*cuts[i], None]):
                    between, at = held.get((f"v{i}", j, False), 0), held.get((f"v{i}", j, True), 0)
                    if place < before + between:
                        if between <= FEW:
                            few.setdefault((i, low, cut), {})[place] = place - before
                        else:
                            left.setdefault((i, low, cut), set()).add(place)
                        break
                    if place < before + between + at:
                        out[names[i]][place] = cut
                        break
                    before, low = before + between + at, cut
        if few:
            spans = list(few)
            # FEW values of each
            fetched = values.agg(*[F.sort_array(F.collect_list(F.when(inside(s) != F.lit(s[2]) if s[2] is not None else F.lit(True), inside(s)))).alias(f"f{j}") for j, s in enumerate(spans)]).first()
            for s, found in zip(spans, fetched):
                for place, at in few[s].items():
                    out[names[s[0]]][place] = found[at]
        if left == ranges:
            raise ArithmeticError("the sketch proposes no cut within a range")
        ranges = left
    return out


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Iterable[float]) -> dict[str, dict[float, float | None]]:
    """For each name the quantiles of its column's values, interpolated between neighbours as ``percentile`` does; None without values."""
    shares = list(shares)
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns.values())]).first()
    places = {name: (c, sorted({f(q * (n - 1)) for q in shares for f in (math.floor, math.ceil)})) for (name, c), n in zip(columns.items(), counts) if n}
    found = order_values(df, places) if places else {}
    out = {}
    for (name, _), n in zip(columns.items(), counts):
        out[name] = {}
        for q in shares:
            if not n:
                out[name][q] = None
                continue
            at = q * (n - 1)
            low, high = found[name][math.floor(at)], found[name][math.ceil(at)]
            out[name][q] = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return out


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {name: found[0.5] for name, found in quantiles(df, columns, [0.5]).items()}
