"""Statistics of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.expressions import flag
from riskweave.operators.filters import one_row
from riskweave.operators.quantiles import medians, quantiles

FLAGS = ["kev_flag", "is_healthcare", "is_curated", "attack_flag", "chpl_flag"]


def table_statistics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.min(F.to_date("published")).alias("first_day"),
        F.max(F.to_date("published")).alias("last_day"),
        F.count("cvss").alias("with_cvss"),
        F.round(F.avg("cvss"), 2).alias("avg_cvss"),
        *[F.sum(F.col(f)).alias(f"n_{f}") for f in FLAGS],
    )


def distribution(df: DataFrame, label: str, domain: list | None = None) -> DataFrame:
    """(label, n, pct) of all values, those of the domain even if there are none."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        every = df.sparkSession.createDataFrame([(v,) for v in domain], f"{label} bigint")
        counts = every.join(counts.withColumn(label, F.col(label).cast("bigint")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # over the few distinct labels


def by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("published").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("total"), F.count("cvss").alias("with_cvss"), F.round(F.avg("cvss"), 2).alias("avg_cvss"), F.min("cvss").alias("min_cvss"), F.max("cvss").alias("max_cvss")
    )


def severity_band(cvss: Column) -> Column:
    return F.when(cvss.isNull(), "unknown").when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")


def severity_bands(df: DataFrame) -> DataFrame:
    return df.groupBy(severity_band(F.col("cvss")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("cvss").alias("least"))


def coverage(df: DataFrame) -> DataFrame:
    """One row: shares of rows with each signal, and of combinations of signals."""
    share = lambda test: F.round(F.avg(flag(test).cast("double")) * 100, 4)
    several = sum((F.coalesce(F.col(f), F.lit(0)) for f in FLAGS), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        share(F.col("epss_score").isNotNull()).alias("pct_epss"),
        share(F.col("epss_score") > 0).alias("pct_epss_positive"),
        share(F.col("epss_date").isNotNull()).alias("pct_epss_dated"),
        *[share(F.col(f) == 1).alias(f"pct_{f}") for f in FLAGS],
        share((F.col("kev_flag") == 1) & (F.col("is_healthcare") == 1)).alias("pct_kev_healthcare"),
        share(several >= 2).alias("pct_two_signals"),
        share(several >= 3).alias("pct_three_signals"),
    )


def key_problems(df: DataFrame, key: str = "cve_id") -> DataFrame:
    """(problem, n): keys that occur more than once, blank keys, keys of another form."""
    c = F.col(key)
    repeated = df.where(c.isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated").alias("problem"), "n")
    other = df.agg(F.count_if(F.coalesce(F.trim(c) == "", F.lit(True))).alias("blank"), F.count_if(c.isNotNull() & ~c.rlike(r"^CVE-\d{4}-\d{4,}$")).alias("format"))
    return repeated.unionByName(other.unpivot([], ["blank", "format"], "problem", "n"))


def rate_by(df: DataFrame, key: str, least: int, hit: str = "kev_flag") -> DataFrame:
    """(key, n, hits, rate) of keys with at least ``least`` rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits")).where(F.col("n") >= least).withColumn("rate", F.col("hits") / F.col("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins: ``all`` stands for the sum over a value."""
    return (
        df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        .cube("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
        .select(F.when(F.col("g").isin(2, 3), "all").otherwise(F.col("a")).alias("a"), F.when(F.col("g").isin(1, 3), "all").otherwise(F.col("b")).alias("b"), "n")
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: n, mean, std, min, quartiles, max, missing_pct, zero_pct; quantiles by exact selection, the rest in one pass."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    shares = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    found = quantiles(df, {c: F.col(c) for c in columns}, shares.values())
    listed = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(found[c][q]).cast("double") for q in shares.values()]))])
    return long.groupBy("column").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"),
        F.min("value").alias("min"),
        *[F.round(F.get(listed[F.col("column")], F.lit(i)), 6).alias(name) for i, name in enumerate(shares)],
        F.max("value").alias("max"),
        F.round(F.avg(flag(F.col("value").isNull()).cast("double")) * 100, 4).alias("missing_pct"),
        F.round(F.avg(flag(F.col("value") == 0).cast("double")) * 100, 4).alias("zero_pct"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column, missing, pct) of every column."""
    parts = df.select(*[F.col(c).isNull().cast("bigint").alias(c) for c in df.columns])
    sums = parts.agg(*[F.sum(c).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_n"))
    return sums.unpivot(["_n"], df.columns, "column", "missing").select("column", "missing", F.round(F.lit(100.0) * F.col("missing") / F.col("_n"), 2).alias("pct"))


def missingness_change(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = missingness(before), missingness(after)
    return a.select("column", F.col("pct").alias("before")).join(b.select("column", F.col("pct").alias("after")), "column").withColumn("change", F.round(F.col("after") - F.col("before"), 2))


def completeness(df: DataFrame) -> DataFrame:
    """(bucket, n) of columns: full, 90 to 100 %, less."""
    share = 100 - F.col("pct")
    return missingness(df).groupBy(F.when(F.col("missing") == 0, "full").when(share >= 90, "90-99").otherwise("<90").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def weak_features(df: DataFrame, columns: list[str], mostly: float = 0.01) -> DataFrame:
    """(column, n_values, nonzero_share, constant, mostly_zero)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    stats = long.groupBy("column").agg((F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n_values"), F.avg(flag(F.col("value") != 0).cast("double")).alias("nonzero_share"))
    return stats.select("column", "n_values", F.round("nonzero_share", 6).alias("nonzero_share"), (F.col("n_values") <= 1).alias("constant"), (F.col("nonzero_share") < mostly).alias("mostly_zero"))


def correlations(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, r): Pearson correlation of each column with the label, all in one pass; columns without variance are left out."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "r").where(F.col("r").isNotNull() & ~F.isnan("r")).withColumn("r", F.round("r", 6))


def monthly(df: DataFrame, last_months: int | None = None) -> DataFrame:
    months = df.groupBy(F.date_format("published", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    if last_months is not None:
        latest = one_row(df, F.date_format(F.add_months(F.max(F.to_date("published")), -last_months), "yyyy-MM").alias("_from"))
        months = months.join(latest).where("month > _from").drop("_from")
    return months


def kev_comparison(df: DataFrame, value: str = "cvss") -> DataFrame:
    """One row: mean and median of the value with and without exploitation, and their differences."""
    hit, other = F.when(F.col("kev_flag") == 1, F.col(value)), F.when(F.col("kev_flag") != 1, F.col(value))
    middle = medians(df, {"kev": hit, "other": other})
    out = df.agg(F.avg(hit).alias("mean_kev"), F.avg(other).alias("mean_other")).withColumns({f"median_{c}": F.lit(v).cast("double") for c, v in middle.items()})
    return out.select(*[F.round(F.col(c), 6).alias(c) for c in out.columns], F.round(F.col("mean_kev") - F.col("mean_other"), 6).alias("mean_difference"), F.round(F.col("median_kev") - F.col("median_other"), 6).alias("median_difference"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # over the classes
    return counts.select(label, F.round(F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")), 6).alias("weight"))


def scaling(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column with its least, greatest, mean and population deviation (1 where it is 0)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    deviation = F.stddev_pop("value")
    return long.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias("deviation"))


def scaled(df: DataFrame, params: DataFrame, columns: list[str], how: str = "zscore", clip: float | None = None) -> DataFrame:
    """The columns scaled by parameters fitted before, perhaps on other rows: one row of parameters is broadcast."""
    wide = F.broadcast(params.groupBy().pivot("column", columns).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("mean").alias("mean"), F.first("deviation").alias("deviation")))
    out = df.join(wide)
    for c in columns:
        value = F.col(c).cast("double")
        if how == "zscore":
            new = (value - F.col(f"{c}_mean")) / F.col(f"{c}_deviation")
        else:
            spread = F.col(f"{c}_high") - F.col(f"{c}_low")
            new = (value - F.col(f"{c}_low")) / F.when(spread == 0, 1.0).otherwise(spread)
        out = out.withColumn(c, F.least(F.lit(clip), F.greatest(F.lit(-clip), new)) if clip is not None else new)
    return out.drop(*[f"{c}_{p}" for c in columns for p in ("low", "high", "mean", "deviation")])


def means_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in columns])


def split_summary(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("published")).alias("first_day"), F.max(F.to_date("published")).alias("last_day"), F.round(F.avg(flag(F.col(label) >= 2).cast("double")) * 100, 4).alias("pct_relevant"))


def fold_summary(df: DataFrame, model: str, value: str, base: str) -> DataFrame:
    """(model, mean, std, change_pct): folds' mean and deviation, and the change against the base model."""
    stats = df.groupBy(model).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    start = F.broadcast(stats.where(F.col(model) == base).select(F.col("mean").alias("_base")))
    return stats.join(start).select(model, F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(100 * (F.col("mean") - F.col("_base")) / F.col("_base"), 4).alias("change_pct"))


def threshold_sensitivity(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, rate, kev_capture): conditional counts of all thresholds in one pass."""
    names = [str(t) for t in thresholds]
    row = df.agg(F.count(F.lit(1)).alias("total"), F.sum("kev_flag").alias("kev"), *[F.count_if(F.col(score) >= t).alias(f"n_{n}") for t, n in zip(thresholds, names)], *[F.count_if((F.col(score) >= t) & (F.col("kev_flag") == 1)).alias(f"k_{n}") for t, n in zip(thresholds, names)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`n_{n}`").alias("n"), F.col(f"`k_{n}`").alias("hits")) for t, n in zip(thresholds, names)])).alias("x")
    return row.select("total", "kev", rows).select("x.threshold", "x.n", F.round(F.col("x.n") / F.col("total"), 6).alias("rate"), F.round(F.try_divide(F.col("x.hits"), F.col("kev")), 6).alias("kev_capture"))


def confidence_histogram(df: DataFrame, column: str = "confidence") -> DataFrame:
    """(bin, n) of width 0.1; 1.0 is in the last bin."""
    bin_no = F.least(F.lit(9), F.floor(F.col(column) * 10)).cast("bigint")
    return df.where(F.col(column).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def curated_statistics(df: DataFrame) -> DataFrame:
    """(facet, value, n) of curated records: by severity, exploited, distinct vendors."""
    curated = df.where(F.col("is_curated") == 1)
    by_severity = curated.groupBy(F.col("curated_severity").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("severity").alias("facet"), "value", "n")
    exploited = curated.agg(F.sum("kev_flag").alias("n")).select(F.lit("exploited").alias("facet"), F.lit("1").alias("value"), "n")
    return by_severity.unionByName(exploited)
