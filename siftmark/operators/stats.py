"""Distribution summaries and the rank-sum test."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.operators.order import numbered

# The summary's quantiles.
QUANTILES = {"p10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "p95": 0.95}


def summary(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """([by], n, mean, median, std, min, p10, q25, q75, p90, p95, max): exact, linearly interpolated
    percentiles; the sample deviation, 0 for one value. Null values are left out; without values n is 0
    and the rest null."""
    v = df.select(*(by or []), value.cast("double").alias("v"))
    q = F.percentile("v", F.array(*(F.lit(x) for x in QUANTILES.values()))).alias("q")
    std = F.when(F.count("v") == 1, F.lit(0.0)).otherwise(F.stddev_samp("v"))
    rows = v.groupBy(*(by or [])).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), std.alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q)
    at = {name: F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)}
    return rows.select(*(by or []), "n", "mean", at["median"], "std", "min", at["p10"], at["q25"], at["q75"], at["p90"], at["p95"], "max")


def summary_ci(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """([by], n_pairs, mean, median, std, q25, q75, ci95_low, ci95_high): mean -+ 1.96 std / sqrt(n)."""
    s = summary(df, value, by)
    half = F.lit(1.96) * F.col("std") / F.sqrt(F.col("n"))
    half = F.when(F.col("n") > 0, half)
    return s.select(*(by or []), F.col("n").alias("n_pairs"), "mean", "median", "std", "q25", "q75", (F.col("mean") - half).alias("ci95_low"), (F.col("mean") + half).alias("ci95_high"))


def empirical_cdf(df: DataFrame, value: Column) -> DataFrame:
    """(value, cdf): each value with its share of values up to it in order; for plots of result tables."""
    v = df.select(value.alias("value")).where(F.col("value").isNotNull())
    n = F.broadcast(v.agg(F.count("*").alias("all")))  # one row
    return numbered(v, [F.col("value")]).crossJoin(n).select("value", ((F.col("n") + 1) / F.col("all")).alias("cdf"))


def rank_sums(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """One row (n_x, n_y, r_x, ties, mean_x, mean_y, var_x, var_y) for the groups x and y.

    Average ranks come from counts of equal values and the running number of smaller ones, so that the
    window runs over different values only, in range parts with offsets.
    """


    v = df.select(group.alias("g"), value.cast("double").alias("v")).where("v is not null and g in ('x', 'y')")
    per = v.groupBy("v").agg(F.count_if(F.col("g") == "x").alias("a"), F.count("*").alias("t"))
    order = numbered(per, [F.col("v")])
    # the running sum over different values, in blocks of their numbers
    block = order.withColumn("b", F.floor(F.col("n") / 100_000))
    sums = block.groupBy("b").agg(F.sum("t").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"))
    inside = F.sum("t").over(Window.partitionBy("b").orderBy("n")) - F.col("t")
    ranked = block.withColumn("less", inside).join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.col("less") + (F.col("t") + 1) / 2)
    r = ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("r_x"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"))
    x, y = F.when(F.col("g") == "x", F.col("v")), F.when(F.col("g") == "y", F.col("v"))
    m = v.agg(F.count(x).alias("n_x"), F.count(y).alias("n_y"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var_x"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("var_y"))
    return m.crossJoin(r)


def mann_whitney(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """(n_x, n_y, u1, u2, u_min, z_approx, cliffs_delta, cohens_d, mean_diff): rank-sum test of x and y.

    Average ranks for ties, variance corrected for ties, z with a continuity correction and without sign.
    Without variance z is 0 and Cohen's d null. If either group is empty, all but the counts are null.
    """
    s = rank_sums(df, group, value)
    nx, ny = F.col("n_x").cast("double"), F.col("n_y").cast("double")
    n = nx + ny
    u1 = F.col("r_x") - nx * (nx + 1) / 2
    var = nx * ny / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, (F.abs(u1 - nx * ny / 2) - 0.5) / F.sqrt(var)).otherwise(F.lit(0.0))
    pooled = ((nx - 1) * F.col("var_x") + (ny - 1) * F.col("var_y")) / F.nullif(n - 2, F.lit(0.0))
    d = F.when(pooled > 0, (F.col("mean_x") - F.col("mean_y")) / F.sqrt(pooled))
    some = (F.col("n_x") > 0) & (F.col("n_y") > 0)
    cols = {"u1": u1, "u2": nx * ny - u1, "u_min": F.least(u1, nx * ny - u1), "z_approx": z, "cliffs_delta": 2 * u1 / (nx * ny) - 1, "cohens_d": d, "mean_diff": F.col("mean_x") - F.col("mean_y")}
    return s.select("n_x", "n_y", *(F.when(some, c).alias(k) for k, c in cols.items()))


def p_two_sided(z: float | None) -> float | None:
    """Two-sided probability of a z value."""
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def with_p(tests: DataFrame) -> DataFrame:
    """The few rows of ``mann_whitney`` with p_two_sided_approx after z_approx. The engine has no error function."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(lambda x: p_two_sided(None if pd.isna(x) else x))

    at = tests.columns.index("z_approx") + 1
    return tests.select(*tests.columns[:at], p("z_approx").alias("p_two_sided_approx"), *tests.columns[at:])
