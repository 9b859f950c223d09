"""Summaries of observed values against null replicates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.sets import divided, finite
from skeinwork.operators import network


def integral(f: Callable[[Column], Column], low: Column, high: Column, nodes: int = 96) -> Column:
    """The integral of a smooth function by Gauss-Legendre quadrature, as one expression."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w, strict=True)])
    half, middle = (high - low) / 2, (high + low) / 2
    return half * F.aggregate(points, F.lit(0.0), lambda total, p: total + p.w * f(middle + half * p.x))


def two_sided_normal_p(z: Column) -> Column:
    """Probability that a standard normal value lies farther from 0 than z; null and NaN stay."""
    x = F.abs(z) / math.sqrt(2)
    tail = 2 / math.sqrt(math.pi) * F.exp(-x * x) * integral(lambda t: F.exp(-t * t - 2 * x * t), F.lit(0.0), F.lit(7.0))
    return F.when(F.isnan(z), z).when(z.isNotNull(), F.least(tail, F.lit(1.0)))


def two_sided_t_p(t: Column, freedom: Column) -> Column:
    """Probability that a value of Student's t lies farther from 0 than t: with t = sqrt(n) tan(a), its density is cos(a) ** (n - 1)."""
    angle, power = F.atan(F.abs(t) / F.sqrt(freedom)), freedom - 1
    reach = 14 / F.sqrt(freedom)  # beyond it, nothing is left

    def part(low: Column) -> Column:
        high = F.least(low + reach, F.lit(math.pi / 2))
        return integral(lambda a: F.pow(F.greatest(F.cos(a), F.lit(0.0)), power), low, high)

    return F.when(t.isNotNull(), F.least(part(angle) / part(F.lit(0.0)), F.lit(1.0)))


def correlated(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r of the rows that have both. NaN where either has no spread, null without a row; corr would be an error there."""
    a, b = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
    return divided(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r, p): Pearson's r of the rows that have both, with its two-sided p; p is null below three rows, 0 where r is 1 or -1, and NaN as r is without spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = both.agg(F.count("*").alias("n"), correlated(F.col(x), F.col(y)).alias("r"))
    r, freedom = F.col("r"), (F.col("n") - 2).cast("double")
    t = r * F.sqrt(freedom / (1 - r * r))
    return found.withColumn("p", F.when((freedom > 0) & F.isnan(r), r).when((freedom > 0) & (F.abs(r) >= 1), 0.0).when(freedom > 0, two_sided_t_p(t, freedom)))


def null_summary(nulls: DataFrame, value: str, observed: float | Column, by: Sequence[str] = (), *, tail: str = "upper", plus_one: bool = False) -> DataFrame:
    """Observed value, mean and sd of the finite nulls, z, p and how many nulls counted.

    tail: upper is the share of nulls at or above the observed value; both is twice the
    lesser tail, 1 at most; deviation counts nulls at least as far from their mean.
    plus_one adds the observed value to the nulls.
    """
    if tail not in ("upper", "both", "deviation"):
        raise ValueError("tail: upper, both or deviation")
    obs = observed if isinstance(observed, Column) else F.lit(float(observed))
    x, extra = F.col(value), 1 if plus_one else 0
    rows = nulls.where(finite(x)).withColumn("__obs", obs)
    rows = rows.withColumn("__mean", F.avg(x).over(Window.partitionBy(*by))) if tail == "deviation" else rows
    counts = {"upper": [F.count_if(x >= F.col("__obs"))], "both": [F.count_if(x >= F.col("__obs")), F.count_if(x <= F.col("__obs"))], "deviation": [F.count_if(F.abs(x - F.col("__mean")) >= F.abs(F.col("__obs") - F.col("__mean")))] if tail == "deviation" else []}[tail]
    out = rows.groupBy(*by).agg(F.first("__obs").alias("observed"), F.avg(x).alias("null_mean"), F.stddev_samp(x).alias("null_sd"), F.count("*").alias("n_valid_nulls"), *[c.alias(f"__c{k}") for k, c in enumerate(counts)])
    shares = [(F.col(f"__c{k}") + extra) / (F.col("n_valid_nulls") + extra) for k in range(len(counts))]
    p = F.least(2 * F.least(*shares), F.lit(1.0)) if tail == "both" else shares[0]
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return out.select(*by, "observed", "null_mean", "null_sd", z.alias("z_score"), p.alias("p_value"), "n_valid_nulls")


def adjusted(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """p values adjusted for the false discovery rate: the least of p * n / rank over larger ranks; equal values have the largest rank of them all.

    Both the ranks and the least from the end are running values over the different p
    values, dealt by ranges, so no group of tests meets in one task.
    """
    by = list(by)
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__c"))
    ranked = network.running(values, [p], by, sums={"__k": F.col("__c")})
    n = values.groupBy(*by).agg(F.sum("__c").alias("__n"))
    ranked = ranked.join(n, by) if by else ranked.crossJoin(F.broadcast(n))
    ranked = ranked.withColumn("__v", F.col(p) * F.col("__n") / (F.col("__k") + F.col("__c")))
    least = network.running(ranked.select(*by, p, "__v"), [F.desc(p)], by, mins={"__least": F.col("__v")})
    return df.join(least.select(*by, p, F.least("__v", "__least", F.lit(1.0)).alias("p_adjusted")), [*by, p], "left").select(*df.columns, "p_adjusted")


def prefixes(nulls: DataFrame, value: str, order: str, by: Sequence[str] = (), steps: Sequence[int] | None = None) -> DataFrame:
    """(*by, order, n, mean, sd, low, high): mean and sd of the first n values, for every n or those of steps, in one scan.

    Sums, sums of squares about the group's mean, and how many came before are running
    values; low and high are the range so far.
    """
    by, x = list(by), F.col("__x")
    rows = nulls.where(finite(F.col(value))).select(*by, order, F.col(value).cast("double").alias("__x"))
    middle = rows.groupBy(*by).agg(F.avg("__x").alias("__m"))
    rows = rows.join(F.broadcast(middle), by) if by else rows.crossJoin(F.broadcast(middle))
    d = x - F.col("__m")
    run = network.running(rows, [order], by, sums={"__n": F.lit(1).cast("long"), "__s": d, "__q": d * d}, mins={"__lo": x, "__hi": -x})
    n, s, q = F.col("__n") + 1, F.col("__s") + d, F.col("__q") + d * d
    out = run.select(*by, order, n.alias("n"), (F.col("__m") + s / n).alias("mean"), F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))).alias("sd"), F.least("__lo", x).alias("low"), (-F.least("__hi", -x)).alias("high"))
    return out if steps is None else out.where(F.col("n").isin(list(steps)))
