"""Evaluation tables: observed values beside bootstrap intervals, and paired differences between methods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.lineage import cut
from assaykit.operators.bootstrap import interval


def long_form(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """``by, metric, value`` of wide metric columns; NULL values stay, as undefined replicates count."""
    return df.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(*by, "x.*")


def evaluation_table(observed: DataFrame, samples: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """``by, metric, observed`` and the interval of each metric over ``samples (replicate, by, metrics)``."""
    seen = long_form(observed, by, metrics).withColumnRenamed("value", "observed")
    return seen.join(interval(long_form(samples, by, metrics), [*by, "metric"], "value"), [*by, "metric"], "left")


def paired_differences(observed: DataFrame, samples: DataFrame, by: list[str], method: str, metrics: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """``by, metric, method_a, method_b, observed_difference`` and the interval of differences within replicates.

    ``pairs`` names the comparisons (a minus b); without it, all ordered pairs of different methods are compared. A difference
    with an undefined side is undefined.
    """
    spark = samples.sparkSession

    def differences(df: DataFrame, keys: list[str]) -> DataFrame:
        d = cut(long_form(df, [*keys, method], metrics))
        a = d.select(*keys, "metric", F.col(method).alias("method_a"), F.col("value").alias("a"))
        b = d.select(*keys, "metric", F.col(method).alias("method_b"), F.col("value").alias("b"))
        if pairs is not None:
            a = a.join(F.broadcast(spark.createDataFrame(pairs, "method_a string, method_b string")), "method_a")
            return a.join(b, [*keys, "metric", "method_b"]).withColumn("value", F.col("a") - F.col("b"))
        return a.join(b, [*keys, "metric"]).where("method_a <> method_b").withColumn("value", F.col("a") - F.col("b"))

    names = [*by, "metric", "method_a", "method_b"]
    seen = differences(observed, by).select(*names, F.col("value").alias("observed_difference"))
    return seen.join(interval(differences(samples, ["replicate", *by]), names, "value"), names, "left")


def _beta_part(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_quantile(p: float, df: int) -> float:
    """The ``p``-quantile of Student's t with ``df`` degrees of freedom."""
    tail = lambda t: _beta_part(df / (df + t * t), df / 2, 0.5) / 2  # noqa: E731  chance of more than t > 0
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while tail(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def seed_aggregate(df: DataFrame, by: list[str], value: str, expected: int) -> DataFrame:
    """``by, seeds, mean, std`` (sample) of a value over repeated runs; the deviation is NULL unless all are there."""
    whole = F.count(F.lit(1)) == expected
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("seeds"), F.avg(value).alias("mean"), F.when(whole, F.stddev_samp(value)).alias("std"))


def paired_summary(df: DataFrame, by: list[str], delta: str, level: float = 0.95) -> DataFrame:
    """``by, n, mean, lower, upper``: t interval of differences paired by seed, at each group's own number of them."""
    g = cut(df.groupBy(*by).agg(F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.stddev_samp(delta).alias("_s")))
    sizes = [r["n"] for r in g.select("n").distinct().collect()]  # numbers of seeds
    half = F.lit(None).cast("double")
    for n in sizes:
        if n > 1:
            half = F.when(F.col("n") == n, F.lit(t_quantile((1 + level) / 2, n - 1)) * F.col("_s") / F.sqrt("n")).otherwise(half)
    return g.select(*by, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def labelled(df: DataFrame, **constants: str) -> DataFrame:
    """``df`` with constant text columns in front, such as which analysis a table belongs to."""
    return df.select(*(F.lit(v).alias(k) for k, v in constants.items()), *df.columns)


def unique_row(df: DataFrame, **keys: object) -> dict:
    """The one row with these values; none or several are an error."""
    where = F.lit(True)
    for k, v in keys.items():
        where = where & F.col(k).eqNullSafe(F.lit(v))
    rows = df.where(where).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} row with {keys}")
    return rows[0].asDict()
