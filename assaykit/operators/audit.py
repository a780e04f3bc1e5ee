"""Dataset audit tables: descriptions, counts at thresholds, overflow, published totals, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import bin_of, ratio
from assaykit.operators.ranking import with_quantiles


def describe(df: DataFrame, by: list[str], column: str, percentiles: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """``by, count, mean, std, min, max`` and exact linear percentiles ``p<percent>``."""
    d = df.groupBy(*by).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return with_quantiles(d, df, by, column, {f"p{p * 100:g}".replace(".", "_"): p for p in percentiles})


def threshold_counts(df: DataFrame, column: str, thresholds: tuple[float, ...], above: bool = False) -> DataFrame:
    """``threshold, n``: rows at or below (or above) each threshold, all counted in one pass; NaN is beyond none."""
    x = F.when(~F.isnan(column), F.col(column))
    row = df.agg(*(F.count_if(x >= t if above else x <= t).alias(f"c{i}") for i, t in enumerate(thresholds)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n")) for i, t in enumerate(thresholds)))).alias("x")).select("x.*")


def interval_histogram(df: DataFrame, column: str, edges: tuple[float, ...]) -> DataFrame:
    """``bin, n, percentage`` of half-open intervals, the last one closed; every interval has a row, values outside count nowhere."""
    b = df.select(bin_of(F.col(column), edges).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    d = bins.join(b, "bin", "left").fillna(0, ["n"])
    return d.withColumn("percentage", ratio(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))  # a row for each interval


def retained_counts(df: DataFrame, column: str, thresholds: tuple[float, ...]) -> DataFrame:
    """``threshold, retained``: rows at or above each threshold, all counted in one pass."""
    return threshold_counts(df, column, thresholds, above=True).withColumnRenamed("n", "retained")


def joint_threshold_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, n``: rows that meet each rule, which may look at several columns; all counted in one pass."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("n")) for i, k in enumerate(rules)))).alias("x")).select("x.*")


def modes(images: DataFrame) -> DataFrame:
    """``channels, n`` of readable images, commonest first."""
    return images.where("readable").groupBy("channels").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "channels")


def unreadable(images: DataFrame) -> DataFrame:
    """Paths of images that could not be decoded."""
    return images.where("NOT readable").select("path")


def boundary_overflow(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """How many pixels a normalised box reaches beyond its image, at the worst of four sides."""
    zero = F.lit(0.0)
    return F.greatest(zero, (w / 2 - xc) * width, (xc + w / 2 - 1) * width, (h / 2 - yc) * height, (yc + h / 2 - 1) * height)


def sizes(images: DataFrame) -> DataFrame:
    """``width, height, n``, commonest first."""
    return images.groupBy("width", "height").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width", "height")


def imbalance(df: DataFrame, class_: str) -> DataFrame:
    """One row: the largest and smallest class and their ratio."""
    g = df.groupBy(class_).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("most"), F.min("n").alias("fewest")).withColumn("ratio", ratio(F.col("most"), F.col("fewest")))


def published_names(counts: DataFrame, published: DataFrame) -> DataFrame:
    """``class_id, name`` where a class's ``train, val, total`` equal exactly one published triple, and the reverse."""
    hit = counts.join(published, ["train", "val", "total"]).select("class_id", "name")
    once = lambda c: hit.groupBy(c).count().where("count = 1").select(c)
    return hit.join(once("class_id"), "class_id").join(once("name"), "name").select("class_id", "name")


def comparison(results: DataFrame, metric: str, run: str, value: str, first: str, second: str, no_difference: tuple[str, ...] = ("best_epoch",)) -> DataFrame:
    """``metric, <first>, <second>, difference``; metrics that are no amounts get no difference."""
    w = results.groupBy(metric).pivot(run, [first, second]).agg(F.first(value))
    return w.withColumn("difference", F.when(~F.col(metric).isin(*no_difference), F.col(second) - F.col(first)))
