"""Ranking quality with whole tie groups, frequency weights and NULL for what is undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import ratio
from assaykit.lineage import cut
from assaykit.operators.scan import running_totals


def tie_groups(df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """``by, score, pos, neg``: weights of positives and negatives at each score; groups without weight are left out."""
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("pos"), F.sum(w * (1 - F.col(label))).alias("neg"))
    return g.where(F.col("pos") + F.col("neg") > 0)


def auroc_ap(df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """``by, n_pos, n_neg, score_groups, auroc, ap``; higher scores should go with label 1.

    All rows of a score enter together. AUROC is NULL without both classes, AP without positives. Scores are compared
    as computed, so a score should be computed once. A group without rows gives no row.
    """
    g = running_totals(tie_groups(df, by, score, label, weight), by, "score", ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg")
    hits, all_ = F.col("all_pos") - F.col("cum_pos") + F.col("pos"), F.col("all_pos") + F.col("all_neg") - F.col("cum_pos") - F.col("cum_neg") + F.col("pos") + F.col("neg")
    out = g.groupBy(*by).agg(
        F.max("all_pos").alias("n_pos"),
        F.max("all_neg").alias("n_neg"),
        F.count(F.lit(1)).alias("score_groups"),
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("_won"),
        F.sum(F.col("pos") * hits / all_).alias("_precision"),
    )
    return out.select(*by, "n_pos", "n_neg", "score_groups", ratio(F.col("_won"), F.col("n_pos") * F.col("n_neg")).alias("auroc"), ratio(F.col("_precision"), F.col("n_pos")).alias("ap"))


def average_rank(order: str, by: list[str] | None = None) -> Column:
    """Rank with ties sharing their mean, as rank correlation wants it."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    same = Window.partitionBy(*(by or []), order)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, rho``: rank correlation from tie groups; NULL for a constant or fewer than two rows."""
    data = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("m"))
    data = cut(data)

    def ranks(c: str) -> DataFrame:
        g = running_totals(data.groupBy(c).agg(F.sum("m").alias("k")), [], c, ["k"])
        return g.select(c, (F.col("cum_k") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{c}"))

    d = data.join(ranks("x"), "x").join(ranks("y"), "y").select("rx", "ry", "m")
    m = d.agg(*(F.sum(F.col("m") * e).alias(n) for n, e in {"sx": F.col("rx"), "sy": F.col("ry"), "sxx": F.col("rx") ** 2, "syy": F.col("ry") ** 2, "sxy": F.col("rx") * F.col("ry")}.items()), F.sum("m").alias("n"))
    n = F.col("n")
    spread = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    return m.select("n", F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).alias("rho"))


def quantiles(df: DataFrame, by: list[str], column: str, probs: tuple[float, ...]) -> DataFrame:
    """``by, q0, q1, ...``: exact quantiles, linear between order statistics, found in running counts of values.

    Null and NaN values do not count; a group without any value gives no row. No task holds a group's values.
    """
    x = F.col(column).cast("double")
    g = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_k"))
    g = running_totals(g, by, "_x", ["_k"])
    at = lambda place: F.max(F.when((F.col("cum__k") - F.col("_k") <= place) & (place < F.col("cum__k")), F.col("_x")))
    place = [(F.col("all__k") - 1) * p for p in probs]
    found = g.groupBy(*by).agg(F.max("all__k").alias("_n"), *(f(p).alias(f"_{side}{i}") for i, p in enumerate(place) for side, f in (("a", lambda p: at(F.floor(p))), ("b", lambda p: at(F.ceil(p))))))
    part = [(F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p) for p in probs]
    return found.select(*by, *((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part[i]).alias(f"q{i}") for i in range(len(probs))))


def with_quantiles(summary: DataFrame, df: DataFrame, by: list[str], column: str, named: dict[str, float]) -> DataFrame:
    """``summary`` (a row per group) with named quantiles of ``column``; null for a group without values."""
    q = quantiles(df, by, column, tuple(named.values()))
    q = q.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(F.col(f"q{i}").alias(n) for i, n in enumerate(named)))
    if not by:
        return summary.join(q, F.lit(True), "left")  # one row each
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return summary.join(q, on, "left").drop(*(f"_by_{c}" for c in by))


def descriptives(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """``by, n, mean, std`` (population) and linear quartiles; every value exact."""
    out = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return with_quantiles(out, df, by, column, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def best_row(df: DataFrame, by: list[str], metric: str, position: str, *keep: str) -> DataFrame:
    """The row with the largest metric per group, the first by position where tied; NULL metrics never win."""
    top = F.max(F.struct(F.col(metric).alias("m"), (-F.col(position)).alias("p"), *keep))
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(top.alias("t")).select(*by, F.col("t.m").alias(metric), (-F.col("t.p")).alias(position), *(F.col(f"t.{k}").alias(k) for k in keep))


def pairwise_differences(df: DataFrame, by: list[str], method: str, value: str) -> DataFrame:
    """``by, method, reference, difference`` for all ordered pairs of different methods."""
    a = df.select(*by, F.col(method).alias("method"), F.col(value).alias("_a"))
    b = df.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(method).alias("reference"), F.col(value).alias("_b"))
    on = F.col("method") != F.col("reference")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, on).select(*by, "method", "reference", (F.col("_a") - F.col("_b")).alias("difference"))
