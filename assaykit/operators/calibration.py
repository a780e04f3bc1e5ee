"""Probability calibration: metrics, reliability bins, four calibrators, cross-fitting and choosing among them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalar import EPSILON, beta_map, bin_of, clipped, interpolated, log_loss, logit, ratio, sigmoid
from assaykit.lineage import cut

TENTHS = tuple(i / 10 for i in range(11))


def reliability_bins(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """``by, bin, n, mean_confidence, accuracy``; bins are half-open tenths, the last closed; empty bins give no row."""
    b = df.where(F.col(p).isNotNull()).withColumn("bin", bin_of(F.col(p), TENTHS))
    return b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_metrics(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """``by, n, correct, accuracy, brier, nll, ece``; the calibration error comes from the ten bins."""
    d = df.where(F.col(p).isNotNull()).withColumn("bin", bin_of(F.col(p), TENTHS))
    per = d.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("correct"), F.sum(p).alias("sum_p"), F.sum((F.col(p) - F.col(y)) ** 2).alias("se"), F.sum(log_loss(F.col(p), F.col(y))).alias("ll"))
    m = per.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("se").alias("se"), F.sum("ll").alias("ll"), F.sum(F.abs(F.col("correct") - F.col("sum_p"))).alias("gap"))
    n = F.col("n")
    return m.select(*by, "n", "correct", ratio(F.col("correct"), n).alias("accuracy"), ratio(F.col("se"), n).alias("brier"), ratio(F.col("ll"), n).alias("nll"), ratio(F.col("gap"), n).alias("ece"))


@dataclass(frozen=True)
class Calibrator:
    """``method`` and its parameters: a slope; slope and intercept; ``a, b, c``; or knots ``x`` and ``y``."""

    method: str
    parameters: tuple[float, ...] = ()
    x: tuple[float, ...] = ()
    y: tuple[float, ...] = ()

    def apply(self, p: Column) -> Column:
        if self.method == "raw":
            return p
        if self.method == "temperature":
            return sigmoid(self.parameters[0] * logit(p))
        if self.method == "platt":
            return sigmoid(self.parameters[0] * logit(p) + self.parameters[1])
        if self.method == "beta":
            return beta_map(p, *map(F.lit, self.parameters))
        return interpolated(p, list(self.x), list(self.y))


def _design(p: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and lower bounds of the coefficients of each parametric calibrator."""
    q = np.clip(p, EPSILON, 1 - EPSILON)
    lp, ln = np.log(q), -np.log1p(-q)
    if method == "temperature":
        return (lp + ln)[:, None], np.array([1e-8])
    if method == "platt":
        return np.stack([lp + ln, np.ones_like(q)], 1), np.array([1e-8, -np.inf])
    return np.stack([lp, ln, np.ones_like(q)], 1), np.array([0.0, 0.0, -np.inf])


def _newton(stats: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], low: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Bounded maximum likelihood of a logistic model by projected Newton steps with halving.

    ``stats`` gives mean loss, gradient and curvature at given coefficients, from wherever the counts are.
    """
    k = len(low)
    w = np.maximum(np.r_[np.ones(k - 1), 0.0] if k > 1 else np.ones(1), np.where(np.isfinite(low), low, -np.inf))
    at, g, h = stats(w)
    for _ in range(rounds):
        free = ~((w <= low) & (g > 0))
        if not free.any() or np.abs(g[free]).max() < 1e-12:
            break
        step = np.zeros_like(w)
        step[free] = np.linalg.solve((h + 1e-12 * np.eye(k))[np.ix_(free, free)], g[free])
        t = 1.0
        while t > 1e-12:
            new = np.maximum(w - t * step, low)
            to, g_new, h_new = stats(new)
            if to <= at:
                break
            t /= 2
        else:
            break
        done = at - to < 1e-16 and np.abs(new - w).max() < 1e-10
        w, at, g, h = new, to, g_new, h_new
        if done:
            break
    return w


def _here(x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Callable:
    """Statistics of counts at hand."""

    def stats(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = x @ w
        s, total = 1 / (1 + np.exp(-z)), n.sum()
        loss = float(np.sum(pos * np.logaddexp(0, -z) + (n - pos) * np.logaddexp(0, z)) / total)
        return loss, x.T @ (n * s - pos) / total, (x * (n * s * (1 - s))[:, None]).T @ x / total

    return stats


def _there(counts: DataFrame, method: str) -> Callable:
    """The same statistics as one aggregation in Spark for each call."""
    q = clipped(F.col("p"))
    lp, ln = F.log(q), -F.log1p(-q)
    x = {"temperature": [lp + ln], "platt": [lp + ln, F.lit(1.0)], "beta": [lp, ln, F.lit(1.0)]}[method]
    k = len(x)
    d = cut(counts.select("k", "n", *(c.alias(f"x{i}") for i, c in enumerate(x))))

    def stats(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((float(w[i]) * F.col(f"x{i}") for i in range(k)), F.lit(0.0))
        s = sigmoid(z)
        up = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
        r = d.agg(
            F.sum("n").alias("total"),
            F.sum(F.col("k") * up(-z) + (F.col("n") - F.col("k")) * up(z)).alias("loss"),
            *(F.sum(F.col(f"x{i}") * (F.col("n") * s - F.col("k"))).alias(f"g{i}") for i in range(k)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("n") * s * (1 - s)).alias(f"h{i}_{j}") for i in range(k) for j in range(k)),
        ).first()
        return r["loss"] / r["total"], np.array([r[f"g{i}"] for i in range(k)]) / r["total"], np.array([[r[f"h{i}_{j}"] for j in range(k)] for i in range(k)]) / r["total"]

    return stats


def _pooled(blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Pool adjacent violators among blocks ``lowest, highest, positives, rows`` in order.

    Pooling stretches of the order first and their blocks afterwards gives the same as pooling it all at once.
    """
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] > out[-1][2] * out[-2][3]:
            _, hi, k2, m2 = out.pop()
            out[-1][1:] = [hi, out[-1][2] + k2, out[-1][3] + m2]
    return out


def _pooled_there(counts: DataFrame) -> list[tuple[float, float, float, float]]:
    """Blocks of every range of scores, pooled where the range is; a few for each range reach the driver."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"p": [], "k": [], "n": []})])
        yield pd.DataFrame(_pooled(zip(rows["p"], rows["p"], rows["k"], rows["n"])), columns=["lo", "hi", "k", "n"], dtype=float)

    ranges = counts.repartitionByRange("p").sortWithinPartitions("p")
    found = ranges.mapInPandas(kernel, "lo double, hi double, k double, n double").collect()
    return sorted((r["lo"], r["hi"], r["k"], r["n"]) for r in found)


def _knots(blocks: list[list[float]]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Ends of the pooled blocks and their shares."""
    knots = [(float(x), float(k / m)) for lo, hi, k, m in blocks for x in dict.fromkeys((lo, hi))]
    return tuple(x for x, _ in knots), tuple(y for _, y in knots)


def score_counts(df: DataFrame, p: str, y: str, *by: str) -> DataFrame:
    """``by, p, k, n``: positives and rows at each distinct score, all that calibrators need."""
    return df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(y).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))


METHODS = ("temperature", "platt", "beta", "isotonic")


def fit_counts(counts: DataFrame, methods: tuple[str, ...] = METHODS, most_scores: int = 5_000_000) -> dict[str, Calibrator]:
    """Calibrators of ``counts (p, k, n)``, all from one collection of it, or, beyond ``most_scores`` distinct scores, by
    aggregations that stay in Spark: gradients of each Newton step, and pooling by range. A single class is an error."""
    total = counts.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.count(F.lit(1)).alias("scores")).first()
    if total["k"] in (0, total["n"]):
        raise ValueError("calibration needs both classes")
    if total["scores"] <= most_scores:
        return fit_arrays(*(np.array(c, float) for c in zip(*counts.orderBy("p").select("p", "k", "n").collect())), methods=methods)
    out = {"raw": Calibrator("raw")}
    for m in methods:
        if m == "isotonic":
            x, y = _knots(_pooled(_pooled_there(counts)))
            out[m] = Calibrator(m, x=x, y=y)
        elif m != "raw":
            out[m] = Calibrator(m, tuple(float(v) for v in _newton(_there(counts, m), _design(np.array([0.5]), m)[1])))
    return out


def fit_arrays(p: np.ndarray, k: np.ndarray, n: np.ndarray, methods: tuple[str, ...] = METHODS) -> dict[str, Calibrator]:
    """Calibrators of counts in arrays, by ascending score."""
    if not len(p) or k.sum() in (0, n.sum()):
        raise ValueError("calibration needs both classes")
    out = {"raw": Calibrator("raw")}
    for m in methods:
        if m == "isotonic":
            x, y = _knots(_pooled(zip(p, p, k, n)))
            out[m] = Calibrator(m, x=x, y=y)
        elif m != "raw":
            features, low = _design(p, m)
            out[m] = Calibrator(m, tuple(float(v) for v in _newton(_here(features, k, n), low)))
    return out


def fit_calibrator(df: DataFrame, p: str, y: str, method: str, most_scores: int = 5_000_000) -> Calibrator:
    """Fit one calibrator on all rows, through counts of either label at each distinct score."""
    return Calibrator("raw") if method == "raw" else fit_counts(cut(score_counts(df, p, y)), (method,), most_scores)[method]


def cross_fit(df: DataFrame, p: str, y: str, fold: str, folds: int, methods: tuple[str, ...] = METHODS, most_scores: int = 5_000_000) -> DataFrame:
    """``df`` in long form with ``method, probability``: each row scored by calibrators fitted without its fold.

    One aggregation by fold and score serves all fits. A row whose fold is not one of ``folds`` has no probability.
    """
    counts = cut(score_counts(df, p, y, fold))
    without = lambda k: counts.where(F.col(fold) != k).groupBy("p").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    if counts.count() <= most_scores:
        rows = counts.orderBy("p").toPandas()
        fits = {}
        for f in range(folds):
            g = rows[rows[fold] != f].groupby("p", sort=True)[["k", "n"]].sum()
            fits[f] = fit_arrays(g.index.to_numpy(float), g["k"].to_numpy(float), g["n"].to_numpy(float), methods)
    else:
        fits = {f: fit_counts(without(f), methods, most_scores) for f in range(folds)}
    out = [F.struct(F.lit("raw").alias("method"), F.col(p).cast("double").alias("probability"))]
    for m in methods:
        value = F.lit(None).cast("double")
        for f in range(folds):
            value = F.when(F.col(fold) == f, fits[f][m].apply(F.col(p))).otherwise(value)
        out.append(F.struct(F.lit(m).alias("method"), value.alias("probability")))
    return df.withColumn("_m", F.explode(F.array(*out))).select(*df.columns, "_m.method", "_m.probability")


def choose_method(intervals: dict[tuple[str, str, str], tuple[float, float]], observed: dict[tuple[str, str], float], order: tuple[str, ...] = ("temperature", "platt", "beta", "isotonic")) -> str:
    """Lowest NLL; methods whose paired NLL interval against it holds 0 stay; of these likewise by Brier; then the simplest.

    ``intervals[method, reference, metric]`` are paired intervals of differences, ``observed[method, metric]`` values. Raw
    wins when the choice does not beat it on both metrics.
    """
    left = list(order)
    for metric in ("nll", "brier"):
        best = min(left, key=lambda m: (observed[m, metric], order.index(m)))
        same = lambda m: m == best or intervals[m, best, metric][0] <= 0 <= intervals[m, best, metric][1]  # noqa: B023, E731
        left = [m for m in left if same(m)]
    chosen = left[0]
    return chosen if all(observed[chosen, m] < observed["raw", m] for m in ("nll", "brier")) else "raw"


def add_losses(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.withColumn("nll", log_loss(F.col(p), F.col(y))).withColumn("brier", (F.col(p) - F.col(y)) ** 2)
