"""Risk scores from reliability signals, their fusion, and the search for fusion weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.lineage import cut
from assaykit.operators.ranking import auroc_ap
from assaykit.protocol import Protocol


def component_risks() -> dict[str, Column]:
    return {
        "raw_risk": 1 - F.col("raw_confidence"),
        "calibrated_risk": 1 - F.col("calibrated_confidence"),
        "class_risk": 1 - F.col("class_consistency"),
        "localisation_risk": 1 - F.col("localisation_stability"),
    }


def weighted_risk(conf: Column, cls: Column, loc: Column) -> Column:
    """``(conf * c + cls * k + loc * l) / 100`` of the component risks, in this order; weights are whole percentages."""
    return (conf * (1 - F.col("calibrated_confidence")) + cls * (1 - F.col("class_consistency")) + loc * (1 - F.col("localisation_stability"))) / F.lit(100)


def risk_columns(weights: tuple[int, int, int] | None = None) -> dict[str, Column]:
    """The eight risks (four single, three pair means, the mean of three) and, with weights, their fusion."""
    c = component_risks()
    cal, cls, loc = c["calibrated_risk"], c["class_risk"], c["localisation_risk"]
    out = c | {"calibrated_class_risk": (cal + cls) / 2, "calibrated_localisation_risk": (cal + loc) / 2, "class_localisation_risk": (cls + loc) / 2, "equal_risk": (cal + cls + loc) / 3}
    if weights:
        out["weighted_risk"] = weighted_risk(*map(F.lit, weights))
    return out


def risk_scores(df: DataFrame, keep: list[str], weights: tuple[int, int, int] | None = Protocol.weights) -> DataFrame:
    """Long form: ``keep, method, risk``; one row per prediction and method, from one pass over the input."""
    risks = risk_columns(weights)
    pairs = F.array(*(F.struct(F.lit(k).alias("method"), v.alias("risk")) for k, v in risks.items()))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.method", "p.risk")


def weight_grid(spark: SparkSession, step: int = 1) -> DataFrame:
    """All whole-percent triples that sum to 100, in steps; with their exact squared distance from equal weights."""
    side = spark.range(0, 101, step)
    g = side.select(F.col("id").alias("conf")).withColumn("cls", F.explode(F.sequence(F.lit(0), 100 - F.col("conf"), F.lit(step))))
    g = g.select("conf", F.col("cls").cast("long").alias("cls"), (100 - F.col("conf") - F.col("cls")).cast("long").alias("loc"))
    return g.withColumn("distance", sum(((3 * F.col(c) - 100) * (3 * F.col(c) - 100) for c in ("conf", "cls", "loc")), F.lit(0)).cast("long"))


def _ranked(counts: DataFrame, grid: DataFrame, fold: str, signals: list[str]) -> DataFrame:
    """Mean AP and AUROC of each candidate over folds, in a kernel over candidates with all counted triples at hand."""
    pdf = counts.toPandas()
    folds = [tuple(g[c].to_numpy(float) for c in (*signals, "pos", "neg")) for _, g in pdf.groupby(fold, dropna=False)]
    shared = grid.sparkSession.sparkContext.broadcast(folds)

    def score(conf: int, cls: int, loc: int) -> tuple[float | None, float | None]:
        aps, aurocs = [], []
        for a, b, c, pos, neg in shared.value:
            risk = (conf * (1 - a) + cls * (1 - b) + loc * (1 - c)) / 100
            order = np.argsort(-risk)
            first = np.flatnonzero(np.r_[True, np.diff(risk[order]) != 0])
            p, n = np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)
            cp, cn = np.cumsum(p), np.cumsum(n)
            if cp[-1]:
                aps.append(float((p * cp / np.maximum(cp + cn, 1)).sum() / cp[-1]))
                if cn[-1]:
                    aurocs.append(float((p * (cn[-1] - cn + n / 2)).sum() / (cp[-1] * cn[-1])))
        mean = lambda x: sum(x) / len(x) if x else None
        return mean(aps), mean(aurocs)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            found = [score(*w) for w in zip(g["conf"].tolist(), g["cls"].tolist(), g["loc"].tolist())]
            yield g[["conf", "cls", "loc"]].assign(mean_ap=[f[0] for f in found], mean_auroc=[f[1] for f in found], distance=g["distance"])

    grid = grid.select("conf", "cls", "loc", "distance")
    tasks = min(200, grid.count())
    return grid.repartition(tasks).mapInPandas(kernel, "conf long, cls long, loc long, mean_ap double, mean_auroc double, distance long")


def evaluate_grid(population: DataFrame, grid: DataFrame, fold: str = "fold_id", label: str = "incorrect", most_rows: int = 2_000_000) -> DataFrame:
    """Mean over folds of AP and AUROC for each weight triple.

    The population is counted by fold and distinct triple of signals first. Up to ``most_rows`` of those are broadcast,
    and a kernel ranks them for each candidate; beyond that every candidate is scored in Spark (the grid has a fixed number
    of rows, 5,151 at most).
    """
    signals = ["calibrated_confidence", "class_consistency", "localisation_stability"]
    counts = cut(population.groupBy(fold, *signals).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")))
    if counts.count() <= most_rows:
        return _ranked(counts, grid, fold, signals)
    wide = population.groupBy(fold, label, *signals).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(grid))
    scored = wide.withColumn("risk", weighted_risk(F.col("conf"), F.col("cls"), F.col("loc")))
    per = auroc_ap(scored, ["conf", "cls", "loc", fold], "risk", label, "_n")
    return per.groupBy("conf", "cls", "loc").agg(F.avg("ap").alias("mean_ap"), F.avg("auroc").alias("mean_auroc")).join(F.broadcast(grid), ["conf", "cls", "loc"])


def select_weights(evaluated: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The one triple: best AP within tolerance, then AUROC, then nearest to equal weights, then by conf, loc, cls."""
    best = evaluated.where(F.col("mean_ap") >= evaluated.agg(F.max("mean_ap") - tolerance).first()[0])
    best = best.where(F.col("mean_auroc") >= best.agg(F.max("mean_auroc") - tolerance).first()[0])
    return best.orderBy("distance", "conf", "loc", "cls").limit(1)
