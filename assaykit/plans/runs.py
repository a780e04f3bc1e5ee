"""Planning and timing of repeated runs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_matrix(spark: SparkSession, seeds: list[str], splits: list[str]) -> DataFrame:
    """``position, seed_label, split, run_id``: every seed with every split. Seeds are labels; leading zeros stay."""
    rows = [(i * len(splits) + j, s, p, f"{p}/seed_{s}") for i, s in enumerate(seeds) for j, p in enumerate(splits)]
    return spark.createDataFrame(rows, "position int, seed_label string, split string, run_id string")


def select_runs(plan: DataFrame, ledger: DataFrame | None = None, seed: str | None = None, split: str | None = None, remaining: bool = False) -> DataFrame:
    """One run by seed and split, or those that the ledger does not hold as complete; not both."""
    if remaining == (seed is not None or split is not None):
        raise ValueError("ask for remaining runs, or for a seed and split")
    if remaining:
        done = ledger.where("status = 'complete'").select(F.col("experiment").alias("run_id")).distinct()
        return plan.join(done, "run_id", "left_anti").orderBy("position")
    return plan.where((F.col("seed_label") == seed) & (F.col("split") == split))


def measure(pipelines: dict[str, Callable[[], int]], repetitions: int = 5, clock: Callable[[], float] = time.perf_counter) -> list[dict]:
    """Seconds of each pipeline, warmed once and then taken in turns; a pipeline returns how many crops it did."""
    for run in pipelines.values():
        run()
    out = []
    for k in range(repetitions):
        names = list(pipelines) if k % 2 == 0 else list(pipelines)[::-1]
        for name in names:
            began = clock()
            crops = pipelines[name]()
            seconds = clock() - began
            out.append({"pipeline": name, "repetition": k + 1, "crops": crops, "seconds": seconds, "milliseconds_per_crop": 1000 * seconds / crops if crops else None})
    return out


def timing_summary(timings: DataFrame, baseline: str) -> DataFrame:
    """Mean, sample deviation, latency, throughput and overhead against ``baseline`` of every pipeline."""
    s = timings.groupBy("pipeline").agg(F.count(F.lit(1)).alias("repetitions"), F.avg("seconds").alias("mean_seconds"), F.stddev_samp("seconds").alias("std_seconds"), F.avg("crops").alias("crops"))
    base = s.where(F.col("pipeline") == baseline).select(F.col("mean_seconds").alias("_base"))
    s = s.join(F.broadcast(base))
    return s.select("pipeline", "repetitions", "mean_seconds", "std_seconds", (1000 * F.col("mean_seconds") / F.col("crops")).alias("milliseconds_per_crop"), (F.col("crops") / F.col("mean_seconds")).alias("throughput_crops_per_second"), (F.col("mean_seconds") / F.col("_base")).alias("overhead_ratio"))
